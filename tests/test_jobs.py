import datetime as dt
import json

from tapegrid.operators import bars, calendars, securities
from tapegrid.plans import jobs, queries
from tapegrid.sources import files, schemas

TAPE = "condition_id string, market_slug string, category string, category_refined string, usdc_amount double, p_event double, D int, block_timestamp long, event_id long, opens_at timestamp_ntz, close_at timestamp_ntz, resolved_at timestamp_ntz, winning_outcome_label string"


def test_market_tables_are_written_in_order(spark, tmp_path):
    at = lambda text: int(dt.datetime.fromisoformat(text + ":00-04:00").timestamp())
    rows = [("a", "rain-in-may", 40.0, 0.3, at("2024-05-21 10:05")), ("a", "rain-in-may", 40.0, 0.4, at("2024-05-22 11:00")), ("b", "bridge-opens", 200.0, 0.7, at("2024-05-21 09:40")), ("c", "rain-stops", 3.0, 0.1, at("2024-05-21 10:00")), ("a", "rain-in-may", 9.0, 0.9, None)]
    tape = spark.createDataFrame([(c, slug, "x", None, usdc, p, 1, t, k, None, None, None, None) for k, (c, slug, usdc, p, t) in enumerate(rows)], TAPE)
    jobs.build_market_tables(spark, tape, str(tmp_path), {"rain": ["RAIN"], "snow": ["snow"], "bridge": ["bridge"]}, "2024-05-01", "2024-05-31", min_usdc=50.0)
    assert [r.condition_id for r in spark.read.parquet(f"{tmp_path}/catalog").coalesce(1).collect()] == ["b", "a"]
    panel = spark.read.parquet(f"{tmp_path}/panel").coalesce(1).collect()
    assert [(r.trade_date, r.minute) for r in panel] == sorted((r.trade_date, r.minute) for r in panel) and len(panel) == 2 * 391
    found = {(r.trade_date, r.minute): r for r in panel}
    assert found["2024-05-21", "10:06"].rain_p == 0.3 and found["2024-05-22", "11:01"].rain_n_session == 1 and found["2024-05-21", "16:00"].bridge_usdc_session == 200
    assert "snow_p" not in panel[0].asDict()


def test_reference_from_landed_records(spark, tmp_path):
    landed = {
        "tickers": [{"ticker": "gull.us", "name": "Gull", "primary_exchange": "X", "active": True}, {"ticker": "TY.B", "name": "Ty", "primary_exchange": "Y", "active": False, "delisted_utc": "2022-02-01T00:00:00Z"}],
        "splits": [{"ticker": "TYB", "execution_date": "2021-03-01", "split_from": 1, "split_to": 3}, {"ticker": "GULL", "execution_date": "2010-03-01", "split_from": 1, "split_to": 2}],
        "dividends": [{"ticker": "GULL", "ex_dividend_date": "2021-06-01", "cash_amount": 0.5}, {"ticker": "GULL", "ex_dividend_date": "2021-06-01"}],
    }
    for name, rows in landed.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "1.json").write_text("\n".join(map(json.dumps, rows)))
    root = str(tmp_path / "out")
    jobs.build_reference(spark, str(tmp_path / "in"), root, since="2020-01-01")
    listing = spark.read.parquet(f"{root}/listing")
    assert sorted(tuple(r) for r in securities.symbol_meta(listing).collect()) == [("GULL", "X", "Gull"), ("TY.B", "Y", "Ty")]
    assert [r.name for r in securities.symbol_meta(listing, ["TY.B"]).collect()] == ["Ty"] and securities.symbol_meta(listing, []).count() == 0
    actions = files.read_corp_actions(spark, f"{root}/corp_actions")
    assert sorted(tuple(r) for r in actions.collect()) == [("GULL", "2021-06-01", 1.0, 0.5), ("TY.B", "2021-03-01", 3.0, 0.0)]
    assert [r.symbol for r in files.read_corp_actions(spark, f"{root}/corp_actions", ["GULL"]).collect()] == ["GULL"]
    none = files.read_corp_actions(spark, f"{root}/nothing")
    assert none.count() == 0 and none.schema == spark.createDataFrame([], schemas.CORP_ACTIONS).schema


def test_lifecycle_and_years(spark, tmp_path):
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/splits")
    assert list(files.read_lifecycle(spark, str(tmp_path))) == ["splits"]
    rows = spark.createDataFrame([(2022,), (2023,), (None,)], "file_year int")
    assert [r.file_year for r in files.of_years(rows, [2023]).collect()] == [2023]
    days = calendars.trading_days(calendars.trading_calendar(spark, "2024-05-24", "2024-05-28"))
    assert sorted(r.trade_date for r in days.collect()) == ["2024-05-24", "2024-05-28"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_read_their_trades_once(spark):
    plan = plan_of(queries.QUERIES["market_features"](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_chosen_markets_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "tape")
    spark.createDataFrame([(c, f"slug-{c}", None, None, 60.0, 0.5, 1, 1716300000 + k, k, None, None, None, None) for k, c in enumerate("aabbcc")], TAPE).write.parquet(path)
    tape = files.read_trades(spark, path)
    panel = jobs.build_feature_panel(spark, tape, {"one": ["slug-b"], "two": ["slug-c", "slug-b"]}, "2024-05-01", "2024-05-31", 100.0)
    plan = plan_of(panel)
    assert plan.count("FileScan parquet") == 1 and "In(condition_id, [b])" in plan.replace("EqualTo(condition_id,b)", "In(condition_id, [b])")
    assert {"one_p", "two_p"} <= set(panel.columns) and panel.count() == 391
    weekend = jobs.build_feature_panel(spark, tape, {"one": ["slug-b"]}, "2024-05-25", "2024-05-26", 100.0)
    assert weekend.columns == ["trade_date", "minute"] and weekend.count() == 0


def test_listing_of_two_pulls_and_a_snapshot(spark):
    fields = "ticker string, name string, primary_exchange string, active boolean, delisted_utc string, market string, snapshot_date string"
    active = spark.createDataFrame([("GULL", "Gull", "X", True, None, "stocks", "2024-01-02"), ("GULL", "Old Gull", "X", True, None, "stocks", "2023-01-02"), ("FXAB", "Pair", "X", True, None, "fx", "2024-01-02")], fields)
    delisted = spark.createDataFrame([("GULL", "Gone", "2020-05-01"), ("TERN", "Tern", "2021-05-01")], "ticker string, name string, delisted_utc string")
    asked = securities.filter_tickers(active, market="stocks", active=True, date="2024-01-02")
    assert [r.name for r in asked.collect()] == ["Gull"]
    assert securities.filter_tickers(active).count() == 3 and securities.filter_tickers(active, active=False).count() == 0
    found = {r.symbol: (r.name, r.status, r.delist_date) for r in securities.build_listing(asked, delisted).collect()}
    assert found == {"GULL": ("Gull", "active", ""), "TERN": ("Tern", "delisted", "2021-05-01")}


def test_bars_in_order_with_a_limit(spark):
    rows = spark.createDataFrame([("A", dt.datetime(2024, 5, 21, 9, 31 + k)) for k in (3, 0, 2, 1)] + [("B", dt.datetime(2024, 5, 21, 9, 31))], "symbol string, ts timestamp_ntz")
    assert [(r.symbol, r.ts.minute) for r in bars.first_bars(rows, ["A"], 2).collect()] == [("A", 31), ("A", 32)]
    assert [r.symbol for r in bars.first_bars(rows, None, 2).collect()] == ["A", "B"] and "TakeOrderedAndProject" in plan_of(bars.first_bars(rows, None, 2))
