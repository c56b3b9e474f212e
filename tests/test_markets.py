import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapegrid.operators import calendars, markets
from tapegrid.streaming import flow

TRADES = "condition_id string, utc timestamp_ntz, et_ts timestamp_ntz, p_event double, D int, usdc_amount double, resolved_et timestamp_ntz, tie long"
CALENDAR = "2024-03-01", "2024-12-31"


def trades(spark, rows, market="m", resolved=None):
    """rows: (local time, price, sign, amount)."""
    from zoneinfo import ZoneInfo

    out = []
    for k, (text, p, d, amount) in enumerate(rows):
        et = dt.datetime.fromisoformat(text)
        utc = et.replace(tzinfo=ZoneInfo("America/New_York")).astimezone(dt.UTC).replace(tzinfo=None)
        out.append((market, utc, et, p, d, amount, resolved and dt.datetime.fromisoformat(resolved), k))
    return spark.createDataFrame(out, TRADES)


def features(spark, df):
    found = markets.minute_features(df, calendars.trading_calendar(spark, *CALENDAR)).collect()
    return {(r.trade_date[5:], r.minute): r for r in found}


ONE = [("2024-05-21 07:10", 0.31, 1, 7.0), ("2024-05-21 09:52:10", 0.44, 1, 64.0), ("2024-05-21 11:15", 0.37, -1, 24.0), ("2024-05-22 10:20", 0.49, 1, 9.0)]
TWO = [("2024-05-21 11:05", 0.28, 1, 33.0), ("2024-05-21 16:00:00", 0.36, 1, 21.0), ("2024-05-21 20:40", 0.41, -1, 12.0), ("2024-05-22 08:05", 0.46, 1, 6.0), ("2024-05-22 09:30:20", 0.52, 1, 3.0)]


def test_labels_see_earlier_trades_alone(spark):
    f = features(spark, trades(spark, ONE))
    assert len(f) == 2 * 391
    shown = {m: (r.p, r.n_session, r.usdc_session, r.flow_session) for (day, m), r in f.items() if day == "05-21"}
    assert shown["09:30"] == shown["09:52"] == (0.31, 0, 0, 0)
    assert shown["09:53"] == shown["11:15"] == (0.44, 1, 64, 64)
    assert shown["11:16"] == shown["16:00"] == (0.37, 2, 88, 40)
    assert f["05-21", "11:16"].dp_intraday == pytest.approx(0.06) and f["05-22", "09:30"].dp_overnight == pytest.approx(0.0)
    for day in ("05-21", "05-22"):
        own = [f[k] for k in sorted(f) if k[0] == day]
        assert all(a.n_session <= b.n_session and a.usdc_session <= b.usdc_session for a, b in zip(own, own[1:], strict=False))


def test_nothing_after_resolution(spark):
    f = features(spark, trades(spark, ONE, resolved="2024-05-22 12:40"))
    assert f["05-22", "10:21"].p == 0.49 and f["05-22", "12:39"].n_session == 1
    assert all(x is None for m in ("12:40", "13:00", "16:00") for x in f["05-22", m][3:])


def test_night_runs_from_close_to_open(spark):
    f = features(spark, trades(spark, TWO))
    assert f["05-21", "12:00"].n_overnight is None
    assert {(r.n_overnight, r.usdc_overnight, r.flow_overnight) for k, r in f.items() if k[0] == "05-22"} == {(3, 39, 15)}
    assert (f["05-22", "09:31"].n_session, f["05-22", "09:31"].usdc_session) == (1, 3)


def test_half_day_clock_changes_nulls_and_ties(spark):
    half = features(spark, trades(spark, [("2024-11-27 10:00", 0.4, 1, 1.0), ("2024-11-29 14:00", 0.5, 1, 2.0), ("2024-12-02 10:00", 0.6, 1, 4.0)]))
    assert sum(k[0] == "11-29" for k in half) == 211 and ("11-29", "13:01") not in half and ("11-28", "10:00") not in half
    assert half["12-02", "09:30"].usdc_overnight == 2 and half["12-02", "09:30"].p == 0.5
    for days in (("03-08", "03-11"), ("11-01", "11-04")):
        f = features(spark, trades(spark, [(f"2024-{days[0]} 15:30", 0.4, 1, 1.0), (f"2024-{days[1]} 09:29:59", 0.5, 1, 2.0), (f"2024-{days[1]} 09:31", 0.6, 1, 4.0)]))
        r = f[days[1], "09:31"]
        assert (r.p, r.n_session, r.usdc_overnight) == (0.5, 0, 2) and f[days[1], "09:32"].usdc_session == 4
    f = features(spark, trades(spark, [("2024-06-13 10:00", 0.4, 1, 1.0), ("2024-06-13 10:00", 0.9, 1, 1.0), ("2024-06-13 11:00", None, None, 3.0)]))
    assert f["06-13", "10:01"].p == 0.9 and f["06-13", "11:01"].p is None
    assert (f["06-13", "11:01"].n_session, f["06-13", "11:01"].flow_session, f["06-13", "11:01"].usdc_session) == (3, 2, 5)


def test_empty_and_weekend_markets(spark):
    assert features(spark, trades(spark, [])) == {}
    assert features(spark, trades(spark, [("2024-06-15 12:00", 0.5, 1, 1.0)])) == {}


def test_panel(spark):
    both = trades(spark, ONE).unionByName(trades(spark, TWO, "n")).unionByName(trades(spark, [("2024-06-15 12:00", 0.5, 1, 1.0)], "weekend"))
    f = markets.minute_features(both, calendars.trading_calendar(spark, *CALENDAR))
    keys = spark.createDataFrame([("a", "m"), ("b", "n"), ("c", "m"), ("d", "weekend")], "key string, condition_id string")
    panel = markets.feature_panel(f, keys)
    assert panel.columns == ["trade_date", "minute", *[f"{k}_{c}" for k in "abc" for c in markets.FEATURES]] and panel.count() == 782
    r = panel.where("trade_date = '2024-05-21' AND minute = '11:16'").first()
    assert r.a_n_session == r.c_n_session == 2 and r.b_n_session == 1
    bars = spark.createDataFrame([("S", "2024-05-21", "11:16"), ("S", "2024-05-21", "20:00")], "symbol string, trade_date string, minute string")
    assert [x.a_n_session for x in markets.attach_features(bars, panel).orderBy("minute").collect()] == [2, None]
    assert [x.minute for x in markets.panel_tail(panel, 2).collect()] == ["16:00", "15:59"]


def test_catalog_and_search(spark):
    columns = "condition_id string, market_slug string, category string, category_refined string, usdc_amount double, block_timestamp long, opens_at timestamp, close_at timestamp, resolved_at timestamp, winning_outcome_label string"
    rows = [("1", "Harbour-Bridge-opens", "c", None, 30.0, 5), ("1", "Harbour-Bridge-opens", "c", None, 20.0, 3), ("2", "rain-over.30mm%", "c", "r", 49.0, 1), ("3", None, "c", "r", 70.0, 1)]
    tape = spark.createDataFrame([(*r, None, None, None, None) for r in rows], columns)
    catalog = markets.market_catalog(tape, 50.0)
    assert {(r.condition_id, r.n_trades, r.first_ts, r.last_ts) for r in catalog.collect()} == {("1", 2, 3, 5), ("3", 1, 1, 1)}
    every = markets.market_catalog(tape, 0.0)
    assert [r.condition_id for r in markets.search(every, ["BRIDGE", "rain"]).collect()] == ["1", "2"]
    assert [r.condition_id for r in markets.search(every, ["bridge", "rain"], 1).collect()] == ["1"]
    assert markets.search(every, ["r.30"], 0).count() == 1 and markets.search(every, ["r.in"]).count() == 0 and markets.search(every, []).count() == 0
    assert [(r.key, r.condition_id) for r in markets.theme_markets(every, {"a": ["bridge"], "b": ["rain", "bridge"]}).orderBy("key").collect()] == [("a", "1"), ("b", "1")]


def test_calendar():
    assert [d.isoformat() for d in calendars.holidays(2024)] == ["2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25"]
    assert [d.isoformat() for d in calendars.early_closes(2024)] == ["2024-07-03", "2024-11-29", "2024-12-24"]
    assert calendars.easter(2025) == dt.date(2025, 4, 20) and calendars.easter(2000) == dt.date(2000, 4, 23)
    assert dt.date(2021, 12, 31) not in calendars.holidays(2021) and dt.date(2022, 6, 20) in calendars.holidays(2022)


def test_grid_and_gaps(spark):
    cal = calendars.trading_calendar(spark, "2024-11-27", "2024-12-02")
    assert [r.trade_date for r in cal.orderBy("trade_date").collect()] == ["2024-11-27", "2024-11-29", "2024-12-02"]
    assert {r.trade_date: r["count"] for r in calendars.minute_grid(cal).groupBy("trade_date").count().collect()} == {"2024-11-27": 391, "2024-11-29": 211, "2024-12-02": 391}
    assert calendars.minute_grid(calendars.trading_calendar(spark, "2024-11-30", "2024-11-29")).count() == 0
    bars = spark.createDataFrame([("A", "2024-11-27"), ("A", "2024-12-02"), ("B", "2024-11-29")], "symbol string, trade_date string")
    assert [tuple(r) for r in calendars.missing_days(cal, bars).collect()] == [("A", "2024-11-29")]


def test_streaming_flow_equals_batch(spark, tmp_path):
    rows = [("m", dt.datetime(2024, 6, 13, 10, k % 5, k), k % 3 - 1, float(k)) for k in range(50)]
    spark.createDataFrame(rows, "condition_id string, ts timestamp, D int, usdc_amount double").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = flow.stream_minute_flow(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("flows").trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = batch.groupBy("condition_id", F.date_trunc("MINUTE", "ts").alias("m")).agg(F.sum(F.col("D") * F.col("usdc_amount")).alias("net"), F.sum("usdc_amount").alias("usdc"), F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("flows").collect())) == sorted(map(tuple, wanted.collect()))


def test_ingest_reads_each_file_once(spark, tmp_path):
    from tapegrid.sources.schemas import US_RAW

    (tmp_path / "in").mkdir()
    line = "QX,4,2,3,5,1,1716298200000000000,6\n"
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.csv").write_text("ticker,volume,open,close,high,low,window_start,transactions\n" + line * k)
        flow.ingest_new_files(spark, str(tmp_path / "in"), US_RAW, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == (1, 3)[k - 1]
