import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from tapegrid.functions import symbols, timeconv
from tapegrid.operators import bars, securities, tables
from tapegrid.plans import jobs, queries
from tapegrid.sources import files, schemas

US_HEADER = "ticker,volume,open,close,high,low,window_start,transactions"
CN_HEADER = "时间,代码,名称,开盘价,收盘价,最高价,最低价,成交量,成交额,涨幅,振幅"


def ns(text):
    """Start of a bar in New York, as nanoseconds of UTC."""
    from zoneinfo import ZoneInfo

    return int(dt.datetime.fromisoformat(text).replace(tzinfo=ZoneInfo("America/New_York")).timestamp()) * 10**9


def us_file(path, rows):
    with gzip.open(path, "wt") as f:
        f.write("\n".join([US_HEADER, *(",".join(map(str, r)) for r in rows)]) + "\n")


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("start,label", [("2024-06-13 09:30", "2024-06-13 09:31"), ("2024-12-13 15:59", "2024-12-13 16:00"), ("2024-03-08 09:30", "2024-03-08 09:31"), ("2024-03-11 09:30", "2024-03-11 09:31")])
def test_labels_are_closes_in_local_time(spark, start, label):
    assert one(spark, ns(start), "long", timeconv.close_label) == dt.datetime.fromisoformat(label)
    assert one(spark, ns(start) // 10**6, "long", timeconv.close_label_ms) == dt.datetime.fromisoformat(label)


def test_us_build_and_rebuild(spark, tmp_path):
    us_file(tmp_path / "a.csv.gz", [("QUX", 140, 20.0, 20.4, 21.0, 19.0, ns("2024-06-13 09:30"), 3), ("LEFT", 12.7, 2, 2, 2, 2, ns("2024-06-13 09:30"), 1), ("ELD", 8, 3, 3, 3, 3, ns("2023-06-13 09:30"), 1), ("QUX", 9, 2, 2, 2, 2, ns("2024-06-13 16:00"), 1)])
    root = str(tmp_path / "db")
    jobs.build_us_bars(spark, str(tmp_path / "a.csv.gz"), root)
    minute = spark.read.parquet(f"{root}/minute")
    assert {(r.symbol, r.ts) for r in bars.read_minute(minute, ["QUX"], "2024-06-13", "2024-06-13", rth_only=False).select("symbol", F.concat_ws(" ", "trade_date", "minute").alias("ts")).collect()} == {("QUX", "2024-06-13 09:31"), ("QUX", "2024-06-13 16:01")}
    daily = {(r.symbol, r.trade_date): r for r in spark.read.parquet(f"{root}/daily").collect()}
    assert daily["QUX", "2024-06-13"].volume == 140 and daily["LEFT", "2024-06-13"].volume == 13 and len(daily) == 3
    us_file(tmp_path / "b.csv.gz", [("QUX", 330, 22.0, 22.6, 23.0, 21.5, ns("2024-06-14 09:30"), 3)])
    tables.write_minute(bars.us_minute(files.read_us_raw(spark, str(tmp_path / "b.csv.gz"))), f"{root}/minute")
    spark.catalog.refreshByPath(f"{root}/minute")
    assert {r.symbol for r in spark.read.parquet(f"{root}/minute").collect()} == {"QUX", "ELD"}
    tables.compact(spark, f"{root}/minute", 2024)
    spark.catalog.refreshByPath(f"{root}/minute")
    assert spark.read.parquet(f"{root}/minute").count() == 2


def test_us_canonical_reads_lazily_and_keeps_regular_hours(spark, tmp_path):
    us_file(tmp_path / "a.csv.gz", [("kel.ws", 2.5, 1, 2, 3, 0.5, ns(f"2024-06-13 {t}"), 1) for t in ("09:29", "09:30", "15:59", "16:00")])
    raw = files.read_us_raw(spark, str(tmp_path / "a.csv.gz"), 2)
    assert [r.minute for r in bars.us_canonical(raw, rth_only=True).orderBy("ts").collect()] == ["09:31", "16:00"]
    assert bars.us_canonical(raw).count() == 4 and bars.us_canonical(raw).first().symbol == "KEL.WS"
    (tmp_path / "c.csv").write_text("ticker,open\nA,1\n")
    with pytest.raises(Exception, match="(?i)header|column"):
        files.read_us_raw(spark, str(tmp_path / "c.csv")).collect()


def test_cn_build(spark, tmp_path):
    rows = ["2024-01-02 09:30:00,sh601234,某甲,7.12,7.12,7.12,7.12,900,640800,0,0", "2024-01-02 09:31:00,sh601234,某甲,7.12,7.15,7.17,7.10,3100,2213400,0,0"]
    (tmp_path / "sh601234_2024.csv").write_text("\n".join([CN_HEADER, *rows]) + "\n", encoding="utf-8-sig")
    old = ["2023-06-01 09:30:00,sz000777,某乙,12,12,12,12,250,2600,0,0", "2023-06-01 15:00:00,sz000777,某乙,12.2,12.1,12.3,12.0,0,4100,0,0"]
    (tmp_path / "sz000777_2023.csv").write_text("\n".join([CN_HEADER, *old]) + "\n", encoding="utf-8-sig")
    (tmp_path / "index").mkdir()
    index = [f"2024-01-02 09:30:00,{c},x,1,2,3,0.5,2.5e8,0,0" for c in ("000905", "399101", "899001")]
    (tmp_path / "index" / "i_2024.csv").write_text("\n".join([CN_HEADER.replace("成交量,", ""), *index]) + "\n", encoding="utf-8-sig")
    root = str(tmp_path / "db")
    jobs.build_cn_bars(spark, {"stock": [str(p) for p in tmp_path.glob("s*.csv")], "index": str(tmp_path / "index" / "i_2024.csv")}, root)
    minute = {(r.symbol, r.ts.minute): r for r in spark.read.parquet(f"{root}/minute").where("symbol = '601234.SH'").collect()}
    assert minute["601234.SH", 31].vwap == pytest.approx(2213400 / 3100, rel=1e-6) and minute["601234.SH", 31].trade_count == 0
    daily = {r.symbol: r for r in spark.read.parquet(f"{root}/daily").collect()}
    assert daily["000905.SH"].volume == 0 and daily["399101.SZ"].amount == 2.5e8 and "899001.BJ" in daily
    assert (daily["000777.SZ"].volume, daily["000777.SZ"].amount) == (250, 6700) and daily["000777.SZ"].close == pytest.approx(12.1)
    listing = {r.symbol: r for r in spark.read.parquet(f"{root}/listing").collect()}
    assert listing["601234.SH"][1:] == ("某甲", "XSHG", "active", "2024-01-02", "")
    assert listing["000777.SZ"][2:] == ("XSHE", "delisted", "2023-06-01", "2023-06-01")
    actions = spark.read.parquet(f"{root}/corp_actions")
    assert actions.count() == 0 and len(actions.columns) == 4
    with pytest.raises(ValueError):
        bars.cn_symbol("fund")


@pytest.mark.parametrize(
    "raw,wanted",
    [(" gull.us ", "GULL"), ("TERN:NASDAQ", "TERN"), ("rail.n", "RAIL"), ("lmn.oq", "LMN"), ("ty.a", "TY.A"), ("OPQ.U", "OPQ.U"), ("rst.ws", "RST.WS"), ("KEL.PR.A", "KEL.PR.A"), (":X", ":X"), (".US", ".US"), ("A.O.N", "A.O"), ("\tx\n", "X"), (None, "")],
)
def test_normalize_symbol(spark, raw, wanted):
    assert one(spark, raw, "string", symbols.normalize_symbol) == wanted


def test_rest_bars(spark):
    start = [ns(f"2024-06-13 {t}") // 10**6 for t in ("09:29", "09:30", "15:59", "16:00")]
    records = spark.createDataFrame([(t, 1.0, 2.0, 0.5, 1.5, 10.0, None, 3) for t in start], schemas.REST_BARS)
    assert bars.rest_bars(records, F.lit(" ab ")).count() == 2 and bars.rest_bars(records, F.lit("ab"), True).count() == 4
    a, b = (bars.rest_bars(records.withColumn("c", F.lit(c)), F.lit("ab"), True) for c in (1.5, 1.6))
    assert tables.detect_restatements(a, a).count() == 0
    assert [r.change for r in tables.detect_restatements(a, b).collect()] == ["restated"]


def test_listing_and_actions(spark):
    tickers = "ticker string, name string, primary_exchange string, active boolean, delisted_utc string"
    records = spark.createDataFrame([("LMN", "Lumen Works", "X", True, None), ("LMN", "Limen Mill", "X", False, "2021-05-01T00:00:00Z"), ("OPQ", "b", None, False, "2022-01-01"), ("RST", "c", "", False, "2020-01-01"), ("RST", "c", "", False, "2024-06-01"), (" ", "none", "", True, None)], tickers)
    listing = {r.symbol: (r.name, r.status, r.delist_date) for r in securities.build_listing(records).collect()}
    assert listing == {"LMN": ("Lumen Works", "active", ""), "OPQ": ("b", "delisted", "2022-01-01"), "RST": ("c", "delisted", "2024-06-01")}
    splits = spark.createDataFrame([("GULL", "2019-03-05", 5.0), ("TERN", "2022-07-19", 2.0), ("TERN", "2022-07-19", 4.0), ("BAD", "2023", 2.0)], schemas.SPLITS)
    dividends = spark.createDataFrame([("GULL", "2019-03-05", 0.3), ("RAIL", "2021-09-02", 0.25), ("RAIL", "2021-09-02", 0.5)], schemas.DIVIDENDS)
    found = {r.symbol: (r.split_ratio, round(r.cash_div, 6)) for r in securities.corporate_actions(splits, dividends).collect()}
    assert found == {"GULL": (5.0, 0.3), "RAIL": (1.0, 0.75), "TERN": (8.0, 0.0)}
    empty = securities.corporate_actions(splits.limit(0), dividends.limit(0))
    assert empty.columns == ["symbol", "ex_date", "split_ratio", "cash_div"] and empty.count() == 0


@pytest.mark.parametrize("listed,pairs", [(["TY.A", "TY.B", "KEL.A", "GULL", "AB", "A.B"], {"TYB": "TY.B", "KELA": "KEL.A", "GULL": "GULL", "NONE": "NONE", "AB": "AB"}), (["A.B", "AB", "X.A", "XA.", "X.B"], {"AB": "AB", "XA": "XA", "XB": "X.B"})])
def test_remap(spark, listed, pairs):
    actions = spark.createDataFrame([(k, "2024-01-01", 2.0) for k in pairs], schemas.SPLITS).withColumn("was", F.col("symbol"))
    found = securities.remap_symbols(actions, spark.createDataFrame([(s,) for s in listed], "symbol string"))
    assert {r.was: r.symbol for r in found.collect()} == pairs


def test_back_adjustment(spark):
    daily = spark.createDataFrame([("A", d, 100.0) for d in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04")], "symbol string, trade_date string, close double")
    actions = spark.createDataFrame([("A", "2024-01-02", 2.0, 0.0), ("A", "2024-01-04", 5.0, 0.0), ("A", "2024-01-03", 1.0, 9.0)], schemas.CORP_ACTIONS)
    found = [r.close_adj for r in securities.adjusted_close(daily, actions).orderBy("trade_date").collect()]
    assert found == [10.0, 20.0, 20.0, 100.0]


def test_manifest_tells_stale_years(spark, tmp_path):
    tables.write_minute(spark.createDataFrame([("A", dt.datetime(y, 1, 2, 9, 31)) for y in (2023, 2024)], "symbol string, ts timestamp_ntz"), str(tmp_path / "m"), 1)
    rows = spark.read.parquet(str(tmp_path / "m")).select("*", "_metadata")
    manifest = tables.input_manifest(rows)
    done = manifest.withColumn("file_size", F.when(F.col("year") == 2024, F.lit(1)).otherwise(F.col("file_size")).cast("long"))
    assert [r.year for r in tables.stale_years(manifest, done).collect()] == [2024]
    assert tables.stale_years(manifest, manifest).count() == 0


def test_actions_of_all_suppliers_and_years(spark, tmp_path):
    day = dt.datetime
    lines = [(7, "R", day(1996, 5, 1), 1, 0.1), (7, "R", day(1994, 5, 1), 1, 0.1), (25, "R", day(1996, 5, 1), 2, 0.1), (25, "A", day(1997, 5, 1), 1, 0.04), (25, "N", day(1997, 6, 1), 1, 0.04)]
    spark.createDataFrame(lines, "l_suppkey long, l_returnflag string, l_shipdate timestamp, l_linenumber int, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, day(1993, 1, 1), 100.0), (7, day(1995, 1, 1), 100.0), (7, day(1997, 1, 1), 100.0), (25, day(1993, 1, 1), 90.0)], "o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    actions = {tuple(r) for r in queries.corp_actions(spark, str(tmp_path)).collect()}
    assert actions == {("S7", "1996-05-01", 2.0, 0.0), ("S7", "1994-05-01", 2.0, 0.0), ("S25", "1996-05-01", 3.0, 0.0), ("S25", "1997-05-01", 1.0, 0.04)}
    adjusted = {(r.symbol, r.trade_date): r.close_adj for r in queries.adjusted_close(spark, str(tmp_path)).collect()}
    assert adjusted == {("S7", "1993-01-01"): 25.0, ("S7", "1995-01-01"): 50.0, ("S7", "1997-01-01"): 100.0, ("S25", "1993-01-01"): 30.0}


def events_file(spark, folder, rows):
    """A table of events (id, minute, user, value) whose rows are stored in this order."""
    start = dt.datetime(2024, 1, 4, 15, 0)
    events = [(i, start + dt.timedelta(minutes=m), user, "click", value) for i, m, user, value in rows]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")


def of_sql(folder, name):
    """Rows of a query's SQL over events in order of event_id, on one thread."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE TABLE events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM read_parquet('{folder}/events.parquet/*.parquet') ORDER BY event_id")
    sql = con.sql(entry.oracle_sql()[name])
    return sql.columns, sorted(sql.limit(10**6).fetchall())


@pytest.mark.parametrize("name,place,values", [("bar_amount", 2, [round(3.65 * 112, 4), round(3.97 * 177, 4)]), ("us_minute", 6, [112, 177])])
def test_halves_of_volumes_follow_the_order_of_events(spark, tmp_path, name, place, values):
    """Added by id the volumes are just above 111.5 and below 177.5; the other way round they are these numbers."""
    rows = [(1, 0, 2, 92.26), (2, 0, 2, 15.59), (3, 0, 2, 3.65), (4, 1, 2, 88.07), (5, 1, 2, 85.46), (6, 1, 2, 3.97)]
    events_file(spark, tmp_path, rows[::-1])
    columns, theirs = of_sql(tmp_path, name)
    ours = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())
    assert ours == theirs and [r[place] for r in ours] == values


def test_codes_that_share_an_index_take_the_first_row_of_a_minute(spark, tmp_path):
    """Users 10,000 apart have one index: of their rows of the first and of the last minute the one of the smaller event_id counts."""
    rows = [(4 * k + place, minute, user, 10.0 * k + place + minute) for k in range(1, 31) for minute in (0, 9) for place, user in enumerate((k, k + 10_000) if k % 3 else (k + 10_000, k))]
    rows = [(i + (1000 if minute else 0), minute, user, value) for i, minute, user, value in rows]
    events_file(spark, tmp_path, rows[::-1])
    columns, theirs = of_sql(tmp_path, "cn_index_daily")
    found = queries.cn_index_daily(spark, str(tmp_path)).select(*columns)
    ours = sorted(tuple(r) for r in found.collect())
    assert ours == theirs and len(ours) == 30
    assert {(r.symbol, r.open, r.close) for r in found.collect()} == {(f"39{k:04}.SZ" if k % 2 == 0 else f"899{k:04}.BJ", 10.0 * k, 10.0 * k + 9) for k in range(1, 31)}


def test_minutes_that_the_clocks_of_a_session_skip(spark, tmp_path):
    """02:00 to 02:59 isn't there on 2024-03-10 in New York; as naive UTC it is, and its events aren't those of 03:00 to 03:59."""
    times = [dt.datetime(1969, 12, 31, 23, 59, 30), *(dt.datetime(2024, 3, 10, h, 30, 5) for h in (1, 2, 3)), *(dt.datetime(2024, 11, 3, h, 30, 5) for h in (5, 6))]
    events = [(i, ts, 2, "click", 10.25 * (i + 1)) for i, ts in enumerate(times)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    columns, theirs = of_sql(tmp_path, "us_minute")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ours = sorted(tuple(r) for r in queries.us_minute(spark, str(tmp_path)).select(*columns).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert ours == theirs and len(ours) == len(times)
