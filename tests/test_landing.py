import gzip

import pytest
from pyspark.sql import functions as F

from tapegrid.operators import calendars, tables
from tapegrid.plans import jobs
from tapegrid.sources import files, landing, schemas

US = ["ticker", "volume", "open", "close", "high", "low", "window_start", "transactions"]
#: 09:30 in New York on these days, in nanoseconds.
START = {"2023-06-13": 1686663000, "2023-06-14": 1686749400, "2024-06-13": 1718285400, "2024-06-14": 1718371800}


def land(folder, day, rows, header=US, name="{}.csv.gz"):
    lines = [",".join(header), *(",".join(str(r.get(c, "")) for c in header) for r in rows)]
    path = folder / name.format(day)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(("\n".join(lines) + "\n").encode("utf-8-sig" if len(header) > 8 else "utf-8")))
    return path


def bar(day, ticker="A", price=10.0, minute=0, **more):
    return {"ticker": ticker, "volume": 5, "open": price, "close": price, "high": price, "low": price, "window_start": (START[day] + 60 * minute) * 10**9, "transactions": 2} | more


def scan_metric(df, name):
    """The sum of a metric over the file scans of df's plan, after it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.metrics().contains("numFiles"):
            found += node.metrics().apply(name).value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def read_files(df):
    return scan_metric(df, "numFiles")


def scanned_rows(df):
    return scan_metric(df, "numOutputRows")


def test_days_and_years_of_paths(spark):
    paths = ["/a/2023-01-01-dump/2024-05-06.csv.gz", "/day=2024-05-06/part-0.csv", "/x/sh600000_2022.csv", "/x/none.csv", "/x/12024-05-06.csv"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(landing.file_day(F.col("p")).alias("day"), landing.file_year(F.col("p")).alias("year")).collect()
    assert [tuple(r) for r in rows] == [("2024-05-06", 2024), ("2024-05-06", 2024), (None, 2022), (None, None), (None, None)]


def test_files_of_other_years_are_not_opened(spark, tmp_path):
    for day in START:
        land(tmp_path, day, [bar(day)])
    raw = files.read_us_raw(spark, str(tmp_path), years=[2024])
    assert {r.file_year for r in raw.collect()} == {2024} and raw.count() == 2
    everything = spark.read.schema(schemas.US_RAW).option("header", True).csv(str(tmp_path)).withColumn("file_year", landing.file_year(F.col("_metadata.file_path")))
    assert read_files(everything.where("file_year = 2024")) == 2 and read_files(everything) == 4


def test_a_changed_file_rebuilds_its_year_alone(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "db")
    for day in START:
        land(landed, day, [bar(day), bar(day, "GONE", 3.0)])
    assert jobs.build_us_bars(spark, str(landed), root) == [2023, 2024]
    stamps = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "db").rglob("*.parquet")}
    first = stamps()
    assert jobs.build_us_bars(spark, str(landed), root) == [] and stamps() == first
    land(landed, "2024-06-13", [bar("2024-06-13", price=11.5), bar("2024-06-13", price=12.5, minute=1)])
    land(landed, "2024-06-14", [bar("2024-06-14", "a.b", 4.0)])
    assert jobs.build_us_bars(spark, str(landed), root) == [2024]
    assert {p: t for p, t in first.items() if "year=2023" in str(p)} == {p: t for p, t in stamps().items() if "year=2023" in str(p)}
    minute, daily = spark.read.parquet(f"{root}/minute"), spark.read.parquet(f"{root}/daily")
    assert {(r.symbol, r.year) for r in minute.collect()} == {("A", 2023), ("GONE", 2023), ("A", 2024), ("A.B", 2024)}
    assert {(r.symbol, r.trade_date, r.close) for r in daily.where("year = 2024").collect()} == {("A", "2024-06-13", 12.5), ("A.B", "2024-06-14", 4.0)}
    notes = tables.stored_manifest(spark, f"{root}/manifest").collect()
    assert {(r.file_name[:10], r.build) for r in notes} == {("2023-06-13", 1), ("2023-06-14", 1), ("2024-06-13", 2), ("2024-06-14", 2)}
    (landed / "2024-06-14.csv.gz").unlink()
    assert jobs.build_us_bars(spark, str(landed), root) == [2024]
    assert {r.symbol for r in spark.read.parquet(f"{root}/minute").where("year = 2024").collect()} == {"A"}
    assert jobs.build_us_bars(spark, str(landed), root, skip_done=False) == [2023, 2024]
    for p in landed.glob("2023*"):
        p.unlink()
    assert jobs.build_us_bars(spark, str(landed), root) == [] and spark.read.parquet(f"{root}/daily").where("year = 2023").count() == 4


def test_a_build_that_fails_is_done_again(spark, tmp_path, monkeypatch):
    landed, root = tmp_path / "landed", str(tmp_path / "db")
    land(landed, "2024-06-13", [bar("2024-06-13")])
    with monkeypatch.context() as m:
        m.setattr(tables, "write_daily", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.build_us_bars(spark, str(landed), root)
    assert jobs.build_us_bars(spark, str(landed), root) == [2024] and spark.read.parquet(f"{root}/daily").count() == 1


def test_cn_kinds_and_years_are_rebuilt_apart(spark, tmp_path):
    header = "时间,代码,名称,开盘价,收盘价,最高价,最低价,成交量,成交额,涨幅,振幅".split(",")
    row = lambda year, code, name, minute=31: dict(zip(header, [f"{year}-03-04 09:{minute}:00", code, name, 1, 2, 3, 0.5, 10, 20, 0, 0], strict=True))
    for year in (2022, 2023):
        land(tmp_path / "s", year, [row(year, "sh600001", f"n{year}")], header, "sh600001_{}.csv.gz")
        land(tmp_path / "i", year, [row(year, "000300", "idx")], [c for c in header if c != "成交量"], "000300_{}.csv.gz")
    sources, root = {"stock": str(tmp_path / "s"), "index": str(tmp_path / "i")}, str(tmp_path / "db")
    assert jobs.build_cn_bars(spark, sources, root) == [("index", 2022), ("index", 2023), ("stock", 2022), ("stock", 2023)]
    assert jobs.build_cn_bars(spark, sources, root) == []
    land(tmp_path / "s", 2023, [row(2023, "sz000002", "new"), row(2023, "sz000002", "later", 32)], header, "sz000002_{}.csv.gz")
    assert jobs.build_cn_bars(spark, sources, root) == [("stock", 2023)]
    listing = {r.symbol: (r.name, r.status) for r in spark.read.parquet(f"{root}/listing").collect()}
    assert listing == {"600001.SH": ("n2023", "active"), "000002.SZ": ("new", "active"), "000300.SH": ("idx", "active")}
    assert spark.read.parquet(f"{root}/daily").where("kind = 'index'").count() == 2
    assert jobs.build_cn_bars(spark, sources, root, years=[2022], skip_done=False) == [("index", 2022), ("stock", 2022)]


def test_headers_of_different_order_and_extent(spark, tmp_path):
    land(tmp_path, "2023-06-13", [bar("2023-06-13", "USUAL", 1.0)])
    land(tmp_path, "2023-06-14", [bar("2023-06-14", "TURNED", 2.0)], US[::-1])
    land(tmp_path, "2024-06-13", [bar("2024-06-13", "FEWER", 3.0)], ["ticker", "close", "window_start"])
    land(tmp_path, "2024-06-14", [bar("2024-06-14", "MORE", 4.0, otc="T", note='"a, b"')], [*US, "otc", "note"])
    (tmp_path / "2024-06-15.csv.gz").write_bytes(b"")
    raw = files.read_us_raw(spark, str(tmp_path))
    assert raw.columns == [*US, "otc", "note", "file_year"] and raw.schema["volume"].dataType.simpleString() == "double"
    found = {r.ticker: r for r in raw.collect()}
    assert {t: (r.close, r.open, r.volume, r.transactions, r.file_year) for t, r in found.items()} == {"USUAL": (1, 1, 5, 2, 2023), "TURNED": (2, 2, 5, 2, 2023), "FEWER": (3, None, None, None, 2024), "MORE": (4, 4, 5, 2, 2024)}
    assert (found["MORE"].otc, found["MORE"].note, found["USUAL"].otc) == ("T", "a, b", None)
    assert landing.headers(spark, str(tmp_path), ("ticker", "window_start")).count() == 4
    (tmp_path / "2024-06-16.csv.gz").write_bytes(gzip.compress(b"A,1,2\n"))
    with pytest.raises(ValueError, match="no header"):
        files.read_us_raw(spark, str(tmp_path))


def test_paths_with_signs_and_spaces(spark, tmp_path):
    folder = tmp_path / "a b" / "100% 数+x"
    land(folder, "2024-06-13", [bar("2024-06-13", "A")], name="{} x#1.csv.gz")
    land(folder, "2023-06-13", [bar("2023-06-13", "B")], US[::-1], "{}+y.csv.gz")
    assert {(r.ticker, r.file_year) for r in files.read_us_raw(spark, str(tmp_path / "a b")).collect()} == {("A", 2024), ("B", 2023)}
    assert jobs.build_us_bars(spark, str(tmp_path / "a b"), str(tmp_path / "db 1")) == [2023, 2024] and jobs.build_us_bars(spark, str(tmp_path / "a b"), str(tmp_path / "db 1")) == []
    (folder / "2024-06-14.csv.gz").write_bytes(gzip.compress(b"no,header\n"))
    with pytest.raises(ValueError, match="2024-06-14"):
        files.read_us_raw(spark, str(tmp_path / "a b"))


def test_files_against_the_calendar(spark, tmp_path):
    calendar = calendars.trading_calendar(spark, "2024-06-12", "2024-06-20")
    for day in ("2024-06-12", "2024-06-13", "2024-06-15", "2024-06-19"):
        (tmp_path / f"{day}.csv.gz").write_bytes(b"x" * 90)
    (tmp_path / "2024-06-14.csv.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "2024-06-17.csv.gz").write_bytes(b"")
    listing = landing.landed_files(spark, str(tmp_path))
    assert listing.agg(F.sum("file_size")).first()[0] == 4 * 90 + 20
    found = {(r.day, r.state) for r in calendars.file_audit(calendar, listing).collect()}
    assert found == {("2024-06-14", "empty"), ("2024-06-15", "surplus"), ("2024-06-17", "missing"), ("2024-06-18", "missing"), ("2024-06-19", "surplus"), ("2024-06-20", "missing")}
    assert sorted(r.file_name[:10] for r in calendars.files_of_days(calendar, listing).collect()) == ["2024-06-12", "2024-06-13"]
    none = landing.landed_files(spark, str(tmp_path / "absent"))
    assert none.count() == 0 and calendars.file_audit(calendar, none).where("state = 'missing'").count() == 6
