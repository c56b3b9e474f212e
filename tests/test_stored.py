import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapegrid.operators import bars, snapshots, tables
from tapegrid.plans import stored
from tapegrid.plans.queries import QUERIES
from tests import test_entry
from tests.test_landing import read_files, scanned_rows


def minute_rows(spark, symbols=40, days=6, years=(2022, 2023, 2024), bump=0.0):
    rows = [(f"S{s:03}", dt.datetime(y, 3, d, 10, m), 1.0 + s + bump, y) for y in years for s in range(symbols) for d in range(1, days + 1) for m in range(10)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close float, year int")
    return df.withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "volume": F.lit(5).cast("long"), "trade_count": F.lit(1).cast("long")})


def test_a_range_is_read_from_its_year_and_row_groups(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "16384")
    try:
        tables.write_minute(minute_rows(spark, 400), f"{tmp_path}/m", files_per_year=2)
    finally:
        conf.unset("parquet.block.size")
    table = spark.read.parquet(f"{tmp_path}/m")
    found = bars.read_minute(table, ["S003", "S017"], "2023-03-02", "2023-03-03")
    plan = found._jdf.queryExecution().executedPlan().toString()
    partition, pushed = plan.split("PartitionFilters: [")[1].split("]")[0], plan.split("PushedFilters: [")[1].split(", ReadSchema")[0]
    assert "year" in partition and "2023" in partition
    assert "In(symbol, [S003,S017])" in pushed and "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    files = [p for p in (tmp_path / "m").rglob("*.parquet")]
    assert read_files(found) == sum("year=2023" in str(p) for p in files) < read_files(table.select("close")) == len(files)
    # Of the year's 24,000 rows only those of some row groups leave the scan.
    assert found.count() == 40 <= scanned_rows(found) < 12_000
    assert found.count() == 2 * 2 * 10 and found.columns == ["trade_date", "minute", "symbol", "open", "high", "low", "close", "volume", "trade_count"]
    assert bars.read_minute(table, None, "2022-03-06", "2023-03-01").count() == 400 * 2 * 10


def test_versions_are_compared_without_unchanged_years(spark, tmp_path):
    table, store = f"{tmp_path}/m", f"{tmp_path}/v"
    tables.write_minute(minute_rows(spark), table, 2)
    assert snapshots.take_snapshot(spark, table, store, 1) == [2022, 2023, 2024]
    assert snapshots.take_snapshot(spark, table, store, 2, since=1) == [] and snapshots.restatements(spark, store, 1, 2).count() == 0
    # One year is written anew: a symbol gone, one restated on a day, one new; and one year as it was.
    year = minute_rows(spark, 6, years=(2023,)).where("symbol != 'S000'")
    year = year.withColumn("low", F.when((F.col("symbol") == "S002") & (F.dayofmonth("ts") == 3) & (F.minute("ts") == 4), F.lit(0.5).cast("float")).otherwise(F.col("low")))
    tables.write_minute(year.unionByName(year.where("symbol = 'S001' AND day(ts) = 1").withColumn("symbol", F.lit("NEW"))), table, 2)
    tables.write_minute(minute_rows(spark, years=(2024,)), table, 2)
    assert snapshots.take_snapshot(spark, table, store, 3, since=2) == [2023, 2024]
    found = {(r.symbol, r.trade_date): (r.old_bars, r.new_bars, r.change) for r in snapshots.restatements(spark, store, 1, 3).collect()}
    assert found.pop(("NEW", "2023-03-01")) == (None, 10, "added") and found.pop(("S002", "2023-03-03")) == (10, 10, "restated")
    assert {k[0] for k in found} == {f"S{k:03}" for k in (0, *range(6, 40))} and set(found.values()) == {(10, None, "removed")} and len(found) == 35 * 6
    comparison = snapshots.restatements(spark, store, 1, 3)
    assert all("/v/bars/version=" in f for f in comparison.inputFiles())
    assert read_files(comparison) == sum("year=2022" not in f for f in comparison.inputFiles())


def test_profile_of_mixed_columns(spark):
    rows = [(1, "é", True, 2.5, [1], dt.datetime(2024, 1, 2)), (2, "", None, float("nan"), None, None), (3, None, False, -1.0, [1, 2, 3], dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "id int, name string, ok boolean, x double, xs array<int>, at timestamp_ntz")
    found = {r.column_name: r for r in tables.column_profile(df, "t").collect()}
    assert [found[c].kind for c in df.columns] == ["whole", "text", "flag", "number", "other", "time"] and {r.n_rows for r in found.values()} == {3}
    assert (found["name"].n_null, found["name"].min_text, found["name"].max_text, found["name"].mean_length) == (1, "", "é", 0.5)
    assert (found["x"].n_null, found["x"].min_number, found["x"].max_number) == (0, -1.0, 2.5) and (found["ok"].min_number, found["ok"].max_number) == (0, 1)
    assert (found["xs"].mean_length, found["xs"].n_null, found["xs"].sample_text) == (2, 1, None) and found["at"].min_time == dt.datetime(2024, 1, 1)
    sample = found["id"].sample_number
    again = {r.column_name: r for r in tables.column_profile(df.repartition(3), "t").collect()}
    assert sample in (1, 2, 3) and again == found
    none = {r.column_name: r for r in tables.column_profile(df.limit(0), "t").collect()}
    assert len(none) == 6 and none["id"].n_rows == 0 and none["id"].min_number is None


@pytest.mark.parametrize("name", list(stored.STORED_SQL))
def test_stored_query_equals_its_sql(spark, name, monkeypatch):
    # The smallest tables have too few events for a cross-section of minutes.
    monkeypatch.setattr(test_entry, "SF", "/root/testdata/sf0.01" if name.startswith("minute_") else "/root/testdata/sf0.001")
    test_entry.test_query_equals_its_sql(spark, name)


def test_queries_are_registered():
    assert set(stored.STORED_SQL) <= set(QUERIES)
