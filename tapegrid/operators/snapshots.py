"""Versions of a bar table by their fingerprints, kept beside it and compared without its bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.operators.tables import change_of, content_fingerprint
from tapegrid.sources.landing import landed_files

_YEAR = r"/year=(\d+)/"


def _listing(spark: SparkSession, table: str) -> DataFrame:
    files = landed_files(spark, table).where(F.col("file_name").endswith(".parquet"))
    return files.select(F.regexp_extract("file_path", _YEAR, 1).cast("int").alias("year"), "file_name", "file_size").where("year IS NOT NULL")


def _changed(new: DataFrame, old: DataFrame) -> DataFrame:
    key = ["year", "file_name", "file_size"]
    return new.join(old, key, "left_anti").select("year").unionByName(old.join(new, key, "left_anti").select("year")).distinct()


def take_snapshot(spark: SparkSession, table: str, store: str, version: int, since: int | None = None) -> list[int]:
    """Keeps the fingerprints of a minute table (in folders by year) as a version; the years whose bars were read.

    store gets files/version=v (year, file_name, file_size) and bars/version=v/year=y
    (symbol, trade_date, n_bars, digest). With the version `since`, years whose files
    are still those of it take its fingerprints over, and their bars aren't read.
    Spark's writers give each file a name of its own, so a file that was written anew
    never passes for the old one.
    """
    listing = _listing(spark, table)
    years = [r.year for r in listing.select("year").distinct().collect()]  # a row a year
    fresh = years
    if since is not None:
        changed = {r.year for r in _changed(listing, spark.read.parquet(f"{store}/files/version={since}")).collect()}
        fresh = [y for y in years if y in changed]
    rows = spark.read.parquet(table).where(F.col("year").isin(fresh))
    prints = content_fingerprint(rows, by=("year",))
    kept = [y for y in years if y not in fresh]
    if kept:
        prints = prints.unionByName(spark.read.parquet(f"{store}/bars/version={since}").where(F.col("year").isin(kept)))
    prints.repartition("year").write.mode("overwrite").partitionBy("year").parquet(f"{store}/bars/version={version}")
    listing.coalesce(1).write.mode("overwrite").parquet(f"{store}/files/version={version}")
    return sorted(fresh)


def restatements(spark: SparkSession, store: str, old: int, new: int) -> DataFrame:
    """symbol, trade_date, old_bars, new_bars, change between two versions; fingerprints of years with other files alone are read, and no bars."""
    files = [spark.read.parquet(f"{store}/files/version={v}") for v in (old, new)]
    years = [r.year for r in _changed(*files).collect()]  # a row a year
    a, b = (spark.read.parquet(f"{store}/bars/version={v}").where(F.col("year").isin(years)).drop("year") for v in (old, new))
    return change_of(a, b)
