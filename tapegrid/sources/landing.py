"""Landed files as rows: what is there, which header each has, and CSV files of different headers in one read."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

LISTING = "file_path string, file_name string, file_size long, modified timestamp"
#: A date in a file's path, or a year at the end of its name.
DATE, YEAR = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{4})\.csv"


def file_day(path: Column) -> Column:
    """The last date (yyyy-mm-dd) in a path; null if there is none."""
    day = F.regexp_extract(path, rf"^.*(?<!\d){DATE}", 0)
    return F.when(day != "", F.right(day, F.lit(10)))


def file_year(path: Column) -> Column:
    """The year of the last date in a path, or that before .csv; null if there is neither."""
    year = F.coalesce(F.substring(file_day(path), 1, 4), F.nullif(F.regexp_extract(path, YEAR, 1), F.lit("")))
    return year.cast("int")


def landed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file_path, file_name, file_size, modified of the files in and under paths, without opening any. No such path: no rows."""
    try:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LISTING)
    return rows.select(F.col("path").alias("file_path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def _of_years(rows: DataFrame, years: list[int] | None) -> DataFrame:
    # Spark evaluates a condition on a file's metadata when it plans the scan, so other files aren't opened.
    return rows if years is None else rows.where(file_year(F.col("_metadata.file_path")).isin(years))


def headers(spark: SparkSession, paths: str | list[str], required: tuple[str, ...], years: list[int] | None = None) -> DataFrame:
    """file_path (as Spark's metadata has it, with signs in % notation), header: each file's first line that has the required names.

    The lines are read as text in one pass over all files.
    """
    lines = _of_years(spark.read.option("recursiveFileLookup", True).text(paths), years).select("value", F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("at"))
    named = reduce(lambda a, b: a & b, [F.col("value").contains(name) for name in required])
    return lines.where(named).groupBy("file_path").agg(F.min_by("value", "at").alias("header"))


def _schema(header: str, known: StructType, required: tuple[str, ...]) -> StructType:
    """The columns of a header in its order: known ones with their types, others as text."""
    names = [name.strip() for name in next(csv.reader([header.lstrip("﻿")]))]
    if lacking := [name for name in required if name not in names]:
        raise ValueError(f"a header lacks the column {lacking[0]!r}: {header!r}")
    kinds = {f.name: f.dataType for f in known}
    return StructType([StructField(name, kinds.get(name, StringType())) for name in names])


def read_by_name(spark: SparkSession, paths: str | list[str], known: StructType, required: tuple[str, ...], years: list[int] | None = None) -> DataFrame:
    """CSV files with headers of any order and extent in one table: the known columns, null where a file lacks them, then others as text; and file_year.

    Files are read in groups of one header, each under a schema of its own, and the
    groups are united by name. The files' names come to the driver, where Spark's
    own listing holds them too. A file without the required columns is an error;
    one without any line is passed over. years: only files of these are opened.
    """
    groups = headers(spark, paths, required, years).groupBy("header").agg(F.collect_list("file_path").alias("files")).orderBy("header").collect()
    listing = landed_files(spark, paths).where("file_size > 0")
    wanted = listing if years is None else listing.where(file_year(F.col("file_path")).isin(years))
    met = {_same(unquote(f)) for g in groups for f in g.files}
    without = [r.file_path for r in wanted.select("file_path").toLocalIterator() if _same(r.file_path) not in met] if wanted.count() > len(met) else []
    if without and not spark.read.text(without).isEmpty():
        raise ValueError(f"no header with the columns {', '.join(required)} in {without[0]}")
    parts = []
    for g in groups:
        rows = spark.read.schema(_schema(g.header, known, required)).option("header", True).csv([unquote(f) for f in g.files])
        parts.append(rows.withColumn("file_year", file_year(F.col("_metadata.file_path"))))
    parts.append(spark.createDataFrame([], StructType([*known.fields]).add("file_year", IntegerType())))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    others = [c for c in every.columns if c not in known.names and c != "file_year"]
    return every.select(*known.names, *others, "file_year")


def _same(path: str) -> str:
    """A file's path in one spelling: with one slash or three after the scheme."""
    scheme, found, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if found else path
