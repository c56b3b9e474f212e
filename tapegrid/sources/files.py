"""Readers of landed files. Each reads all symbols and days at once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapegrid.sources import schemas
from tapegrid.sources.landing import read_by_name

LIFECYCLE = ("preparations", "splits", "merges", "resolutions", "redemptions")


def read_us_raw(spark: SparkSession, paths: str | list[str], partitions: int | None = None, years: list[int] | None = None) -> DataFrame:
    """Daily gzip files of all tickers, columns met by name, and the year in each file's name. A gzip file is one task; `partitions` deals its rows out afterwards."""
    rows = read_by_name(spark, paths, schemas.US_RAW, ("ticker", "window_start"), years)
    return rows.repartition(partitions) if partitions else rows


def read_cn_raw(spark: SparkSession, paths: str | list[str], kind: str, years: list[int] | None = None) -> DataFrame:
    """Files of stocks or indexes, with English column names and the year of the file's name. Index files have no volume."""
    if kind not in ("stock", "index"):
        raise ValueError(f"kind must be 'stock' or 'index', not {kind!r}")
    rows = read_by_name(spark, paths, schemas.CN_STOCK_RAW if kind == "stock" else schemas.CN_INDEX_RAW, schemas.CN_KEYS, years)
    renamed = rows.withColumnsRenamed({k: v for k, v in schemas.CN_NAMES.items() if k in rows.columns})
    return renamed.withColumn("volume", F.coalesce("volume", F.lit(0.0)) if "volume" in renamed.columns and kind == "stock" else F.lit(0.0))


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_lifecycle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Those of the five lifecycle tables that exist."""
    found = {name: _existing(spark, f"{root.rstrip('/')}/{name}") for name in LIFECYCLE}
    return {name: rows for name, rows in found.items() if rows is not None}


def read_corp_actions(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """Corporate actions of some or all symbols; none where there is no such table."""
    rows = _existing(spark, path)
    rows = spark.createDataFrame([], schemas.CORP_ACTIONS) if rows is None else rows
    return rows if symbols is None else rows.where(F.col("symbol").isin(symbols))


def read_rest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Landed REST records, one JSON object a line."""
    return spark.read.schema(schema).json(path)


def of_years(rows: DataFrame, years: list[int], column: str = "file_year") -> DataFrame:
    return rows.where(F.col(column).isin(years))
