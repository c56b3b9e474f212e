"""Whole jobs: from landed files to tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.operators import bars, calendars, markets, securities, tables
from tapegrid.sources import files, landing, schemas


def _rebuild(spark: SparkSession, listing: DataFrame, done_path: str, keys: tuple[str, ...], skip_done: bool, build: Callable[[list], None]) -> list:
    """Runs build for the parts (by keys) whose files aren't those of the last build, and notes the files; the parts.

    Parts whose files are all gone keep their rows. The manifest, a row a file, stays
    in Spark; a row a part comes to the driver.
    """
    done = tables.stored_manifest(spark, done_path, keys)
    parts = listing.select(*keys).distinct()
    stale = parts.join(tables.stale_years(listing, done, keys), list(keys), "left_semi") if skip_done else parts
    found = sorted(tuple(r) for r in stale.collect())
    if found:
        number = 1 + (done.agg(F.max("build")).first()[0] or 0)
        build(found)
        tables.store_manifest(listing.join(F.broadcast(spark.createDataFrame(found, listing.select(*keys).schema)), list(keys), "left_semi"), done_path, number, keys)
    return found


def build_us_bars(spark: SparkSession, paths: str | list[str], root: str, files_per_year: int = 8, skip_done: bool = True) -> list[int]:
    """Minute and daily tables of the years whose files in paths are new, changed or fewer since the last build; these years.

    A year is replaced whole in both tables, from its files alone; other years' files
    aren't opened. paths name all files of a year. Files without a date in their path
    can't be told apart by year: if there are any, every file is read, and rows go by
    their own year. skip_done=False builds all years anew.
    """
    listing = landing.landed_files(spark, paths)

    def build(years: list[int] | None) -> None:
        raw = files.read_us_raw(spark, paths, years=years)
        tables.write_minute(bars.us_minute(raw), f"{root}/minute", files_per_year)
        tables.write_daily(bars.us_daily(raw), f"{root}/daily")

    if not listing.where(landing.file_year(F.col("file_path")).isNull()).isEmpty():
        build(None)
        return sorted(r.year for r in spark.read.parquet(f"{root}/daily").select("year").distinct().collect())
    return [year for (year,) in _rebuild(spark, tables.file_manifest(listing), f"{root}/manifest", ("year",), skip_done, lambda parts: build([year for (year,) in parts]))]


def build_cn_bars(spark: SparkSession, sources: dict[str, str | list[str]], root: str, years: list[int] | None = None, files_per_year: int = 8, skip_done: bool = True) -> list[tuple[str, int]]:
    """Minute and daily tables, listing and the empty corporate actions, from stock and index files ({'stock': paths, 'index': paths}).

    Kinds and years whose files are those of the last build are passed over, as in
    build_us_bars; the listing is made anew from the daily table and the names, which
    have a row a symbol and year. Returns what was built: (kind, year).
    """
    keys = ("kind", "year")
    listing = reduce(DataFrame.unionByName, [tables.file_manifest(landing.landed_files(spark, paths)).withColumn("kind", F.lit(kind)) for kind, paths in sources.items()])
    if years is not None:
        listing = files.of_years(listing, years, "year")

    def build(parts: list[tuple[str, int]]) -> None:
        raw = {kind: files.read_cn_raw(spark, sources[kind], kind, own) for kind in sources if (own := [y for k, y in parts if k == kind])}
        with_kind = lambda make: reduce(bars.cn_union, [make(rows, kind).withColumn("kind", F.lit(kind)) for kind, rows in raw.items()])
        tables.write_minute(with_kind(bars.cn_minute), f"{root}/minute", files_per_year, keys)
        tables.write_daily(with_kind(bars.cn_daily), f"{root}/daily", keys)
        names = with_kind(lambda rows, kind: securities.names_by_year(rows.withColumn("symbol", bars.cn_symbol(kind))))
        names.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{root}/names")

    built = _rebuild(spark, listing, f"{root}/manifest", keys, skip_done, build)
    if built:
        names = spark.read.parquet(f"{root}/names")
        last = names.agg(F.max("year").alias("last_year"))  # one row
        active = names.join(F.broadcast(last), F.col("year") == F.col("last_year"), "left_semi").select("symbol").distinct()
        latest = names.groupBy("symbol").agg(F.max_by("name", "year").alias("name"))
        tables.write_whole(securities.cn_listing(spark.read.parquet(f"{root}/daily"), latest, active), f"{root}/listing")
        securities.empty_corporate_actions(spark).write.mode("overwrite").parquet(f"{root}/corp_actions")
    return built


def build_reference(spark: SparkSession, landing: str, root: str, since: str | None = None) -> None:
    """Listing, splits, dividends and corporate actions from landed REST records."""
    records = files.read_rest(spark, f"{landing}/tickers", schemas.REST_TICKERS)
    tables.write_whole(securities.build_listing(records), f"{root}/listing")
    listed = spark.read.parquet(f"{root}/listing")
    splits = securities.splits_from_records(files.read_rest(spark, f"{landing}/splits", schemas.REST_SPLITS))
    dividends = securities.dividends_from_records(files.read_rest(spark, f"{landing}/dividends", schemas.REST_DIVIDENDS))
    splits = securities.remap_symbols(securities.between_dates(splits, since), listed)
    dividends = securities.remap_symbols(securities.between_dates(dividends, since), listed)
    tables.write_whole(splits, f"{root}/splits")
    tables.write_whole(dividends, f"{root}/dividends")
    tables.write_whole(securities.corporate_actions(splits, dividends), f"{root}/corp_actions", ["symbol", "ex_date"])


def build_feature_panel(spark: SparkSession, tape: DataFrame, themes: dict[str, list[str]], start: str, end: str, min_usdc: float = 50_000.0, per_theme: int = 1, catalog: DataFrame | None = None) -> DataFrame:
    """Catalog, the themes' markets, their features in one job, and the panel.

    The tape is read twice: for the catalog, unless one is given, and for the trades of
    the chosen markets. These few are settled in between, so that their ids are part
    of the second scan.
    """
    catalog = markets.market_catalog(tape, min_usdc) if catalog is None else catalog
    chosen = markets.theme_markets(catalog, themes, per_theme)
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # at most per_theme for each theme
    ids = sorted({r.condition_id for r in chosen.collect()})
    trades = markets.market_trades(tape.where(F.col("condition_id").isin(ids)), tie="event_id" if "event_id" in tape.columns else None)
    calendar = calendars.trading_calendar(spark, start, end)
    return markets.feature_panel(markets.minute_features(trades, calendar), chosen, markets.markets_on(chosen, calendar))


def build_market_tables(spark: SparkSession, tape: DataFrame, root: str, themes: dict[str, list[str]], start: str, end: str, min_usdc: float = 50_000.0, per_theme: int = 1) -> None:
    """The catalog, most traded markets first, and the feature panel in order of time, as tables."""
    tables.write_whole(markets.market_catalog(tape, min_usdc), f"{root}/catalog", [F.desc("total_usdc"), "condition_id"])
    panel = build_feature_panel(spark, tape, themes, start, end, min_usdc, per_theme, spark.read.parquet(f"{root}/catalog"))
    tables.write_whole(panel, f"{root}/panel", ["trade_date", "minute"])


def profile_tables(spark: SparkSession, found: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [tables.profile_table(rows, name) for name, rows in found.items()])
