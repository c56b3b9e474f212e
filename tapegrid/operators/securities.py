"""Listings, splits, dividends, corporate actions, and adjusted prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapegrid.functions.symbols import cn_exchange, normalize_symbol
from tapegrid.sources.schemas import CORP_ACTIONS


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def filter_tickers(records: DataFrame, market: str | None = None, active: bool | None = None, date: str | None = None) -> DataFrame:
    """Landed ticker records of a market, state and snapshot."""
    for column, value in (("market", market), ("active", active), ("snapshot_date", date)):
        if value is not None:
            records = records.where(F.col(column) == value)
    return records


def listing_rows(records: DataFrame) -> DataFrame:
    """Ticker records as listing rows; rows without a symbol go."""
    active = F.coalesce(F.col("active"), F.lit(False))
    rows = records.select(
        normalize_symbol(F.col("ticker")).alias("symbol"), _text("name").alias("name"), _text("primary_exchange").alias("exchange"), F.when(active, "active").otherwise("delisted").alias("status"),
        F.lit("").alias("ipo_date"), F.when(active, "").otherwise(F.substring(_text("delisted_utc"), 1, 10)).alias("delist_date"),
    )
    return rows.where("symbol != ''")


def dedup_listing(rows: DataFrame) -> DataFrame:
    """One row per symbol: an active one first, else the latest delisted."""
    best = Window.partitionBy("symbol").orderBy("status", F.desc("delist_date"), "name", "exchange")
    return rows.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def build_listing(active: DataFrame, delisted: DataFrame | None = None) -> DataFrame:
    every = active if delisted is None else active.unionByName(delisted, allowMissingColumns=True)
    return dedup_listing(listing_rows(every))


def between_dates(rows: DataFrame, since: str | None = None, until: str | None = None, ticker: str | None = None, date: str = "ex_date", symbol: str = "symbol") -> DataFrame:
    """Both ends included."""
    if since is not None:
        rows = rows.where(F.col(date) >= since)
    if until is not None:
        rows = rows.where(F.col(date) <= until)
    return rows if ticker is None else rows.where(F.col(symbol) == ticker)


def split_ratio(split_to: Column, split_from: Column) -> Column:
    """New shares for an old one; a null or zero operand counts as 1."""
    one = F.lit(1.0)
    return F.coalesce(F.nullif(split_to, F.lit(0.0)), one) / F.coalesce(F.nullif(split_from, F.lit(0.0)), one)


def splits_from_records(records: DataFrame) -> DataFrame:
    return records.select(normalize_symbol(F.col("ticker")).alias("symbol"), _text("execution_date").alias("ex_date"), split_ratio(F.col("split_to"), F.col("split_from")).alias("split_ratio"))


def dividends_from_records(records: DataFrame) -> DataFrame:
    return records.select(normalize_symbol(F.col("ticker")).alias("symbol"), _text("ex_dividend_date").alias("ex_date"), F.coalesce("cash_amount", F.lit(0.0)).alias("cash_div"))


def corporate_actions(splits: DataFrame, dividends: DataFrame) -> DataFrame:
    """A row for each symbol and ex-date: product of the day's splits, sum of its dividends. Dates of under 8 characters go."""
    valid = F.length("ex_date") >= 8
    s = splits.where(valid).groupBy("symbol", "ex_date").agg(F.product("split_ratio").alias("split_ratio"))
    d = dividends.where(valid).groupBy("symbol", "ex_date").agg(F.sum("cash_div").alias("cash_div"))
    joined = s.join(d, ["symbol", "ex_date"], "full_outer")
    return joined.select("symbol", "ex_date", F.coalesce("split_ratio", F.lit(1.0)).alias("split_ratio"), F.coalesce("cash_div", F.lit(0.0)).alias("cash_div"))


def empty_corporate_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CORP_ACTIONS)


def of_symbols(rows: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Rows of the symbols asked for, of all without a list, of none with an empty one."""
    return rows if symbols is None else rows.where(F.col("symbol").isin(symbols))


def symbol_meta(listing: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """symbol, exchange, name of the listing."""
    return of_symbols(listing, symbols).select("symbol", "exchange", "name")


def remap_symbols(actions: DataFrame, listed: DataFrame) -> DataFrame:
    """actions with class shares under their listed names: BFB becomes BF.B if that is the only dotted symbol so written and BFB isn't listed.

    listed: symbol. Both lookups are joins of the listing's size; nothing is collected.
    """
    names = listed.select("symbol").distinct()
    known = names.select(F.col("symbol").alias("known"))
    plain = F.regexp_replace("symbol", r"\.", "")
    dotted = names.where(F.col("symbol").contains(".")).groupBy(plain.alias("plain")).agg(F.count("*").alias("n"), F.min("symbol").alias("native")).where("n = 1").drop("n")
    joined = actions.join(known, actions["symbol"] == F.col("known"), "left").join(dotted, actions["symbol"] == F.col("plain"), "left")
    new = F.when(F.col("known").isNull() & F.col("native").isNotNull(), F.col("native")).otherwise(actions["symbol"])
    return joined.withColumn("symbol", new).select(*actions.columns)


def listing_report(listing: DataFrame) -> DataFrame:
    return listing.agg(
        F.count("*").alias("n_listed"), F.count_if(F.col("status") == "active").alias("n_active"), F.count_if(F.col("status") == "delisted").alias("n_delisted"), F.count_if(F.col("symbol").contains(".")).alias("n_dotted")
    )


def names_by_year(raw: DataFrame) -> DataFrame:
    """symbol, year, name: the first row's name in each year; '' if it has none. raw: symbol, name, ts, and file_year if it comes from files."""
    year = F.coalesce("file_year", F.year("ts")) if "file_year" in raw.columns else F.year("ts")
    return raw.groupBy("symbol", year.alias("year")).agg(F.min_by(F.coalesce("name", F.lit("")), "ts").alias("name"))


def latest_names(raw: DataFrame) -> DataFrame:
    """symbol, name: the first row's name in each symbol's latest year."""
    return names_by_year(raw).groupBy("symbol").agg(F.max_by("name", "year").alias("name"))


def cn_listing(daily: DataFrame, names: DataFrame, active: DataFrame) -> DataFrame:
    """Listing from what has traded: active are the given symbols; others left on their last day."""
    span = daily.groupBy("symbol").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    alive = active.select(F.col("symbol").alias("alive")).distinct()
    rows = names.join(span, "symbol", "left").join(alive, F.col("symbol") == F.col("alive"), "left")
    is_alive = F.col("alive").isNotNull()
    return rows.select(
        "symbol", F.coalesce("name", F.lit("")).alias("name"), cn_exchange(F.col("symbol")).alias("exchange"), F.when(is_alive, "active").otherwise("delisted").alias("status"),
        F.coalesce("first_date", F.lit("")).alias("ipo_date"), F.when(is_alive, "").otherwise(F.coalesce("last_date", F.lit(""))).alias("delist_date"),
    )


def adjusted_close(daily: DataFrame, actions: DataFrame) -> DataFrame:
    """symbol, trade_date, close, close_adj: divided by all splits whose ex-date is later than the day.

    Splits and days of a symbol meet in one running product, from the latest date on,
    so that the cost is one sort of the daily table and not days times splits.
    """
    splits = actions.where("split_ratio != 1.0").select("symbol", F.col("ex_date").alias("day"), F.lit(None).cast("double").alias("close"), F.col("split_ratio").alias("ratio"), F.lit(False).alias("is_bar"))
    days = daily.select("symbol", F.col("trade_date").alias("day"), F.col("close").cast("double").alias("close"), F.lit(1.0).alias("ratio"), F.lit(True).alias("is_bar"))
    later = Window.partitionBy("symbol").orderBy(F.desc("day")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same_day = Window.partitionBy("symbol", "day")
    summed = days.unionByName(splits).withColumn("later_ratio", F.try_divide(F.product("ratio").over(later), F.product("ratio").over(same_day)))
    return summed.where("is_bar").select("symbol", F.col("day").alias("trade_date"), "close", F.try_divide("close", "later_ratio").alias("close_adj"))
