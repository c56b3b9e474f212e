"""Inputs of this library's shapes, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapegrid.functions.timeconv import close_label, from_epoch_micros, local, trade_date
from tapegrid.operators import calendars, markets
from tapegrid.sources import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _micros(ts) -> F.Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _minutes(ts) -> F.Column:
    """Whole minutes of a naive time since 1970, from its parts: date_trunc and timestamp_diff go through the session's zone, and shift an hour that its clocks skip."""
    naive = ts.cast("timestamp_ntz")
    return F.unix_date(naive.cast("date")).cast("long") * 1440 + F.hour(naive) * 60 + F.minute(naive)


def us_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tickers of one-minute bars: events by type and half of the users.

    Volumes are added in order of event_id: another order may put a sum that ends in .5 beside it, and its rounding one off.
    """
    e = table(spark, sf_dir, "events")
    ticker = F.concat("event_type", F.lit("."), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"))
    rows = e.select(ticker.alias("ticker"), _minutes(F.col("ts")).alias("m"), "event_id", "value")
    so_far = Window.partitionBy("ticker", "m").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bars = rows.withColumns({"total": F.sum("value").over(so_far), "nth": F.row_number().over(so_far)}).groupBy("ticker", "m").agg(
        F.max_by("total", "nth").alias("volume"), F.min_by("value", "event_id").alias("open"), F.max_by("value", "event_id").alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("transactions")
    )
    return bars.withColumn("window_start", F.col("m") * 60 * 10**9).drop("m")


def tape(spark: SparkSession, sf_dir: str, market: str = "event_type") -> DataFrame:
    """Trades: an event's value is both price and amount. Markets are event types, or users."""
    e = table(spark, sf_dir, "events")
    cid = F.col(market).cast("string")
    number = F.col("user_id") if market == "user_id" else F.lit(0)
    slug = F.when(number % 3 == 0, "-Red").when(number % 3 == 1, "-widget").otherwise("")
    resolved = F.when(cid == "error", F.lit("2024-01-20 17:00:00").cast("timestamp_ntz"))
    return e.select(
        cid.alias("condition_id"), F.call_function("div", _micros(F.date_trunc("SECOND", "ts").cast("timestamp_ntz")), F.lit(1_000_000)).alias("block_timestamp"), "event_id",
        (F.col("value") / 500).alias("p_event"), F.when(F.col("event_id") % 2 == 0, -1).otherwise(1).alias("D"), F.col("value").alias("usdc_amount"),
        F.concat(F.lit("m"), (number % 10).cast("string"), slug).alias("market_slug"), F.concat(F.lit("cat"), (number % 4).cast("string")).alias("category"), F.concat(F.lit("sub"), (number % 5).cast("string")).alias("category_refined"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("opens_at"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("close_at"), resolved.alias("resolved_at"), F.when(number % 2 == 0, "Yes").otherwise("No").alias("winning_outcome_label"),
    )


def trades(spark: SparkSession, sf_dir: str, market: str = "event_type") -> DataFrame:
    return markets.market_trades(tape(spark, sf_dir, market), tie="event_id")


def days(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """From the day before the first event, which local time may put it on, to the last event's day."""
    ends = table(spark, sf_dir, "events").agg(F.date_sub(F.min("ts"), 1).cast("string").alias("first"), F.to_date(F.max("ts")).cast("string").alias("last")).first()
    return (ends.first, ends.last) if ends.first else ("2000-01-02", "2000-01-01")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.trading_calendar(spark, *days(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str, market: str = "event_type") -> DataFrame:
    return markets.minute_features(trades(spark, sf_dir, market), calendar(spark, sf_dir))


def cn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock rows: a code for each user, a minute's first event as price. first_event orders the rows of one minute as they stand in the table."""
    e = table(spark, sf_dir, "events")
    code = F.concat(F.when(F.col("user_id") % 2 == 0, "sh").otherwise("sz"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    minute = F.date_trunc("MINUTE", "ts").cast("timestamp_ntz")
    rows = e.groupBy(minute.alias("ts"), code.alias("code")).agg(
        F.min_by("value", "event_id").alias("open"), F.max_by("value", "event_id").alias("close"), F.max("value").alias("high"), F.min("value").alias("low"), F.sum(F.floor("value")).cast("double").alias("volume"), F.sum(F.col("value") * 10).alias("amount"), F.min("event_id").alias("first_event")
    )
    return rows.withColumn("name", F.concat(F.lit("N"), F.col("code"), F.date_format("ts", "HH")))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index codes of three number ranges."""
    key = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(key, F.concat(F.lit("39"), key), F.concat(F.lit("899"), key))).alias("code"))


def raw_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    suffix = F.when(k == 0, ".us").when(k == 1, ".N ").when(k == 2, ":NASDAQ").when(k == 3, ".A").when(k == 4, ".OQ").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.substring("p_type", 1, 3), F.col("p_size").cast("string"), suffix).alias("raw"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return rows.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ex_date"), (1 + F.col("l_linenumber") % 3).cast("double").alias("split_ratio"))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    return rows.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ex_date"), F.col("l_discount").alias("cash_div"))


def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".us")).alias("ticker"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("execution_date"), F.when(F.col("l_linenumber") != 2, (F.col("l_linenumber") % 4).cast("double")).alias("split_from"), (F.col("l_quantity") % 5).alias("split_to"))


def ticker_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as active or delisted tickers; every third again, delisted on another day."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    first = c.select(
        F.concat(F.lit("c"), (k % 1000).cast("string"), F.when(k % 5 == 0, ".B").otherwise("")).alias("ticker"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("primary_exchange"),
        (F.col("c_acctbal") >= 0).alias("active"), F.when(F.col("c_acctbal") < 0, F.concat(F.lit("20"), F.lpad((10 + k % 15).cast("string"), 2, "0"), F.lit("-06-01T00:00:00Z"))).alias("delisted_utc"), k.alias("c_custkey"),
    )
    again = first.where("c_custkey % 3 = 0").withColumns({"active": F.lit(False), "delisted_utc": F.lit("2009-01-01T00:00:00Z"), "name": F.concat("name", F.lit(" old"))})
    return first.unionByName(again)


def daily_prices(spark: SparkSession, sf_dir: str, symbols: int | None = 20) -> DataFrame:
    """So many symbols, or one for each customer, with a close on each order date."""
    o = table(spark, sf_dir, "orders")
    number = F.col("o_custkey") if symbols is None else F.col("o_custkey") % symbols
    rows = o.groupBy(F.concat(F.lit("S"), number.cast("string")).alias("symbol"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("trade_date"))
    return rows.agg(F.max("o_totalprice").alias("close"), F.count("*").alias("volume"), F.sum("o_totalprice").alias("amount"))


def rest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = us_raw(spark, sf_dir)
    return raw.select("ticker", F.call_function("div", F.col("window_start"), F.lit(1_000_000)).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("transactions").alias("n"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us_raw(spark, sf_dir).withColumn("ts", close_label(F.col("window_start")))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each event type, with some tens of bars a day."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("trade_date"), F.date_format("ts", "HH:mm").alias("minute"))
    return rows.agg(F.max_by("value", "event_id").alias("close"), F.round(F.avg("value"), 6).alias("vwap"), (F.count("*") * 10).alias("volume"))


#: 364 days in nanoseconds, by which the second half of the tickers lies earlier: the same weekdays of another year.
_BACK = 364 * 86_400 * 10**9


def us_raw_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """us_raw with the .B tickers a year earlier, and the local day on which a bar begins."""
    raw = us_raw(spark, sf_dir)
    start = F.col("window_start") - F.when(F.col("ticker").endswith(".B"), F.lit(_BACK)).otherwise(F.lit(0))
    return raw.withColumn("window_start", start).withColumn("day", trade_date(local(from_epoch_micros(F.call_function("div", F.col("window_start"), F.lit(1000))))))


def land_csv(rows: DataFrame, folder: str, columns: list[str] | None = None) -> None:
    """Adds rows (with their day) to a folder of landed files: a gzip CSV for each day, its date in the path."""
    columns = schemas.US_RAW.names if columns is None else columns
    rows.select("day", *columns).repartition("day").write.mode("append").partitionBy("day").option("header", True).option("compression", "gzip").csv(folder)


def rest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REST aggregates as another vendor would make them from the same events: whole volumes, prices in cents, and errors corrected by leaving out every 97th event."""
    e = table(spark, sf_dir, "events").where("event_id % 97 != 0")
    ticker = F.concat("event_type", F.lit("."), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"))
    cents = lambda c: F.round(c, 1)
    bars = e.groupBy(ticker.alias("ticker"), F.date_trunc("MINUTE", "ts").cast("timestamp_ntz").alias("m")).agg(
        cents(F.min_by("value", "event_id")).alias("o"), cents(F.max("value")).alias("h"), cents(F.min("value")).alias("l"), cents(F.max_by("value", "event_id")).alias("c"), F.rint(F.round(F.sum("value"), 6)).alias("v"), F.round(F.avg("value"), 6).alias("vw"), F.count("*").alias("n")
    )
    return bars.select("ticker", F.call_function("div", _micros(F.col("m")), F.lit(1000)).alias("t"), "o", "h", "l", "c", "v", "vw", "n")


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten symbols that all trade in each minute of a morning: a symbol's events of a day, in order, stand for 09:31, 09:32 and so on, the last ones together at 16:00."""
    e = table(spark, sf_dir, "events").withColumns({"symbol": F.concat("event_type", F.lit("."), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")), "trade_date": F.date_format("ts", "yyyy-MM-dd")})
    nth = F.least(F.row_number().over(Window.partitionBy("symbol", "trade_date").orderBy("event_id")), F.lit(390))
    at = F.lit(570) + nth
    minute = F.concat(F.lpad(F.call_function("div", at, F.lit(60)).cast("string"), 2, "0"), F.lit(":"), F.lpad((at % 60).cast("string"), 2, "0"))
    rows = e.withColumn("minute", minute).groupBy("symbol", "trade_date", "minute")
    return rows.agg(F.max_by("value", "event_id").alias("close"), F.round(F.avg("value"), 6).alias("vwap"), (F.count("*") * 10).alias("volume"))
