"""Minute and daily bars of both markets, for all symbols in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.functions.symbols import cn_index_symbol, cn_stock_symbol
from tapegrid.functions.timeconv import close_label, close_label_ms, is_regular, minute, trade_date

US_SOURCE, CN_SOURCE = "massive", "cn_csv"
_PRICES = ("open", "high", "low", "close")


def us_canonical(raw: DataFrame, rth_only: bool = False) -> DataFrame:
    """Raw US rows as labelled bars: symbol, trade_date, minute, ts, prices and volumes."""
    ts = close_label(F.col("window_start"))
    rows = raw.withColumn("ts", ts).select(
        F.upper("ticker").alias("symbol"), trade_date(F.col("ts")).alias("trade_date"), minute(F.col("ts")).alias("minute"), "ts",
        *[F.col(c).cast("double").alias(c) for c in _PRICES], F.rint("volume").cast("long").alias("volume"), F.col("transactions").cast("long").alias("trade_count"),
    )
    return rows.where(is_regular(F.col("minute"))) if rth_only else rows


def _provenance(source: str) -> list[Column]:
    return [F.lit(source).alias("source"), F.lit("").alias("ingested_utc"), F.lit("").alias("raw_hash")]


def _file_year(raw: DataFrame, ts: Column) -> list[Column]:
    """The year of a row's file, by which tables are replaced, where rows come from files; that of its time for files without one."""
    return [F.coalesce("file_year", F.year(ts)).cast("int").alias("year")] if "file_year" in raw.columns else []


def us_minute(raw: DataFrame) -> DataFrame:
    """Raw US rows as the stored minute table; with the year of its file if they have one."""
    return raw.select(
        F.upper("ticker").alias("symbol"), close_label(F.col("window_start")).alias("ts"),
        *[F.col(c).cast("float").alias(c) for c in _PRICES], F.round("volume").cast("long").alias("volume"), F.col("transactions").cast("long").alias("trade_count"),
        *_provenance(US_SOURCE), *_file_year(raw, close_label(F.col("window_start"))),
    )


def _daily(bars: DataFrame, amount: Column, volume: Column, source: str, tie: str | None = None) -> DataFrame:
    """bars: symbol, trade_date, ts, prices. First and last skip null prices; of rows of the same time the one of the smallest tie, if given, is taken for both."""

    def edge(pick, column: str) -> Column:
        at = F.col("ts")
        if tie:
            at = F.struct("ts", F.col(tie) if pick is F.min_by else -F.col(tie))
        return pick(column, F.when(F.col(column).isNotNull(), at))

    year = [F.max("year").alias("year")] if "year" in bars.columns else []
    return bars.groupBy("symbol", "trade_date").agg(
        edge(F.min_by, "open").cast("float").alias("open"), F.max("high").cast("float").alias("high"), F.min("low").cast("float").alias("low"), edge(F.max_by, "close").cast("float").alias("close"),
        volume.alias("volume"), amount.cast("double").alias("amount"), F.lit(source).alias("source"), *year,
    )


def _whole(total: Column) -> Column:
    """A sum to the nearest whole number, halves to the even one; noise of the order of adding goes first."""
    return F.rint(F.round(total, 6)).cast("long")


def us_daily(raw: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Daily bars over regular hours, from raw rows: the sum of volumes is rounded, not each.

    With a calendar, bars after an early close are left out; without, the day ends at 16:00.
    """
    ts = close_label(F.col("window_start"))
    rows = raw.select(F.upper("ticker").alias("symbol"), ts.alias("ts"), *_PRICES, "volume", *_file_year(raw, ts)).withColumn("trade_date", trade_date(F.col("ts"))).where(is_regular(minute(F.col("ts"))))
    if calendar is not None:
        rows = rows.join(F.broadcast(calendar.select("trade_date", "close_et")), "trade_date").where("ts <= close_et")
    return _daily(rows, F.sum(F.col("close") * F.col("volume")), _whole(F.sum("volume")), US_SOURCE)


def cn_symbol(kind: str) -> Column:
    if kind not in ("stock", "index"):
        raise ValueError(f"kind must be 'stock' or 'index', not {kind!r}")
    return cn_stock_symbol(F.col("code")) if kind == "stock" else cn_index_symbol(F.col("code"))


def cn_minute(raw: DataFrame, kind: str) -> DataFrame:
    """China rows as the stored minute table. Volume is in lots of 100; indexes have none."""
    volume = F.col("volume") if kind == "stock" else F.lit(0.0)
    vwap = F.when(volume > 0, F.col("amount") / volume).otherwise(0.0)
    return raw.select(
        cn_symbol(kind).alias("symbol"), "ts", *[F.col(c).cast("float").alias(c) for c in _PRICES], F.rint(volume).cast("long").alias("volume"), F.lit(0).cast("long").alias("trade_count"),
        vwap.cast("float").alias("vwap"), F.col("amount").cast("double").alias("amount"), *_provenance(CN_SOURCE), *_file_year(raw, F.col("ts")),
    )


def cn_daily(raw: DataFrame, kind: str, tie: str | None = None) -> DataFrame:
    """Daily bars over all rows of a day, auctions included, with the true amount.

    tie: a column of numbers that orders rows of one symbol and time (codes that share a symbol); without one any of them may be first or last.
    """
    volume = F.col("volume") if kind == "stock" else F.lit(0.0)
    rows = raw.select(cn_symbol(kind).alias("symbol"), "ts", trade_date(F.col("ts")).alias("trade_date"), *_PRICES, volume.alias("volume"), "amount", *([tie] if tie else []), *_file_year(raw, F.col("ts")))
    return _daily(rows, F.sum("amount"), _whole(F.sum("volume")), CN_SOURCE, tie)


def cn_union(stocks: DataFrame, indexes: DataFrame) -> DataFrame:
    return stocks.unionByName(indexes, allowMissingColumns=True)


def rest_bars(records: DataFrame, symbol: Column, extended_hours: bool = False) -> DataFrame:
    """REST aggregates (t in milliseconds, o h l c v, vw and n if known) as bars."""
    known = [F.col(old).cast(kind).alias(new) for old, new, kind in (("vw", "vwap", "double"), ("n", "trade_count", "long")) if old in records.columns]
    ts = close_label_ms(F.col("t"))
    clean = F.upper(F.regexp_replace(symbol, r"^\s+|\s+$", ""))
    rows = records.select(clean.alias("symbol"), ts.alias("ts"), *[F.col(o).cast("double").alias(c) for o, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))], *known)
    return rows if extended_hours else rows.where(is_regular(minute(F.col("ts"))))


def with_amount(bars: DataFrame) -> DataFrame:
    """bars with amount: vwap times volume where there is a vwap, close times volume else."""
    price = F.col("vwap") if "vwap" in bars.columns else F.col("close")
    return bars.withColumn("amount", price.cast("double") * F.col("volume"))


def cn_share_vwap(bars: DataFrame) -> DataFrame:
    """bars with vwap_share: amount per share, a lot being 100; null without volume."""
    return bars.withColumn("vwap_share", F.when(F.col("volume") > 0, F.col("amount") / (F.col("volume") * 100)))


def cn_continuous(bars: DataFrame) -> DataFrame:
    """bars without the 09:30 auction."""
    return bars.where(minute(F.col("ts")) > "09:30")


def _of_symbols(rows: DataFrame, symbols: list[str] | None) -> DataFrame:
    return rows if symbols is None else rows.where(F.col("symbol").isin(symbols))


def read_minute(table: DataFrame, symbols: list[str] | None, start: str, end: str, rth_only: bool = True) -> DataFrame:
    """Bars from day start to day end, both included. The range is put on ts and, if there is one, year, which prune the scan."""
    rows = _of_symbols(table, symbols)
    if "year" in rows.columns:
        rows = rows.where(F.col("year").between(int(start[:4]), int(end[:4])))
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    rows = rows.where((F.col("ts") >= first) & (F.col("ts") < last + F.expr("INTERVAL 1 DAY")))
    out = rows.select(trade_date(F.col("ts")).alias("trade_date"), minute(F.col("ts")).alias("minute"), "symbol", *_PRICES, "volume", "trade_count")
    return out.where(is_regular(F.col("minute"))) if rth_only else out


def read_daily(table: DataFrame, symbols: list[str] | None, start: str, end: str) -> DataFrame:
    rows = _of_symbols(table, symbols).where(F.col("trade_date").between(start, end))
    return rows.select("symbol", "trade_date", *_PRICES, "volume", "amount", "source")


def symbols_of(table: DataFrame) -> DataFrame:
    return table.select("symbol").distinct()


def trading_days_of(daily: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Days with data. Takes the daily table, which is hundreds of times smaller than minutes; a benchmark symbol makes it smaller still."""
    return _of_symbols(daily, symbols).select("trade_date").distinct()


def universe_on(daily: DataFrame, day: str) -> DataFrame:
    return daily.where((F.col("trade_date") == day) & (F.col("volume") > 0)).select("symbol").distinct()


def amount_by_day(daily: DataFrame) -> DataFrame:
    return daily.groupBy("trade_date").agg(F.sum("amount").alias("amount"), F.count("*").alias("n_symbols"))


def layer_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("n_bars"), F.count_distinct("symbol").alias("n_symbols"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def symbol_span(daily: DataFrame) -> DataFrame:
    return daily.groupBy("symbol").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def first_bars(bars: DataFrame, symbols: list[str] | None = None, n: int = 10) -> DataFrame:
    """The first n bars of some or all symbols, in order of time and symbol."""
    return _of_symbols(bars, symbols).orderBy("ts", "symbol").limit(n)
