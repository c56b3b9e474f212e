"""Intraday factors and their rank correlation with later returns.

Definitions are this library's own: names and meanings are public, formulas here.
All windows stay within a symbol's day. A quotient with a zero below is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Sign that a factor is expected to have.
DIRECTIONS = {"mom_20b": 1, "rev_20b": 1, "volatility_20b": -1, "amount_surge_20b": 1, "vwap_close_dev_10b": -1}


def _day() -> WindowSpec:
    return Window.partitionBy("symbol", "trade_date").orderBy("minute")


def bar_panel(bars: DataFrame, adjusted: DataFrame | None = None) -> DataFrame:
    """bars (symbol, trade_date, minute, close, volume, with vwap or not) with close_adj, vwap, vwap_adj, amount, session_bucket, minute_index."""
    vwap = F.col("vwap").cast("double") if "vwap" in bars.columns else F.col("close").cast("double")
    rows = bars.withColumn("vwap", vwap).withColumn("amount", F.col("vwap") * F.col("volume"))
    factor = F.lit(1.0)
    if adjusted is not None:
        rows = rows.join(adjusted.select("symbol", "trade_date", F.try_divide("close_adj", "close").alias("adj")), ["symbol", "trade_date"], "left")
        factor = F.coalesce("adj", F.lit(1.0))
    bucket = F.when(F.col("minute") <= "10:00", "open").when(F.col("minute") > "15:30", "close").otherwise("mid")
    return rows.withColumns({"close_adj": F.col("close") * factor, "vwap_adj": F.col("vwap") * factor, "session_bucket": bucket, "minute_index": F.row_number().over(_day())}).drop("adj")


def factors(panel: DataFrame) -> DataFrame:
    """panel with the columns of DIRECTIONS; null where a day has too few bars before."""
    close = F.col("close_adj")
    ret = panel.withColumn("ret", F.try_divide(close, F.lag(close, 1).over(_day())) - 1)
    last20, last10 = _day().rowsBetween(-19, 0), _day().rowsBetween(-9, 0)
    mom = F.try_divide(close, F.lag(close, 20).over(_day())) - 1
    deviation = F.avg(F.try_divide(F.col("vwap_adj"), close) - 1).over(last10)
    flat = F.max(F.abs(F.col("vwap_adj") - close)).over(last10) < 1e-9
    enough = F.col("minute_index") > 20
    out = {
        "mom_20b": mom,
        "rev_20b": -mom,
        "volatility_20b": F.when(enough, F.stddev_samp("ret").over(last20)),
        "amount_surge_20b": F.when(enough, F.try_divide(F.col("amount"), F.avg("amount").over(last20))),
        "vwap_close_dev_10b": F.when((F.col("minute_index") >= 10) & ~flat, deviation),
    }
    return ret.withColumns(out)


def forward_returns(panel: DataFrame, horizons: tuple[int, ...] = (1, 4)) -> DataFrame:
    """panel with fwd_{h} (h bars on, within the day) and fwd_eod (to the day's last bar)."""
    close = F.col("close_adj")
    whole = _day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {f"fwd_{h}": F.try_divide(F.lead(close, h).over(_day()), close) - 1 for h in horizons}
    return panel.withColumns(out | {"fwd_eod": F.try_divide(F.last(close).over(whole), close) - 1})


def _average_rank(column: str, known: Column) -> Column:
    """Rank among known rows of a cross-section, ties sharing their mean."""
    value = F.when(known, F.col(column))
    order = Window.partitionBy("trade_date", "minute", known).orderBy(value)
    tied = Window.partitionBy("trade_date", "minute", known, value)
    return F.when(known, F.rank().over(order) + (F.count("*").over(tied) - 1) / 2)


def rank_ic(rows: DataFrame, factor: str, target: str, at: str = "10:00") -> DataFrame:
    """trade_date, n, ic: rank correlation of factor and target across symbols at a minute of each day."""
    known = F.col(factor).isNotNull() & F.col(target).isNotNull()
    ranked = rows.where(F.col("minute") == at).withColumns({"rx": _average_rank(factor, known), "ry": _average_rank(target, known)})
    return ranked.where("rx IS NOT NULL").groupBy("trade_date").agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.corr("rx", "ry")).alias("ic"))


def combine(rows: DataFrame, directions: dict[str, int] | None = None) -> DataFrame:
    """rows with combo: the mean over factors of their z-scores in each cross-section, signed by the expected direction; unknown ones are left out."""
    directions = DIRECTIONS if directions is None else directions
    cross = Window.partitionBy("trade_date", "minute")
    scores = []
    for name, sign in directions.items():
        spread = F.stddev_samp(name).over(cross)
        scores.append(F.when(spread > 0, sign * (F.col(name) - F.avg(name).over(cross)) / spread))
    total = sum((F.coalesce(s, F.lit(0.0)) for s in scores[1:]), F.coalesce(scores[0], F.lit(0.0)))
    known = sum((s.isNotNull().cast("int") for s in scores[1:]), scores[0].isNotNull().cast("int"))
    return rows.withColumn("combo", F.try_divide(total, known))


def liquid_universe(daily: DataFrame, top: int = 200, window: int = 20, min_price: float = 5.0, min_days: int = 60) -> DataFrame:
    """trade_date, symbol, avg_amount, nth: each day's most traded symbols by mean amount over `window` days, with price and age floors."""
    own = Window.partitionBy("symbol").orderBy("trade_date")
    rows = daily.withColumns({"avg_amount": F.avg("amount").over(own.rowsBetween(-(window - 1), 0)), "age": F.row_number().over(own)})
    best = Window.partitionBy("trade_date").orderBy(F.desc("avg_amount"), "symbol")
    fit = rows.where((F.col("close") >= min_price) & (F.col("age") >= min_days))
    return fit.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top).select("trade_date", "symbol", "avg_amount", "nth")
