"""Event markets: trades, catalog, look-ahead-safe minute features, panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.functions.timeconv import from_epoch_micros, local, minute
from tapegrid.operators.calendars import each_day, in_utc

FEATURES = ("p", "dp_intraday", "dp_overnight", "flow_session", "usdc_session", "n_session", "flow_overnight", "usdc_overnight", "n_overnight")


def market_trades(tape: DataFrame, markets: DataFrame | None = None, tie: str | None = None) -> DataFrame:
    """condition_id, utc, et_ts, p_event, D, usdc_amount, resolved_et, tie of the tape's rows that have a time.

    markets: condition_id of those wanted, which prunes the one scan for all of
    them. tie: a column that orders trades of the same second; without one their
    order is by price, so that a result doesn't depend on the files' order.
    """
    rows = tape if markets is None else tape.join(F.broadcast(markets.select("condition_id").distinct()), "condition_id", "left_semi")
    utc = from_epoch_micros(F.col("block_timestamp") * 1_000_000)
    resolved = local(F.to_utc_timestamp(F.col("resolved_at"), F.current_timezone()).cast("timestamp_ntz")) if dict(tape.dtypes).get("resolved_at") == "timestamp" else local(F.col("resolved_at")) if "resolved_at" in tape.columns else F.lit(None).cast("timestamp_ntz")
    order = F.col(tie) if tie else F.col("p_event")
    return rows.select("condition_id", utc.alias("utc"), local(utc).alias("et_ts"), "p_event", "D", "usdc_amount", resolved.alias("resolved_et"), order.alias("tie")).where("utc IS NOT NULL")


def minute_flow(trades: DataFrame) -> DataFrame:
    """condition_id, m (UTC minute), last (a struct, so that a null price stays one), net, usdc, n, resolved_et."""
    return trades.groupBy("condition_id", F.date_trunc("MINUTE", "utc").cast("timestamp_ntz").alias("m")).agg(
        F.max_by(F.struct(F.col("p_event").alias("p")), F.struct("utc", "tie")).alias("last"),
        F.coalesce(F.sum(F.col("D").cast("double") * F.col("usdc_amount")), F.lit(0.0)).alias("net"),
        F.coalesce(F.sum("usdc_amount"), F.lit(0.0)).alias("usdc"),
        F.count("*").alias("n"),
        F.max("resolved_et").alias("resolved_et"),
    )


def market_days(trades: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each market's calendar days from its first to its last local trade date."""
    name = F.date_format("et_ts", "yyyy-MM-dd")
    spans = trades.groupBy("condition_id").agg(F.min(name).alias("first_day"), F.max(name).alias("last_day"), F.max("resolved_et").alias("resolved_et"))
    # A calendar has some 250 rows a year.
    return each_day(spans).join(F.broadcast(in_utc(calendar)), "trade_date")


def minute_features(trades: DataFrame, calendar: DataFrame) -> DataFrame:
    """condition_id, trade_date, minute and FEATURES for every market and label at once.

    A label T sees trades before T alone. Trades are first summed to UTC minutes,
    so windows hold at most 1440 rows a day and market however it traded; labels
    are whole minutes, so nothing is lost. Nulls in D or amounts are skipped.
    Markets without a grid day have no rows.

    Trades are read once and shuffled twice, by minute as partial sums and by market.
    A market's first minute brings its grid along; minutes and labels then stand in
    one row of time, where running counts of openings and closings tell sessions and
    nights apart, and windows do what joins of grid, minutes and days would.
    """
    flow = minute_flow(trades)
    market = Window.partitionBy("condition_id").orderBy("m")
    whole = market.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = flow.withColumns({"resolved_et": F.max("resolved_et").over(whole), "last_m": F.max("m").over(whole), "nth": F.row_number().over(market)})
    none = F.array(F.lit(None).cast("date"))
    days = F.when(F.col("nth") == 1, F.concat(none, F.sequence(F.to_date(local(F.col("m"))), F.to_date(local(F.col("last_m")))))).otherwise(none)
    with_days = spans.withColumn("day", F.explode(days)).withColumn("trade_date", F.date_format("day", "yyyy-MM-dd")).drop("nth", "last_m")
    # A calendar has some 250 rows a year.
    dated = with_days.join(F.broadcast(in_utc(calendar).select("trade_date", "open_utc", "close_utc")), "trade_date", "left").where("day IS NULL OR open_utc IS NOT NULL")
    labels = F.when(F.col("day").isNull(), F.array("m")).otherwise(F.sequence("open_utc", "close_utc", F.expr("INTERVAL 1 MINUTE")))
    is_label = F.col("day").isNotNull()
    rows = dated.withColumn("t", F.explode(labels)).select(
        "condition_id", "t", "trade_date", "resolved_et", is_label.alias("is_label"), (is_label & (F.col("t") == F.col("open_utc"))).alias("opens"), (is_label & (F.col("t") == F.col("close_utc"))).alias("closes"), *[F.when(~is_label, F.col(c)).alias(c) for c in ("last", "net", "usdc", "n")]
    )
    # A label comes before the trades of its own minute.
    order = ("t", F.desc("is_label"))
    so_far, before = (Window.unboundedPreceding, Window.currentRow), (Window.unboundedPreceding, -1)
    time = Window.partitionBy("condition_id").orderBy(*order)
    placed = rows.withColumns({"p": F.last("last", ignorenulls=True).over(time.rowsBetween(*before))["p"], "session": F.count_if("opens").over(time.rowsBetween(*so_far)), "night": F.count_if("closes").over(time.rowsBetween(*so_far))})

    def sums(window: Window, kind: str) -> dict[str, Column]:
        return {f"{new}_{kind}": F.coalesce(F.sum(c).over(window.rowsBetween(*before)).cast("double"), F.lit(0.0)) for new, c in (("flow", "net"), ("usdc", "usdc"), ("n", "n"))}

    # A night begins with the last label of the day before; what an opening has before it there are the night's trades.
    night = Window.partitionBy("condition_id", "night").orderBy(*order)
    nights = placed.withColumns(sums(night, "overnight") | {"close_p": F.first("p").over(night.rowsBetween(*so_far))})
    # A session begins with its opening, whose values hold for all its labels.
    session = Window.partitionBy("condition_id", "session").orderBy(*order)
    first = lambda c: F.first(c).over(session.rowsBetween(*so_far))
    has_night = first("night") > 0
    overnight = {c: F.when(has_night, first(c)) for c in ("flow_overnight", "usdc_overnight", "n_overnight")}
    both = nights.withColumns(sums(session, "session") | overnight | {"dp_intraday": F.col("p") - first("p"), "dp_overnight": F.when(has_night, first("p") - first("close_p"))})
    ts = local(F.col("t"))
    unmasked = F.col("resolved_et").isNull() | (ts < F.col("resolved_et"))
    return both.where("is_label").select("condition_id", "trade_date", minute(ts).alias("minute"), *[F.when(unmasked, F.col(c)).alias(c) for c in FEATURES])


def feature_panel(features: DataFrame, markets: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """trade_date, minute and {key}_{feature} for each key of markets (key, condition_id); one market may serve several keys.

    Keys whose market has no rows are left out. The keys, a few chosen markets, are
    read first, as they become columns. present: condition_id of the markets that have
    rows, such as market_days gives; without it the features are computed once more for that.
    """
    keyed = features.join(F.broadcast(markets.select("key", "condition_id").distinct()), "condition_id")
    present = (features if present is None else present).select("condition_id").distinct()
    keys = [r["key"] for r in markets.join(present, "condition_id", "left_semi").select("key").distinct().orderBy("key").collect()]
    return keyed.groupBy("trade_date", "minute").pivot("key", keys).agg(*[F.first(c).alias(c) for c in FEATURES])


def market_catalog(tape: DataFrame, min_usdc: float = 50_000.0) -> DataFrame:
    """A row per market with at least min_usdc traded."""
    constant = ("market_slug", "category", "category_refined", "opens_at", "close_at", "resolved_at", "winning_outcome_label")
    totals = [F.count("*").alias("n_trades"), F.sum("usdc_amount").alias("total_usdc"), F.min("block_timestamp").alias("first_ts"), F.max("block_timestamp").alias("last_ts")]
    found = tape.groupBy("condition_id").agg(*totals, *[F.max(c).alias(c) for c in constant]).where(F.col("total_usdc") >= min_usdc)
    return found.select("condition_id", "market_slug", "category", "category_refined", "n_trades", "total_usdc", "first_ts", "last_ts", "opens_at", "close_at", "resolved_at", "winning_outcome_label")


def _mentions(keywords: list[str]) -> Column:
    slug = F.lower(F.coalesce("market_slug", F.lit("")))
    return reduce(lambda a, b: a | b, [slug.contains(k.lower()) for k in keywords], F.lit(False))


def search(catalog: DataFrame, keywords: list[str], top: int | None = None) -> DataFrame:
    """Markets whose slug has any of the keywords, as plain text in any case; the most traded first. top None or 0: all."""
    hits = catalog.where(_mentions(keywords)).orderBy(F.desc("total_usdc"), "condition_id")
    return hits.limit(top) if top else hits


def theme_markets(catalog: DataFrame, themes: dict[str, list[str]], per_theme: int = 1) -> DataFrame:
    """key, condition_id of each theme's most traded markets, with their notional, place and time span; keys are numbered if there may be several."""
    parts = [catalog.where(_mentions(words)).select(F.lit(theme).alias("theme"), "condition_id", "total_usdc", "first_ts", "last_ts") for theme, words in themes.items()]
    best = Window.partitionBy("theme").orderBy(F.desc("total_usdc"), "condition_id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= per_theme)
    key = F.col("theme") if per_theme == 1 else F.concat("theme", F.col("nth").cast("string"))
    return ranked.select(key.alias("key"), "theme", "condition_id", "total_usdc", "nth", "first_ts", "last_ts")


def markets_on(spans: DataFrame, calendar: DataFrame) -> DataFrame:
    """condition_id of the markets with a calendar day between the local days of their first and last trade (first_ts, last_ts)."""
    day = lambda c: F.date_format(local(from_epoch_micros(F.col(c) * 1_000_000)), "yyyy-MM-dd")
    days = each_day(spans.where("first_ts IS NOT NULL").select("condition_id", day("first_ts").alias("first_day"), day("last_ts").alias("last_day")))
    # A calendar has some 250 rows a year.
    return days.join(F.broadcast(calendar.select("trade_date")), "trade_date", "left_semi").select("condition_id").distinct()


def attach_features(bars: DataFrame, panel: DataFrame) -> DataFrame:
    """bars with the panel's columns at their day and minute; a panel has some 391 rows a day, and Spark broadcasts it while it is small."""
    return bars.join(panel, ["trade_date", "minute"], "left")


def tape_profile(tape: DataFrame) -> DataFrame:
    first, last = F.min("block_timestamp"), F.max("block_timestamp")
    return tape.agg(F.count("*").alias("n_rows"), first.alias("first_epoch"), last.alias("last_epoch")).withColumns({f"{c}_utc": F.date_format(from_epoch_micros(F.col(f"{c}_epoch") * 1_000_000), "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


def first_trades(tape: DataFrame, n: int = 3) -> DataFrame:
    return tape.orderBy("block_timestamp", *[c for c in ("tie", "event_id") if c in tape.columns]).limit(n)


def panel_tail(panel: DataFrame, n: int = 5) -> DataFrame:
    """The last rows that have any feature."""
    values = [c for c in panel.columns if c not in ("trade_date", "minute")]
    return panel.dropna("all", subset=values).orderBy(F.desc("trade_date"), F.desc("minute")).limit(n)
