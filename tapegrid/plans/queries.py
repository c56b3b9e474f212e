"""Queries over the given tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.functions import symbols as S
from tapegrid.functions import timeconv as T
from tapegrid.operators import bars, calendars, factors, markets, securities, tables
from tapegrid.plans import derive as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats as doubles of so many digits, as sums in another order differ behind them; no negative zero."""
    return df.select(*[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes])


# --- US bars


@query
def us_daily(spark, sf_dir):
    return rounded(bars.us_daily(D.us_raw(spark, sf_dir)), 4)


@query
def us_close_label(spark, sf_dir):
    return D.labelled(spark, sf_dir).select("ticker", "window_start", "ts")


@query
def us_rth_filter(spark, sf_dir):
    rows = D.labelled(spark, sf_dir).withColumn("minute", T.minute(F.col("ts")))
    return rows.where(T.is_regular(F.col("minute"))).select("ticker", "ts", "minute", "close")


@query
def us_canonical(spark, sf_dir):
    return rounded(bars.us_canonical(D.us_raw(spark, sf_dir), rth_only=True))


@query
def us_minute(spark, sf_dir):
    return rounded(bars.us_minute(D.us_raw(spark, sf_dir)), 2)


@query
def us_daily_true_session(spark, sf_dir):
    early = calendars.trading_calendar(spark, *D.days(spark, sf_dir), early=["2024-01-10"])
    return rounded(bars.us_daily(D.us_raw(spark, sf_dir), early), 4)


@query
def rest_bars(spark, sf_dir):
    return rounded(bars.rest_bars(D.rest_records(spark, sf_dir), F.col("ticker")))


@query
def read_minute(spark, sf_dir):
    table = bars.us_minute(D.us_raw(spark, sf_dir)).withColumn("year", F.year("ts"))
    return rounded(bars.read_minute(table, ["CLICK.A", "ERROR.B"], "2024-01-05", "2024-01-19"), 2)


@query
def read_daily(spark, sf_dir):
    return rounded(bars.read_daily(bars.us_daily(D.us_raw(spark, sf_dir)), ["CLICK.A", "ERROR.B"], "2024-01-05", "2024-01-19"), 4)


@query
def first_bars(spark, sf_dir):
    return rounded(bars.first_bars(bars.us_canonical(D.us_raw(spark, sf_dir), rth_only=True), ["ERROR.A", "CLICK.A"], 25).select("symbol", "ts", "close"))


@query
def bar_amount(spark, sf_dir):
    return rounded(bars.with_amount(bars.us_canonical(D.us_raw(spark, sf_dir))).select("symbol", "ts", "amount"), 4)


@query
def universe_on_day(spark, sf_dir):
    return bars.universe_on(bars.us_daily(D.us_raw(spark, sf_dir)), "2024-01-08")


@query
def market_amount_by_day(spark, sf_dir):
    return rounded(bars.amount_by_day(bars.us_daily(D.us_raw(spark, sf_dir))), 4)


@query
def symbol_span(spark, sf_dir):
    return bars.symbol_span(bars.us_daily(D.us_raw(spark, sf_dir)))


@query
def layer_summary(spark, sf_dir):
    return bars.layer_summary(bars.us_minute(D.us_raw(spark, sf_dir)))


@query
def trading_days_from_data(spark, sf_dir):
    return bars.trading_days_of(bars.us_daily(D.us_raw(spark, sf_dir)), ["CLICK.A"])


@query
def all_symbols(spark, sf_dir):
    return bars.symbols_of(bars.us_daily(D.us_raw(spark, sf_dir)))


# --- China bars and symbols


@query
def safe_symbol(spark, sf_dir):
    return D.raw_symbols(spark, sf_dir).select("p_partkey", S.safe_symbol(F.col("raw")).alias("safe"))


@query
def normalize_symbol(spark, sf_dir):
    return D.raw_symbols(spark, sf_dir).select("p_partkey", S.normalize_symbol(F.col("raw")).alias("symbol"))


@query
def cn_stock_symbol(spark, sf_dir):
    rows = D.cn_raw(spark, sf_dir).select("code").distinct().withColumn("symbol", S.cn_stock_symbol(F.col("code")))
    return rows.withColumn("exchange", S.cn_exchange(F.col("symbol")))


@query
def cn_index_symbol(spark, sf_dir):
    rows = D.codes(spark, sf_dir).withColumn("symbol", S.cn_index_symbol(F.col("code")))
    return rows.withColumn("exchange", S.cn_exchange(F.col("symbol")))


@query
def cn_minute(spark, sf_dir):
    return rounded(bars.cn_minute(D.cn_raw(spark, sf_dir), "stock"), 2)


@query
def cn_vwap(spark, sf_dir):
    rows = bars.cn_share_vwap(bars.cn_minute(D.cn_raw(spark, sf_dir), "stock"))
    return rounded(rows.select("symbol", "ts", F.col("vwap").cast("double"), "vwap_share"), 12)


@query
def cn_daily(spark, sf_dir):
    return rounded(bars.cn_daily(D.cn_raw(spark, sf_dir), "stock"), 4)


@query
def cn_index_daily(spark, sf_dir):
    index = D.cn_raw(spark, sf_dir).withColumn("code", F.concat(F.when(F.col("code").startswith("sh"), "39").otherwise("899"), F.substring("code", 5, 10))).drop("volume")
    return rounded(bars.cn_daily(index, "index", tie="first_event"), 4)


@query
def cn_continuous_session(spark, sf_dir):
    rows = bars.cn_continuous(bars.cn_minute(D.cn_raw(spark, sf_dir), "stock"))
    return rows.groupBy("symbol").agg(F.count("*").alias("n_bars"))


@query
def cn_latest_names(spark, sf_dir):
    raw = D.cn_raw(spark, sf_dir).withColumn("symbol", S.cn_stock_symbol(F.col("code")))
    return securities.latest_names(raw)


@query
def cn_listing(spark, sf_dir):
    raw = D.cn_raw(spark, sf_dir).withColumn("symbol", S.cn_stock_symbol(F.col("code")))
    active = raw.where("ts >= TIMESTAMP_NTZ'2024-01-30 12:00:00'").select("symbol")
    return securities.cn_listing(bars.cn_daily(D.cn_raw(spark, sf_dir), "stock"), securities.latest_names(raw), active)


# --- listings and corporate actions


@query
def listing_rows(spark, sf_dir):
    return securities.listing_rows(D.ticker_records(spark, sf_dir))


@query
def listing_dedup(spark, sf_dir):
    return securities.dedup_listing(securities.listing_rows(D.ticker_records(spark, sf_dir)))


@query
def reference_report(spark, sf_dir):
    return securities.listing_report(securities.dedup_listing(securities.listing_rows(D.ticker_records(spark, sf_dir))))


@query
def split_ratio(spark, sf_dir):
    rows = D.split_records(spark, sf_dir)
    return rounded(rows.select("l_orderkey", "l_linenumber", S.normalize_symbol(F.col("ticker")).alias("symbol"), securities.split_ratio(F.col("split_to"), F.col("split_from")).alias("split_ratio")))


@query
def actions_between(spark, sf_dir):
    return securities.between_dates(D.dividends(spark, sf_dir), "1995-01-01", "1997-12-31", "S7")


@query
def corp_actions(spark, sf_dir):
    return rounded(securities.corporate_actions(D.splits(spark, sf_dir), D.dividends(spark, sf_dir)))


@query
def remap_symbols(spark, sf_dir):
    listed = securities.dedup_listing(securities.listing_rows(D.ticker_records(spark, sf_dir))).select("symbol")
    c = D.table(spark, sf_dir, "customer")
    actions = c.select("c_custkey", F.concat(F.lit("C"), (F.col("c_custkey") % 1200).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "B").otherwise("")).alias("symbol"))
    return securities.remap_symbols(actions, listed)


@query
def adjusted_close(spark, sf_dir):
    actions = securities.corporate_actions(D.splits(spark, sf_dir), D.dividends(spark, sf_dir))
    return rounded(securities.adjusted_close(D.daily_prices(spark, sf_dir, symbols=None), actions), 10)


# --- calendar


@query
def trading_calendar(spark, sf_dir):
    return D.calendar(spark, sf_dir)


@query
def minute_grid(spark, sf_dir):
    spans = D.trades(spark, sf_dir)
    return markets.market_days(spans, D.calendar(spark, sf_dir)).select("condition_id", "trade_date", "open_et", "close_et").transform(
        lambda d: d.select("condition_id", "trade_date", F.explode(F.sequence("open_et", "close_et", F.expr("INTERVAL 1 MINUTE"))).alias("ts")).withColumn("minute", T.minute(F.col("ts")))
    )


@query
def missing_days(spark, sf_dir):
    daily = bars.cn_daily(D.cn_raw(spark, sf_dir), "stock")
    return calendars.missing_days(D.calendar(spark, sf_dir), daily)


# --- event markets


@query
def trades_et(spark, sf_dir):
    return rounded(D.trades(spark, sf_dir).select("condition_id", F.col("tie").alias("event_id"), "et_ts", "resolved_et", "p_event", (F.col("D") * F.col("usdc_amount")).alias("signed")))


@query
def minute_flow(spark, sf_dir):
    flow = markets.minute_flow(D.trades(spark, sf_dir, "user_id"))
    return rounded(flow.select("condition_id", "m", F.col("last.p").alias("p"), "net", "usdc", "n"))


def _features(*columns: str):
    def run(spark, sf_dir):
        return rounded(D.features(spark, sf_dir).select("condition_id", "trade_date", "minute", *columns))

    return run


for _name, _columns in {
    "market_features": markets.FEATURES,
    "asof_locf": ("p",),
    "dp_intraday": ("dp_intraday",),
    "dp_overnight": ("dp_overnight",),
    "session_flow": ("flow_session", "usdc_session", "n_session"),
    "overnight_flow": ("flow_overnight", "usdc_overnight", "n_overnight"),
}.items():
    QUERIES[_name] = _features(*_columns)


@query
def feature_resolution_mask(spark, sf_dir):
    rows = D.features(spark, sf_dir)
    return rows.groupBy("condition_id").agg(F.count("*").alias("n_labels"), F.count("p").alias("n_known"), F.count("n_session").alias("n_unmasked"))


_KEYS = [("a", "click"), ("b", "error"), ("twin", "click")]


def _panel(spark, sf_dir):
    return markets.feature_panel(D.features(spark, sf_dir), spark.createDataFrame(_KEYS, "key string, condition_id string"), markets.market_days(D.trades(spark, sf_dir), D.calendar(spark, sf_dir)))


@query
def feature_panel(spark, sf_dir):
    return rounded(_panel(spark, sf_dir))


@query
def panel_tail(spark, sf_dir):
    return rounded(markets.panel_tail(_panel(spark, sf_dir), 5))


@query
def attach_features(spark, sf_dir):
    rows = bars.us_canonical(D.us_raw(spark, sf_dir), rth_only=True).select("symbol", "trade_date", "minute", "close")
    return rounded(markets.attach_features(rows, _panel(spark, sf_dir).select("trade_date", "minute", "a_p", "b_flow_session")))


@query
def market_catalog(spark, sf_dir):
    return rounded(markets.market_catalog(D.tape(spark, sf_dir, "user_id"), 3000.0), 2)


@query
def catalog_search(spark, sf_dir):
    found = markets.search(markets.market_catalog(D.tape(spark, sf_dir, "user_id"), 0.0), ["RED", "m4-"], 20)
    return rounded(found.select("condition_id", "market_slug", "total_usdc"), 2)


@query
def theme_top_markets(spark, sf_dir):
    themes = {"red": ["red"], "widget": ["WIDGET", "m3"], "none": ["absent"]}
    return rounded(markets.theme_markets(markets.market_catalog(D.tape(spark, sf_dir, "user_id"), 0.0), themes, 3).drop("first_ts", "last_ts"), 2)


@query
def tape_profile(spark, sf_dir):
    return markets.tape_profile(D.tape(spark, sf_dir))


@query
def first_trades(spark, sf_dir):
    return rounded(markets.first_trades(D.tape(spark, sf_dir), 3).select("condition_id", "block_timestamp", "event_id", "p_event"))


# --- table checks


@query
def detect_restatements(spark, sf_dir):
    old = bars.us_minute(D.us_raw(spark, sf_dir))
    new = old.where("NOT (symbol = 'CLICK.A' AND date(ts) = DATE'2024-01-09')").withColumn("close", F.when(F.minute("ts") == 7, F.col("close") + 1).otherwise(F.col("close")))
    return tables.detect_restatements(old, new)


@query
def reconcile_bars(spark, sf_dir):
    a = bars.us_canonical(D.us_raw(spark, sf_dir), rth_only=True)
    b = bars.rest_bars(D.rest_records(spark, sf_dir), F.col("ticker")).where("minute(ts) != 11").withColumns({"volume": F.rint("volume"), "high": F.when(F.minute("ts") == 13, F.col("high") + 1).otherwise(F.col("high"))})
    return tables.reconcile_bars(a, b)


@query
def profile_tables(spark, sf_dir):
    found = [tables.profile_table(D.table(spark, sf_dir, n), n) for n in ("events", "orders", "customer")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def input_manifest(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select("*", "_metadata")
    return tables.input_manifest(rows).groupBy("year").agg(F.sum("n_rows").alias("n_rows"))


# --- factors


def _factor_rows(spark, sf_dir):
    return factors.forward_returns(factors.factors(factors.bar_panel(D.event_bars(spark, sf_dir))))


def _by_hour(rows):
    # Hours stand in for minutes, as few of the derived symbols trade in the same minute.
    return rows.withColumn("minute", F.concat(F.substring("minute", 1, 2), F.lit(":00")))


@query
def factor_panel(spark, sf_dir):
    return rounded(_factor_rows(spark, sf_dir).select("symbol", "trade_date", "minute", "minute_index", "session_bucket", *factors.DIRECTIONS, "fwd_1", "fwd_4", "fwd_eod"), 10)


@query
def factor_rank_ic(spark, sf_dir):
    return rounded(factors.rank_ic(_by_hour(_factor_rows(spark, sf_dir)), "rev_20b", "fwd_4", "10:00"))


@query
def factor_combo(spark, sf_dir):
    return rounded(factors.combine(_by_hour(_factor_rows(spark, sf_dir))).where("combo IS NOT NULL").select("symbol", "trade_date", "minute_index", "combo"))


@query
def liquid_universe(spark, sf_dir):
    return rounded(factors.liquid_universe(D.daily_prices(spark, sf_dir), top=5, window=20, min_price=5.0, min_days=60))
