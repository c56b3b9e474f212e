"""DuckDB SQL for the queries."""

from __future__ import annotations

RAW = """us_raw AS (
  SELECT event_type || '.' || CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS ticker, epoch_us(date_trunc('minute', ts)) * 1000 AS window_start,
    sum(value) AS volume, arg_min(value, event_id) AS open, arg_max(value, event_id) AS "close", max(value) AS high, min(value) AS low, count(*) AS transactions
  FROM events GROUP BY 1, 2
), bar AS (
  SELECT *, upper(ticker) AS symbol, timezone('America/New_York', timezone('UTC', make_timestamp(window_start // 1000 + 60000000))) AS ts FROM us_raw
), lab AS (SELECT *, strftime(ts, '%Y-%m-%d') AS trade_date, strftime(ts, '%H:%M') AS minute FROM bar),
rth AS (SELECT * FROM lab WHERE minute > '09:30' AND minute <= '16:00'),
daily AS (
  SELECT symbol, trade_date, CAST(arg_min(open, ts) AS FLOAT) AS open, CAST(max(high) AS FLOAT) AS high, CAST(min(low) AS FLOAT) AS low, CAST(arg_max("close", ts) AS FLOAT) AS "close",
    CAST(round_even(round(sum(volume), 6), 0) AS BIGINT) AS volume, sum("close" * volume) AS amount, 'massive' AS source
  FROM rth GROUP BY 1, 2
)"""


def _r(columns: str, digits: int) -> str:
    return ", ".join(f'round(CAST("{c}" AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS "{c}"' for c in columns.split())


def us(select: str) -> str:
    return f"WITH {RAW} {select}"


_DAILY = f"symbol, trade_date, {_r('open high low close amount', 4)}, volume, source"

CN = """cn_raw AS (
  SELECT date_trunc('minute', ts) AS ts, CASE WHEN user_id % 2 = 0 THEN 'sh' ELSE 'sz' END || lpad(CAST(user_id AS VARCHAR), 6, '0') AS code,
    arg_min(value, event_id) AS open, arg_max(value, event_id) AS "close", max(value) AS high, min(value) AS low, sum(floor(value)) AS volume, sum(value * 10) AS amount
  FROM events GROUP BY 1, 2
), cn AS (SELECT *, substr(code, 3) || '.' || upper(substr(code, 1, 2)) AS symbol, strftime(ts, '%Y-%m-%d') AS trade_date, 'N' || code || strftime(ts, '%H') AS name FROM cn_raw),
cn_day AS (
  SELECT symbol, trade_date, CAST(arg_min(open, ts) AS FLOAT) AS open, CAST(max(high) AS FLOAT) AS high, CAST(min(low) AS FLOAT) AS low, CAST(arg_max("close", ts) AS FLOAT) AS "close",
    CAST(sum(volume) AS BIGINT) AS volume, sum(amount) AS amount, 'cn_csv' AS source
  FROM cn GROUP BY 1, 2
)"""


def cn(select: str) -> str:
    return f"WITH {CN} {select}"


SYMBOLS = """raws AS (
  SELECT p_partkey, ' ' || substr(p_type, 1, 3) || CAST(p_size AS VARCHAR) || CASE p_partkey % 6 WHEN 0 THEN '.us' WHEN 1 THEN '.N ' WHEN 2 THEN ':NASDAQ' WHEN 3 THEN '.A' WHEN 4 THEN '.OQ' ELSE '' END AS raw FROM part
)"""

LISTING = """rec AS (
  SELECT 'c' || CAST(c_custkey % 1000 AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN '.B' ELSE '' END AS ticker, c_name AS name, c_mktsegment AS primary_exchange, c_acctbal >= 0 AS active,
    CASE WHEN c_acctbal < 0 THEN '20' || lpad(CAST(10 + c_custkey % 15 AS VARCHAR), 2, '0') || '-06-01T00:00:00Z' END AS delisted_utc, c_custkey FROM customer
), every_rec AS (
  SELECT * FROM rec UNION ALL SELECT ticker, name || ' old', primary_exchange, false, '2009-01-01T00:00:00Z', c_custkey FROM rec WHERE c_custkey % 3 = 0
), lst AS (
  SELECT upper(ticker) AS symbol, name, primary_exchange AS exchange, CASE WHEN active THEN 'active' ELSE 'delisted' END AS status, '' AS ipo_date,
    CASE WHEN active THEN '' ELSE substr(coalesce(delisted_utc, ''), 1, 10) END AS delist_date FROM every_rec
), listing AS (SELECT * FROM lst QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY status, delist_date DESC, name, exchange) = 1)"""

ACTIONS = """sp AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, strftime(l_shipdate, '%Y-%m-%d') AS ex_date, CAST(1 + l_linenumber % 3 AS DOUBLE) AS split_ratio FROM lineitem WHERE l_returnflag = 'R'
), dv AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, strftime(l_shipdate, '%Y-%m-%d') AS ex_date, l_discount AS cash_div FROM lineitem WHERE l_returnflag = 'A'
)"""

PRICES = """prices AS (
  SELECT 'S' || CAST(o_custkey % 20 AS VARCHAR) AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS trade_date, max(o_totalprice) AS "close", count(*) AS volume, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2
)"""

HOLIDAYS = "('2024-01-01'), ('2024-01-15'), ('2024-02-19'), ('2024-03-29'), ('2024-05-27'), ('2024-06-19'), ('2024-07-04'), ('2024-09-02'), ('2024-11-28'), ('2024-12-25')"


CALENDAR = f"""cal AS (
  SELECT strftime(d, '%Y-%m-%d') AS trade_date, d + INTERVAL '9 hours 30 minutes' AS open_et,
    d + CASE WHEN strftime(d, '%Y-%m-%d') IN ('2024-07-03', '2024-11-29', '2024-12-24') THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END AS close_et
  FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) - INTERVAL 1 DAY FROM events), (SELECT CAST(date_trunc('day', max(ts)) AS TIMESTAMP) FROM events), INTERVAL 1 DAY)) AS d)
  WHERE isodow(d) < 6 AND strftime(d, '%Y-%m-%d') NOT IN (SELECT h FROM (VALUES {HOLIDAYS}) AS v(h))
)"""


def tape(market: str) -> str:
    number = "user_id" if market == "user_id" else "0"
    return f"""tape AS (
  SELECT CAST({market} AS VARCHAR) AS condition_id, epoch_us(date_trunc('second', ts)) // 1000000 AS block_timestamp, event_id, value / 500 AS p_event, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END AS d, value AS usdc_amount,
    'm' || CAST({number} % 10 AS VARCHAR) || CASE {number} % 3 WHEN 0 THEN '-Red' WHEN 1 THEN '-widget' ELSE '' END AS market_slug, 'cat' || CAST({number} % 4 AS VARCHAR) AS category, 'sub' || CAST({number} % 5 AS VARCHAR) AS category_refined,
    TIMESTAMP '2024-01-01' AS opens_at, TIMESTAMP '2024-02-01' AS close_at, CASE WHEN CAST({market} AS VARCHAR) = 'error' THEN TIMESTAMP '2024-01-20 17:00:00' END AS resolved_at, CASE WHEN {number} % 2 = 0 THEN 'Yes' ELSE 'No' END AS winning_outcome_label
  FROM events
), tr AS (
  SELECT condition_id, event_id, make_timestamp(block_timestamp * 1000000) AS utc, timezone('America/New_York', timezone('UTC', make_timestamp(block_timestamp * 1000000))) AS et, p_event, d, usdc_amount,
    timezone('America/New_York', timezone('UTC', resolved_at)) AS resolved_et
  FROM tape
), catalog AS (
  SELECT condition_id, any_value(market_slug) AS market_slug, any_value(category) AS category, any_value(category_refined) AS category_refined, count(*) AS n_trades, sum(usdc_amount) AS total_usdc,
    min(block_timestamp) AS first_ts, max(block_timestamp) AS last_ts, any_value(opens_at) AS opens_at, any_value(close_at) AS close_at, any_value(resolved_at) AS resolved_at, any_value(winning_outcome_label) AS winning_outcome_label
  FROM tape GROUP BY 1
)"""


FEATURES = f"""{CALENDAR}, {tape('event_type')},
span AS (SELECT condition_id, min(strftime(et, '%Y-%m-%d')) AS a, max(strftime(et, '%Y-%m-%d')) AS b, max(resolved_et) AS resolved_et FROM tr GROUP BY 1),
days AS (SELECT condition_id, trade_date, open_et, close_et, resolved_et, lag(close_et) OVER (PARTITION BY condition_id ORDER BY trade_date) AS prev_close FROM span JOIN cal ON trade_date BETWEEN a AND b),
grid AS (SELECT condition_id, trade_date, resolved_et, unnest(generate_series(open_et, close_et, INTERVAL 1 MINUTE)) AS ts FROM days),
points AS (SELECT condition_id, et, arg_max(p_event, event_id) AS p FROM tr GROUP BY 1, 2),
seen AS (SELECT g.*, q.p FROM grid g ASOF LEFT JOIN points q ON g.condition_id = q.condition_id AND g.ts > q.et),
mins AS (SELECT condition_id, date_trunc('minute', et) AS m, sum(d * usdc_amount) AS net, sum(usdc_amount) AS usdc, count(*) AS n FROM tr GROUP BY 1, 2),
sess AS (
  SELECT s.*, coalesce(sum(net) OVER w, 0) AS flow_session, coalesce(sum(usdc) OVER w, 0) AS usdc_session, CAST(coalesce(sum(n) OVER w, 0) AS DOUBLE) AS n_session,
    p - first_value(p) OVER (PARTITION BY s.condition_id, trade_date ORDER BY ts) AS dp_intraday
  FROM seen s LEFT JOIN mins ON mins.condition_id = s.condition_id AND m = ts
  WINDOW w AS (PARTITION BY s.condition_id, trade_date ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ends AS (
  SELECT s.condition_id, s.trade_date, max(p) FILTER (WHERE ts = open_et) AS open_p, max(p) FILTER (WHERE ts = close_et) AS close_p FROM seen s JOIN days USING (condition_id, trade_date) GROUP BY 1, 2
), gap AS (SELECT condition_id, trade_date, open_p - lag(close_p) OVER (PARTITION BY condition_id ORDER BY trade_date) AS dp_overnight FROM ends),
night AS (
  SELECT y.condition_id, y.trade_date, CASE WHEN prev_close IS NOT NULL THEN coalesce(sum(d * usdc_amount), 0) END AS flow_overnight, CASE WHEN prev_close IS NOT NULL THEN coalesce(sum(usdc_amount), 0) END AS usdc_overnight,
    CASE WHEN prev_close IS NOT NULL THEN CAST(count(tr.event_id) AS DOUBLE) END AS n_overnight
  FROM days y LEFT JOIN tr ON tr.condition_id = y.condition_id AND tr.et >= prev_close AND tr.et < open_et GROUP BY y.condition_id, y.trade_date, prev_close
), feat AS (
  SELECT s.condition_id, s.trade_date, strftime(ts, '%H:%M') AS minute, {{columns}}
  FROM sess s JOIN gap USING (condition_id, trade_date) JOIN night USING (condition_id, trade_date)
)"""
_ALL = "p dp_intraday dp_overnight flow_session usdc_session n_session flow_overnight usdc_overnight n_overnight"
_MASKED = ", ".join(f"CASE WHEN resolved_et IS NULL OR ts < resolved_et THEN {c} END AS {c}" for c in _ALL.split())


def feat(select: str) -> str:
    return f"WITH {FEATURES.format(columns=_MASKED)} {select}"


def feature_columns(columns: str) -> str:
    return feat(f"SELECT condition_id, trade_date, minute, {_r(columns, 6)} FROM feat")


_PANEL = ", ".join(f"max({c}) FILTER (WHERE key = '{k}') AS {k}_{c}" for k in ("a", "b", "twin") for c in _ALL.split())
PANEL = f"""keys(key, condition_id) AS (VALUES ('a', 'click'), ('b', 'error'), ('twin', 'click')),
panel AS (SELECT trade_date, minute, {_PANEL} FROM feat JOIN keys USING (condition_id) GROUP BY 1, 2)"""
_PANEL_ROUNDED = "trade_date, minute, " + _r(" ".join(f"{k}_{c}" for k in ("a", "b", "twin") for c in _ALL.split()), 6)


def panel(select: str, extra: str = "") -> str:
    return f"WITH {FEATURES.format(columns=_MASKED)}, {PANEL}{extra} {select}"


FACTORS = """eb AS (
  SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d') AS trade_date, strftime(ts, '%H:%M') AS minute, arg_max(value, event_id) AS "close", round(avg(value), 6) AS vwap, count(*) * 10 AS volume FROM events GROUP BY 1, 2, 3
), pan AS (
  SELECT symbol, trade_date, minute, "close", vwap, vwap * volume AS amount, row_number() OVER d AS minute_index,
    CASE WHEN minute <= '10:00' THEN 'open' WHEN minute > '15:30' THEN 'close' ELSE 'mid' END AS session_bucket,
    "close" / nullif(lag("close", 1) OVER d, 0) - 1 AS ret, "close" / nullif(lag("close", 20) OVER d, 0) - 1 AS mom_20b,
    lead("close", 1) OVER d / nullif("close", 0) - 1 AS fwd_1, lead("close", 4) OVER d / nullif("close", 0) - 1 AS fwd_4, last_value("close") OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / nullif("close", 0) - 1 AS fwd_eod
  FROM eb WINDOW d AS (PARTITION BY symbol, trade_date ORDER BY minute)
), fac AS (
  SELECT *, -mom_20b AS rev_20b, CASE WHEN minute_index > 20 THEN stddev_samp(ret) OVER d20 END AS volatility_20b, CASE WHEN minute_index > 20 THEN amount / nullif(avg(amount) OVER d20, 0) END AS amount_surge_20b,
    CASE WHEN minute_index >= 10 AND max(abs(vwap - "close")) OVER d10 >= 1e-9 THEN avg(vwap / nullif("close", 0) - 1) OVER d10 END AS vwap_close_dev_10b
  FROM pan WINDOW d20 AS (PARTITION BY symbol, trade_date ORDER BY minute ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), d10 AS (PARTITION BY symbol, trade_date ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
)"""


def _z(c: str, sign: int) -> str:
    return f"CASE WHEN stddev_samp({c}) OVER x > 0 THEN {sign} * ({c} - avg({c}) OVER x) / stddev_samp({c}) OVER x END AS z_{c}"


_ZS = ["mom_20b", "rev_20b", "volatility_20b", "amount_surge_20b", "vwap_close_dev_10b"]

SQL = {
    "us_daily": us(f"SELECT {_DAILY} FROM daily"),
    "us_close_label": us("SELECT ticker, window_start, ts FROM bar"),
    "us_rth_filter": us('SELECT ticker, ts, minute, "close" FROM rth'),
    "us_canonical": us(f"SELECT symbol, trade_date, minute, ts, {_r('open high low close', 6)}, CAST(round_even(volume, 0) AS BIGINT) AS volume, transactions AS trade_count FROM rth"),
    "us_minute": us(f"SELECT symbol, ts, {_r('open high low close', 2)}, CAST(round(volume) AS BIGINT) AS volume, transactions AS trade_count, 'massive' AS source, '' AS ingested_utc, '' AS raw_hash FROM bar"),
    "us_daily_true_session": us(
        f"""SELECT {_DAILY} FROM (SELECT symbol, trade_date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max("close", ts) AS "close", CAST(round_even(round(sum(volume), 6), 0) AS BIGINT) AS volume, sum("close" * volume) AS amount, 'massive' AS source
        FROM rth WHERE isodow(ts) < 6 AND trade_date NOT IN (SELECT h FROM (VALUES {HOLIDAYS}) AS v(h)) AND (trade_date <> '2024-01-10' OR minute <= '13:00') GROUP BY 1, 2)"""
    ),
    "rest_bars": us(f"SELECT symbol, ts, {_r('open high low close volume', 6)}, transactions AS trade_count FROM rth"),
    "read_minute": us(f"SELECT trade_date, minute, symbol, {_r('open high low close', 2)}, CAST(round(volume) AS BIGINT) AS volume, transactions AS trade_count FROM rth WHERE symbol IN ('CLICK.A', 'ERROR.B') AND trade_date BETWEEN '2024-01-05' AND '2024-01-19'"),
    "read_daily": us(f"SELECT {_DAILY} FROM daily WHERE symbol IN ('CLICK.A', 'ERROR.B') AND trade_date BETWEEN '2024-01-05' AND '2024-01-19'"),
    "first_bars": us("""SELECT symbol, ts, round("close", 6) + CAST(0 AS DOUBLE) AS "close" FROM rth WHERE symbol IN ('ERROR.A', 'CLICK.A') ORDER BY rth.ts, symbol LIMIT 25"""),
    "bar_amount": us('SELECT symbol, ts, round("close" * round_even(volume, 0), 4) AS amount FROM lab'),
    "universe_on_day": us("SELECT DISTINCT symbol FROM daily WHERE trade_date = '2024-01-08' AND volume > 0"),
    "market_amount_by_day": us("SELECT trade_date, round(sum(amount), 4) AS amount, count(*) AS n_symbols FROM daily GROUP BY 1"),
    "symbol_span": us("SELECT symbol, min(trade_date) AS first_date, max(trade_date) AS last_date FROM daily GROUP BY 1"),
    "layer_summary": us("SELECT count(*) AS n_bars, count(DISTINCT symbol) AS n_symbols, min(ts) AS first_ts, max(ts) AS last_ts FROM bar"),
    "trading_days_from_data": us("SELECT DISTINCT trade_date FROM daily WHERE symbol = 'CLICK.A'"),
    "all_symbols": us("SELECT DISTINCT symbol FROM daily"),
    "safe_symbol": f"WITH {SYMBOLS} SELECT p_partkey, regexp_replace(upper(raw), '[^A-Za-z0-9_.\\-]', '_', 'g') AS safe FROM raws",
    "normalize_symbol": f"WITH {SYMBOLS} SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN upper(trim(replace(raw, '.us', ''))) WHEN 1 THEN upper(trim(replace(raw, '.N', ''))) WHEN 2 THEN upper(trim(replace(raw, ':NASDAQ', ''))) WHEN 4 THEN upper(trim(replace(raw, '.OQ', ''))) ELSE upper(trim(raw)) END AS symbol FROM raws",
    "cn_stock_symbol": cn("SELECT DISTINCT code, symbol, CASE WHEN symbol LIKE '%.SH' THEN 'XSHG' ELSE 'XSHE' END AS exchange FROM cn"),
    "cn_index_symbol": """WITH k AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS key FROM part), c AS (SELECT p_partkey, key AS code FROM k UNION ALL SELECT p_partkey, '39' || key FROM k UNION ALL SELECT p_partkey, '899' || key FROM k),
      s AS (SELECT *, code || CASE WHEN starts_with(code, '39') THEN '.SZ' WHEN starts_with(code, '899') THEN '.BJ' ELSE '.SH' END AS symbol FROM c)
      SELECT *, CASE split_part(symbol, '.', 2) WHEN 'SH' THEN 'XSHG' WHEN 'SZ' THEN 'XSHE' ELSE 'BSE' END AS exchange FROM s""",
    "cn_minute": cn(f"SELECT symbol, ts, {_r('open high low close amount', 2)}, CAST(volume AS BIGINT) AS volume, CAST(0 AS BIGINT) AS trade_count, round(CAST(CAST(CASE WHEN volume > 0 THEN amount / volume ELSE 0 END AS FLOAT) AS DOUBLE), 2) AS vwap, 'cn_csv' AS source, '' AS ingested_utc, '' AS raw_hash FROM cn"),
    "cn_vwap": cn("SELECT symbol, ts, round(CAST(CAST(CASE WHEN volume > 0 THEN amount / volume ELSE 0 END AS FLOAT) AS DOUBLE), 12) AS vwap, round(CASE WHEN volume > 0 THEN amount / (volume * 100) END, 12) AS vwap_share FROM cn"),
    "cn_daily": cn(f"SELECT {_DAILY} FROM cn_day"),
    "cn_index_daily": cn(
        f"""SELECT {_DAILY} FROM (SELECT CASE WHEN starts_with(code, 'sh') THEN '39' || substr(code, 5) || '.SZ' ELSE '899' || substr(code, 5) || '.BJ' END AS symbol, trade_date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
        arg_max("close", ts) AS "close", CAST(0 AS BIGINT) AS volume, sum(amount) AS amount, 'cn_csv' AS source FROM cn GROUP BY 1, 2)"""
    ),
    "cn_continuous_session": cn("SELECT symbol, count(*) AS n_bars FROM cn WHERE strftime(ts, '%H:%M') > '09:30' GROUP BY 1"),
    "cn_latest_names": cn("SELECT symbol, arg_min(name, ts) AS name FROM cn WHERE year(ts) = 2024 GROUP BY 1"),
    "cn_listing": cn(
        """, act AS (SELECT DISTINCT symbol FROM cn WHERE ts >= TIMESTAMP '2024-01-30 12:00:00')
        SELECT symbol, arg_min(name, ts) AS name, CASE WHEN symbol LIKE '%.SH' THEN 'XSHG' ELSE 'XSHE' END AS exchange, CASE WHEN symbol IN (SELECT symbol FROM act) THEN 'active' ELSE 'delisted' END AS status,
          min(trade_date) AS ipo_date, CASE WHEN symbol IN (SELECT symbol FROM act) THEN '' ELSE max(trade_date) END AS delist_date FROM cn GROUP BY symbol"""
    ),
    "listing_rows": f"WITH {LISTING} SELECT * FROM lst",
    "listing_dedup": f"WITH {LISTING} SELECT * FROM listing",
    "reference_report": f"WITH {LISTING} SELECT count(*) AS n_listed, count(*) FILTER (WHERE status = 'active') AS n_active, count(*) FILTER (WHERE status = 'delisted') AS n_delisted, count(*) FILTER (WHERE contains(symbol, '.')) AS n_dotted FROM listing",
    "split_ratio": """SELECT l_orderkey, l_linenumber, 'S' || CAST(l_suppkey AS VARCHAR) AS symbol,
      round((CASE WHEN l_quantity % 5 = 0 THEN 1.0 ELSE l_quantity % 5 END) / (CASE WHEN l_linenumber = 2 OR l_linenumber % 4 = 0 THEN 1.0::DOUBLE ELSE l_linenumber % 4 END), 6) AS split_ratio FROM lineitem""",
    "actions_between": f"WITH {ACTIONS} SELECT * FROM dv WHERE ex_date BETWEEN '1995-01-01' AND '1997-12-31' AND symbol = 'S7'",
    "corp_actions": f"""WITH {ACTIONS} SELECT symbol, ex_date, round(coalesce(r, 1.0), 6) AS split_ratio, round(coalesce(c, 0.0), 6) AS cash_div
      FROM (SELECT symbol, ex_date, product(split_ratio) AS r FROM sp GROUP BY 1, 2) FULL JOIN (SELECT symbol, ex_date, sum(cash_div) AS c FROM dv GROUP BY 1, 2) USING (symbol, ex_date)""",
    "remap_symbols": f"""WITH {LISTING}, act AS (SELECT c_custkey, 'C' || CAST(c_custkey % 1200 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN 'B' ELSE '' END AS symbol FROM customer),
      dot AS (SELECT replace(symbol, '.', '') AS plain, min(symbol) AS native FROM listing WHERE contains(symbol, '.') GROUP BY 1 HAVING count(*) = 1)
      SELECT c_custkey, CASE WHEN a.symbol NOT IN (SELECT symbol FROM listing) AND native IS NOT NULL THEN native ELSE a.symbol END AS symbol FROM act a LEFT JOIN dot ON plain = a.symbol""",
    "adjusted_close": f"""WITH {ACTIONS}, {PRICES.replace('o_custkey % 20', 'o_custkey')}, r AS (SELECT symbol, ex_date, product(split_ratio) AS ratio FROM sp GROUP BY 1, 2)
      SELECT p.symbol, trade_date, round("close", 10) AS "close", round("close" / coalesce(product(ratio), 1.0), 10) AS close_adj FROM prices p LEFT JOIN r ON r.symbol = p.symbol AND trade_date < ex_date GROUP BY p.symbol, trade_date, "close" """,
    "trading_calendar": f"WITH {CALENDAR} SELECT * FROM cal",
    "minute_grid": feat("SELECT condition_id, trade_date, ts, strftime(ts, '%H:%M') AS minute FROM grid"),
    "missing_days": f"""WITH {CN}, {CALENDAR}, s AS (SELECT symbol, min(trade_date) AS a, max(trade_date) AS b FROM cn_day GROUP BY 1)
      SELECT symbol, trade_date FROM s JOIN cal ON trade_date BETWEEN a AND b WHERE (symbol, trade_date) NOT IN (SELECT (symbol, trade_date) FROM cn_day)""",
    "trades_et": f"WITH {tape('event_type')} SELECT condition_id, event_id, et AS et_ts, resolved_et, round(p_event, 6) AS p_event, round(d * usdc_amount, 6) AS signed FROM tr",
    "minute_flow": f"WITH {tape('user_id')} SELECT condition_id, date_trunc('minute', utc) AS m, round(arg_max(p_event, CAST(epoch(utc) AS BIGINT) * 10000000 + event_id), 6) AS p, round(sum(d * usdc_amount), 6) AS net, round(sum(usdc_amount), 6) AS usdc, count(*) AS n FROM tr GROUP BY 1, 2",
    "market_features": feature_columns(_ALL),
    "asof_locf": feature_columns("p"),
    "dp_intraday": feature_columns("dp_intraday"),
    "dp_overnight": feature_columns("dp_overnight"),
    "session_flow": feature_columns("flow_session usdc_session n_session"),
    "overnight_flow": feature_columns("flow_overnight usdc_overnight n_overnight"),
    "feature_resolution_mask": feat("SELECT condition_id, count(*) AS n_labels, count(p) AS n_known, count(n_session) AS n_unmasked FROM feat GROUP BY 1"),
    "feature_panel": panel(f"SELECT {_PANEL_ROUNDED} FROM panel"),
    "panel_tail": panel(f"SELECT {_PANEL_ROUNDED} FROM panel WHERE coalesce(a_p, b_p, a_n_session, b_n_session) IS NOT NULL ORDER BY trade_date DESC, minute DESC LIMIT 5"),
    "attach_features": panel(
        'SELECT symbol, r.trade_date, r.minute, round("close", 6) AS "close", round(a_p, 6) AS a_p, round(b_flow_session, 6) AS b_flow_session FROM rth r LEFT JOIN panel USING (trade_date, minute)', f", {RAW}"
    ),
    "market_catalog": f"WITH {tape('user_id')} SELECT * REPLACE (round(total_usdc, 2) AS total_usdc) FROM catalog WHERE total_usdc >= 3000",
    "catalog_search": f"WITH {tape('user_id')} SELECT condition_id, market_slug, round(total_usdc, 2) AS total_usdc FROM catalog WHERE contains(lower(market_slug), 'red') OR contains(lower(market_slug), 'm4-') ORDER BY catalog.total_usdc DESC, condition_id LIMIT 20",
    "theme_top_markets": f"""WITH {tape('user_id')}, hit AS (
        SELECT 'red' AS theme, condition_id, total_usdc FROM catalog WHERE contains(lower(market_slug), 'red') UNION ALL SELECT 'widget', condition_id, total_usdc FROM catalog WHERE contains(lower(market_slug), 'widget') OR contains(lower(market_slug), 'm3')
      ), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY theme ORDER BY total_usdc DESC, condition_id) AS INTEGER) AS nth FROM hit)
      SELECT theme || CAST(nth AS VARCHAR) AS key, theme, condition_id, round(total_usdc, 2) AS total_usdc, nth FROM k WHERE nth <= 3""",
    "tape_profile": f"WITH {tape('event_type')} SELECT count(*) AS n_rows, min(block_timestamp) AS first_epoch, max(block_timestamp) AS last_epoch, strftime(min(utc), '%Y-%m-%d %H:%M:%S') AS first_epoch_utc, strftime(max(utc), '%Y-%m-%d %H:%M:%S') AS last_epoch_utc FROM tape JOIN tr USING (event_id)".replace("first_epoch_utc", "first_utc").replace("last_epoch_utc", "last_utc"),
    "first_trades": f"WITH {tape('event_type')} SELECT condition_id, block_timestamp, event_id, round(p_event, 6) AS p_event FROM tape ORDER BY block_timestamp, event_id LIMIT 3",
    "detect_restatements": us(
        """, f AS (SELECT symbol, trade_date, symbol = 'CLICK.A' AND trade_date = '2024-01-09' AS gone, extract('minute' FROM ts) = 7 AS moved FROM lab)
        SELECT symbol, trade_date, count(*) AS old_bars, CASE WHEN bool_or(gone) THEN NULL ELSE count(*) END AS new_bars, CASE WHEN bool_or(gone) THEN 'removed' ELSE 'restated' END AS change
        FROM f GROUP BY 1, 2 HAVING bool_or(gone OR moved)"""
    ),
    "reconcile_bars": us(
        """SELECT symbol, ts, CASE WHEN extract('minute' FROM ts) = 11 THEN 'a' ELSE '' END AS only_in, false AS diff_open, extract('minute' FROM ts) = 13 AS diff_high, false AS diff_low, false AS diff_close, false AS diff_volume FROM rth WHERE extract('minute' FROM ts) IN (11, 13)"""
    ),
    "profile_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM {t}"
        for t, cs in {"events": "event_id ts user_id event_type value props", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment"}.items()
        for c in cs.split()
    ),
    "input_manifest": "SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS n_rows FROM events GROUP BY 1",
    "factor_panel": f"WITH {FACTORS} SELECT symbol, trade_date, minute, CAST(minute_index AS INTEGER) AS minute_index, session_bucket, {_r(' '.join(_ZS) + ' fwd_1 fwd_4 fwd_eod', 10)} FROM fac",
    "factor_rank_ic": f"""WITH {FACTORS}, hour AS (SELECT trade_date, rev_20b AS x, fwd_4 AS y FROM fac WHERE substr(minute, 1, 2) = '10' AND rev_20b IS NOT NULL AND fwd_4 IS NOT NULL),
        k AS (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY trade_date ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, y) - 1) / 2.0::DOUBLE AS ry FROM hour)
        SELECT trade_date, count(*) AS n, round(CASE WHEN count(*) > 1 THEN corr(rx, ry) END, 6) AS ic FROM k GROUP BY 1""",
    "factor_combo": f"""WITH {FACTORS}, zs AS (SELECT symbol, trade_date, minute_index, {', '.join(_z(c, -1 if c in ('volatility_20b', 'vwap_close_dev_10b') else 1) for c in _ZS)} FROM fac WINDOW x AS (PARTITION BY trade_date, substr(minute, 1, 2))),
        co AS (SELECT symbol, trade_date, minute_index, ({' + '.join(f'coalesce(z_{c}, 0)' for c in _ZS)}) / nullif({' + '.join(f'(z_{c} IS NOT NULL)::INTEGER' for c in _ZS)}, 0) AS combo FROM zs)
        SELECT symbol, trade_date, CAST(minute_index AS INTEGER) AS minute_index, round(combo, 6) + CAST(0 AS DOUBLE) AS combo FROM co WHERE combo IS NOT NULL""",
    "liquid_universe": f"""WITH {PRICES}, d AS (SELECT *, avg(amount) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS avg_amount, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS age FROM prices),
      k AS (SELECT *, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY avg_amount DESC, symbol) AS INTEGER) AS nth FROM d WHERE "close" >= 5 AND age >= 60) SELECT trade_date, symbol, round(avg_amount, 6) AS avg_amount, nth FROM k WHERE nth <= 5""",
}
