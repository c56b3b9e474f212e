"""Queries over tables and files that they write first, in the shared checkpoint folder, from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.operators import bars, calendars, factors, snapshots, tables
from tapegrid.plans import derive as D
from tapegrid.plans import jobs
from tapegrid.plans.oracles import _ZS, CALENDAR, FACTORS, RAW, _r, _z
from tapegrid.plans.queries import query, rounded
from tapegrid.sources import files, landing, schemas

#: The day before which files have landed when the first build runs.
SECOND = "2024-01-16"


@query
def incremental_build(spark, sf_dir):
    """Daily bars of a table that was built twice: when the first files had landed, and when more had. build: the run that made a row's year."""
    root = tables.scratch_folder(spark)
    rows = D.us_raw_of_years(spark, sf_dir)
    for part in (F.col("day") < SECOND, F.col("day") >= SECOND):
        D.land_csv(rows.where(part), f"{root}/landed")
        jobs.build_us_bars(spark, f"{root}/landed", f"{root}/db")
    runs = tables.stored_manifest(spark, f"{root}/db/manifest").select("year", "build").distinct()
    # A row a year.
    return rounded(spark.read.parquet(f"{root}/db/daily").join(F.broadcast(runs), "year").select("symbol", "trade_date", *bars._PRICES, "volume", "amount", "build"), 4)


@query
def stored_minute_range(spark, sf_dir):
    """A range of three symbols, read from the stored minute table."""
    root = tables.scratch_folder(spark)
    tables.write_minute(bars.us_minute(D.us_raw_of_years(spark, sf_dir)), f"{root}/minute")
    return rounded(bars.read_minute(spark.read.parquet(f"{root}/minute"), ["ERROR.A", "ERROR.B", "CLICK.B"], "2023-01-09", "2023-01-20"), 2)


@query
def union_by_name(spark, sf_dir):
    """Landed files whose headers differ: the usual columns, the same turned round, and three of them with one more."""
    root = tables.scratch_folder(spark)
    rows = D.us_raw_of_years(spark, sf_dir).withColumn("venue", F.concat(F.lit("v"), F.col("transactions")))
    third = F.day(F.to_date("day")) % 3
    for k, columns in enumerate((schemas.US_RAW.names, schemas.US_RAW.names[::-1], ["venue", "ticker", "close", "window_start"])):
        D.land_csv(rows.where(third == k), f"{root}/landed", columns)
    return rounded(files.read_us_raw(spark, f"{root}/landed"), 9)


@query
def file_audit(spark, sf_dir):
    """Landed days of one ticker's higher prices against the calendar."""
    root = tables.scratch_folder(spark)
    D.land_csv(D.us_raw_of_years(spark, sf_dir).where("ticker = 'error.A' AND high > 480"), f"{root}/landed")
    return calendars.file_audit(D.calendar(spark, sf_dir), landing.landed_files(spark, f"{root}/landed").where(F.col("file_name").endswith(".gz")))


@query
def stored_restatements(spark, sf_dir):
    """Days that differ between two stored versions of a minute table: the .A tickers' year is written anew without the smaller trades of one day in three."""
    root = tables.scratch_folder(spark)
    table, store = f"{root}/minute", f"{root}/versions"
    rows = D.us_raw_of_years(spark, sf_dir)
    tables.write_minute(bars.us_minute(rows), table)
    snapshots.take_snapshot(spark, table, store, 1)
    later = rows.where("ticker LIKE '%.A' AND NOT (day(to_date(day)) % 3 = 0 AND volume < 100)")
    later = later.withColumn("close", F.when(F.day(F.to_date("day")) % 7 == 0, F.least("close", F.lit(400.0))).otherwise(F.col("close")))
    tables.write_minute(bars.us_minute(later).where("year(ts) >= 2024"), table)
    snapshots.take_snapshot(spark, table, store, 2, since=1)
    return snapshots.restatements(spark, store, 1, 2)


@query
def column_profiles(spark, sf_dir):
    """Profile of every column of all tables."""
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    found = reduce(DataFrame.unionByName, [tables.column_profile(D.table(spark, sf_dir, n), n) for n in names])
    return rounded(found, 6)


@query
def reconcile_sources(spark, sf_dir):
    """Bars of landed CSV files against bars of landed REST records of another vendor, field by field."""
    root = tables.scratch_folder(spark)
    D.land_csv(D.us_raw_of_years(spark, sf_dir).where("ticker LIKE '%.A'"), f"{root}/landed")
    D.rest_source(spark, sf_dir).where("ticker LIKE '%.A'").write.json(f"{root}/rest")
    a = bars.us_canonical(files.read_us_raw(spark, f"{root}/landed"), rth_only=True)
    b = bars.rest_bars(files.read_rest(spark, f"{root}/rest", schemas.schema("ticker string, t bigint, o double, h double, l double, c double, v double, vw double, n bigint")), F.col("ticker"))
    return tables.reconcile_bars(a, b, tolerance=0.045)


def _minute_factors(spark, sf_dir):
    return factors.forward_returns(factors.factors(factors.bar_panel(D.minute_bars(spark, sf_dir))))


@query
def minute_rank_ic(spark, sf_dir):
    return rounded(factors.rank_ic(_minute_factors(spark, sf_dir), "rev_20b", "fwd_1", "09:52"))


@query
def minute_combo(spark, sf_dir):
    return rounded(factors.combine(_minute_factors(spark, sf_dir)).where("combo IS NOT NULL").select("symbol", "trade_date", "minute", "combo"))


# --- SQL

_YEARS = f"""years AS (
  SELECT * REPLACE (window_start - CASE WHEN ticker LIKE '%.B' THEN CAST(364 AS BIGINT) * 86400000000000 ELSE 0 END AS window_start) FROM us_raw
), ybar AS (
  SELECT *, upper(ticker) AS symbol, timezone('America/New_York', timezone('UTC', make_timestamp(window_start // 1000))) AS et, timezone('America/New_York', timezone('UTC', make_timestamp(window_start // 1000 + 60000000))) AS ts FROM years
), ylab AS (SELECT *, strftime(et, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d') AS trade_date, strftime(ts, '%H:%M') AS minute FROM ybar)"""

def years(select: str) -> str:
    return f"WITH {RAW}, {_YEARS} {select}"


#: Columns of the given tables and their kinds; a list is `other` with a length.
COLUMNS = {
    "region": "r_regionkey:whole r_name:text",
    "nation": "n_nationkey:whole n_name:text n_regionkey:whole",
    "customer": "c_custkey:whole c_name:text c_nationkey:whole c_acctbal:number c_mktsegment:text",
    "supplier": "s_suppkey:whole s_name:text s_nationkey:whole s_acctbal:number",
    "part": "p_partkey:whole p_name:text p_brand:text p_type:text p_size:whole p_retailprice:number",
    "orders": "o_orderkey:whole o_custkey:whole o_orderstatus:text o_totalprice:number o_orderdate:time o_orderpriority:text",
    "lineitem": "l_orderkey:whole l_partkey:whole l_suppkey:whole l_linenumber:whole l_quantity:number l_extendedprice:number l_discount:number l_tax:number l_returnflag:text l_linestatus:text l_shipdate:time",
    "events": "event_id:whole ts:time user_id:whole event_type:text value:number props:text",
    "documents": "doc_id:whole text:text lang:text source:text n_chars:whole",
    "embeddings": "vec_id:whole embedding:list label:whole",
    "pages": "page_id:whole url:text html:text",
    "benchmark": "item_id:whole text:text",
    "labels": "doc_id:whole quality:whole toxic:whole",
    "conversations": "conv_id:whole turn:whole role:text text:text",
}


def _profile(table: str, column: str, kind: str, key: str) -> str:
    value = {"number": f'CASE WHEN NOT isnan("{column}") THEN "{column}" END', "whole": f'CAST("{column}" AS DOUBLE)', "text": f'"{column}"', "time": f'CAST("{column}" AS TIMESTAMP)'}.get(kind)
    shown = "other" if kind == "list" else kind
    parts = [f"'{table}' AS table_name", "count(*) AS n_rows", f"'{column}' AS column_name", f"'{shown}' AS kind", f'count(*) FILTER (WHERE "{column}" IS NULL) AS n_null']
    for to, type_ in (("number", "DOUBLE"), ("text", "VARCHAR"), ("time", "TIMESTAMP")):
        for what in ("min", "max", "sample"):
            found = f"CAST(NULL AS {type_})"
            if value and to == ("number" if kind == "whole" else kind):
                found = f"{what}({value})" if what != "sample" else f"""(min({{'h': md5(CAST("{key}" AS VARCHAR)), 'v': {value}}}) FILTER (WHERE ({value}) IS NOT NULL)).v"""
                found = f"round({found}, 6) + CAST(0 AS DOUBLE)" if to == "number" else found
            parts.append(f"{found} AS {what}_{to}")
    length = f'round(avg(length("{column}")), 6) + CAST(0 AS DOUBLE)' if kind in ("text", "list") else "CAST(NULL AS DOUBLE)"
    return f"SELECT {', '.join([*parts, f'{length} AS mean_length'])} FROM {table}"


_MINUTES = """ev AS (
  SELECT *, event_type || '.' || CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS symbol, strftime(ts, '%Y-%m-%d') AS trade_date,
    570 + least(row_number() OVER (PARTITION BY event_type, user_id % 2 = 0, strftime(ts, '%Y-%m-%d') ORDER BY event_id), 390) AS clock FROM events
), eb AS (
  SELECT symbol, trade_date, lpad(CAST(clock // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(clock % 60 AS VARCHAR), 2, '0') AS minute, arg_max(value, event_id) AS "close", round(avg(value), 6) AS vwap, count(*) * 10 AS volume FROM ev GROUP BY 1, 2, 3
), """
MINUTE_FACTORS = _MINUTES + FACTORS[FACTORS.index("pan AS (") :]
_BAR = "symbol, trade_date, ts, CAST(open AS FLOAT) AS o, CAST(high AS FLOAT) AS h, CAST(low AS FLOAT) AS l, CAST({close} AS FLOAT) AS c, CAST(round(volume) AS BIGINT) AS v"
_DAY = "extract('day' FROM CAST(day AS DATE))"
_CAPPED = f"""CASE WHEN {_DAY} % 7 = 0 THEN least("close", 400) ELSE "close" END"""
_USUAL = f"{_DAY} % 3 < 2"

STORED_SQL: dict[str, str] = {
    "incremental_build": years(
        f"""SELECT symbol, trade_date, {_r('open high low close amount', 4)}, volume, CASE WHEN substr(trade_date, 1, 4) IN (SELECT substr(day, 1, 4) FROM ylab WHERE day >= '{SECOND}') THEN 2 ELSE 1 END AS build
        FROM (SELECT symbol, trade_date, CAST(arg_min(open, ts) AS FLOAT) AS open, CAST(max(high) AS FLOAT) AS high, CAST(min(low) AS FLOAT) AS low, CAST(arg_max("close", ts) AS FLOAT) AS "close",
          CAST(round_even(round(sum(volume), 6), 0) AS BIGINT) AS volume, sum("close" * volume) AS amount FROM ylab WHERE minute > '09:30' AND minute <= '16:00' GROUP BY 1, 2)"""
    ),
    "stored_minute_range": years(
        f"""SELECT trade_date, minute, symbol, {_r('open high low close', 2)}, CAST(round(volume) AS BIGINT) AS volume, transactions AS trade_count FROM ylab
        WHERE minute > '09:30' AND minute <= '16:00' AND symbol IN ('ERROR.A', 'ERROR.B', 'CLICK.B') AND trade_date BETWEEN '2023-01-09' AND '2023-01-20'"""
    ),
    "union_by_name": years(
        "SELECT ticker, "
        + ", ".join(f'CASE WHEN {_USUAL} THEN round(CAST("{c}" AS DOUBLE), 9) + CAST(0 AS DOUBLE) END AS "{c}"' for c in ("volume", "open", "high", "low"))
        + f""", round("close", 9) + CAST(0 AS DOUBLE) AS "close", window_start, CASE WHEN {_USUAL} THEN transactions END AS transactions,
        CASE WHEN NOT {_USUAL} THEN 'v' || CAST(transactions AS VARCHAR) END AS venue, CAST(substr(day, 1, 4) AS INTEGER) AS file_year FROM ylab"""
    ),
    "file_audit": f"""WITH {RAW}, {_YEARS}, {CALENDAR}, landed AS (SELECT DISTINCT day FROM ylab WHERE ticker = 'error.A' AND high > 480)
        SELECT coalesce(trade_date, day) AS day, CASE WHEN day IS NULL THEN 'missing' ELSE 'surplus' END AS state, CAST(CASE WHEN day IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_files
        FROM cal FULL JOIN landed ON trade_date = day WHERE day IS NULL OR trade_date IS NULL""",
    "stored_restatements": years(
        f""", a AS (SELECT {_BAR.format(close='"close"')} FROM ylab), b AS (
          SELECT * FROM a WHERE year(ts) < 2024 UNION ALL
          SELECT {_BAR.format(close=_CAPPED)} FROM ylab WHERE year(ts) >= 2024 AND ticker LIKE '%.A' AND NOT ({_DAY} % 3 = 0 AND volume < 100)
        ), j AS (
          SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.trade_date, b.trade_date) AS trade_date, a.symbol IS NOT NULL AS in_a, b.symbol IS NOT NULL AS in_b,
            a.o IS DISTINCT FROM b.o OR a.h IS DISTINCT FROM b.h OR a.l IS DISTINCT FROM b.l OR a.c IS DISTINCT FROM b.c OR a.v IS DISTINCT FROM b.v AS differs FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts
        ) SELECT symbol, trade_date, nullif(CAST(count_if(in_a) AS BIGINT), 0) AS old_bars, nullif(CAST(count_if(in_b) AS BIGINT), 0) AS new_bars, CASE WHEN count_if(in_a) = 0 THEN 'added' WHEN count_if(in_b) = 0 THEN 'removed' ELSE 'restated' END AS change
        FROM j GROUP BY 1, 2 HAVING bool_or(differs)"""
    ),
    "column_profiles": " UNION ALL ".join(_profile(t, *c.split(":"), columns.split(":")[0]) for t, columns in COLUMNS.items() for c in columns.split()),
    "reconcile_sources": years(
        """, a AS (SELECT symbol, ts, open, high, low, "close", round_even(volume, 0) AS volume FROM lab WHERE ticker LIKE '%.A' AND minute > '09:30' AND minute <= '16:00'), rest AS (
          SELECT upper(event_type) || '.A' AS symbol, timezone('America/New_York', timezone('UTC', date_trunc('minute', ts) + INTERVAL 1 MINUTE)) AS ts, round(arg_min(value, event_id), 1) AS open, round(max(value), 1) AS high,
            round(min(value), 1) AS low, round(arg_max(value, event_id), 1) AS "close", round_even(round(sum(value), 6), 0) AS volume FROM events WHERE event_id % 97 <> 0 AND user_id % 2 = 0 GROUP BY event_type, date_trunc('minute', events.ts)
        ), b AS (SELECT * FROM rest WHERE strftime(ts, '%H:%M') > '09:30' AND strftime(ts, '%H:%M') <= '16:00'), j AS (
          SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, CASE WHEN b.symbol IS NULL THEN 'a' WHEN a.symbol IS NULL THEN 'b' ELSE '' END AS only_in, """
        + ", ".join(f'coalesce(abs(a."{c}" - b."{c}") > 0.045, false) AS diff_{c}' for c in ("open", "high", "low", "close", "volume"))
        + " FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts) SELECT * FROM j WHERE only_in <> '' OR diff_open OR diff_high OR diff_low OR diff_close OR diff_volume"
    ),
    "minute_rank_ic": f"""WITH {MINUTE_FACTORS}, cross_section AS (SELECT trade_date, rev_20b AS x, fwd_1 AS y FROM fac WHERE minute = '09:52' AND rev_20b IS NOT NULL AND fwd_1 IS NOT NULL),
        k AS (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY x) + (count(*) OVER (PARTITION BY trade_date, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY trade_date ORDER BY y) + (count(*) OVER (PARTITION BY trade_date, y) - 1) / 2.0::DOUBLE AS ry FROM cross_section)
        SELECT trade_date, count(*) AS n, round(CASE WHEN count(*) > 1 THEN corr(rx, ry) END, 6) + CAST(0 AS DOUBLE) AS ic FROM k GROUP BY 1""",
    "minute_combo": f"""WITH {MINUTE_FACTORS}, zs AS (SELECT symbol, trade_date, minute, {', '.join(_z(c, -1 if c in ('volatility_20b', 'vwap_close_dev_10b') else 1) for c in _ZS)} FROM fac WINDOW x AS (PARTITION BY trade_date, minute)),
        co AS (SELECT symbol, trade_date, minute, ({' + '.join(f'coalesce(z_{c}, 0)' for c in _ZS)}) / nullif({' + '.join(f'(z_{c} IS NOT NULL)::INTEGER' for c in _ZS)}, 0) AS combo FROM zs)
        SELECT symbol, trade_date, minute, round(combo, 6) + CAST(0 AS DOUBLE) AS combo FROM co WHERE combo IS NOT NULL""",
}
