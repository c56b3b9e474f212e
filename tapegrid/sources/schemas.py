"""Schemas of all sources and tables. CSV schemas are positional and in the files' own order."""

from __future__ import annotations

from pyspark.sql.types import StructType


def schema(text: str) -> StructType:
    """A schema from "name type, name type"; unlike fromDDL it needs no session."""
    out = StructType()
    for field in text.split(","):
        name, kind = field.split()
        out.add(name.strip("`"), "long" if kind == "bigint" else kind)
    return out


US_RAW = schema("ticker string, volume double, open double, close double, high double, low double, window_start bigint, transactions bigint")
# Column names of the China files (fixed values): time, code, name, open, close, high, low, volume, amount, change, range.
_CN_PRICES = "`时间` timestamp_ntz, `代码` string, `名称` string, `开盘价` double, `收盘价` double, `最高价` double, `最低价` double"
_CN_END = "`成交额` double, `涨幅` double, `振幅` double"
CN_STOCK_RAW = schema(f"{_CN_PRICES}, `成交量` double, {_CN_END}")
CN_INDEX_RAW = schema(f"{_CN_PRICES}, {_CN_END}")
CN_KEYS = ("时间", "代码")
CN_NAMES = {"时间": "ts", "代码": "code", "名称": "name", "开盘价": "open", "收盘价": "close", "最高价": "high", "最低价": "low", "成交量": "volume", "成交额": "amount", "涨幅": "change", "振幅": "range"}

SPLITS = schema("symbol string, ex_date string, split_ratio double")
DIVIDENDS = schema("symbol string, ex_date string, cash_div double")
CORP_ACTIONS = schema("symbol string, ex_date string, split_ratio double, cash_div double")

REST_BARS = schema("t bigint, o double, h double, l double, c double, v double, vw double, n bigint")
REST_TICKERS = schema("ticker string, name string, primary_exchange string, active boolean, delisted_utc string, market string, snapshot_date string")
REST_SPLITS = schema("ticker string, execution_date string, split_from double, split_to double")
REST_DIVIDENDS = schema("ticker string, ex_dividend_date string, cash_amount double")
