"""Symbol rules of the two equity markets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exchange of a symbol's suffix (fixed values).
CN_EXCHANGES = {"SH": "XSHG", "SZ": "XSHE", "BJ": "BSE"}


def safe_symbol(symbol: Column) -> Column:
    """A symbol that can stand in a path: capitals, and _ for anything but letters, digits, _ . and -."""
    return F.regexp_replace(F.upper(symbol), r"[^A-Za-z0-9_.\-]", "_")


def cn_stock_symbol(code: Column) -> Column:
    """sh600000 -> 600000.SH"""
    return F.concat(F.substring(code, 3, 100), F.lit("."), F.upper(F.substring(code, 1, 2)))


def cn_index_symbol(code: Column) -> Column:
    """Index codes get the exchange of their number range; Shanghai unless known otherwise."""
    return F.concat(code, F.when(code.startswith("39"), ".SZ").when(code.startswith("899"), ".BJ").otherwise(".SH"))


def cn_exchange(symbol: Column) -> Column:
    suffix = F.element_at(F.split(symbol, r"\."), -1)
    out = suffix
    for ending, name in CN_EXCHANGES.items():
        out = F.when(suffix == ending, name).otherwise(out)
    return out


def normalize_symbol(raw: Column) -> Column:
    """Trimmed capitals; what follows the first colon goes, and so does a last .US, .O, .N or .OQ, unless nothing is left."""
    clean = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(clean, r"(?s)^([^:]+):.*$", "$1"), r"^(.+)\.(US|O|N|OQ)$", "$1")
