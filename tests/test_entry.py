import datetime as dt
import math

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = ["us_daily", "us_close_label", "normalize_symbol", "cn_daily", "listing_dedup", "corp_actions", "adjusted_close", "market_features", "market_catalog", "missing_days", "detect_restatements", "factor_panel"]


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    sql = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    theirs = sorted(([plain(r[sql.columns.index(c)]) for c in order] for r in sql.limit(10**9).fetchall()), key=repr)
    assert ours == theirs and ours


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("hidden,fails", [(["tapegrid.llm", "corpus_pipeline"], False), (["public_tokenizers"], False), (["tapegrid.llm.common"], True)])
def test_imports_of_what_is_not_there(monkeypatch, hidden, fails):
    """Without the folder or one of its libraries the other queries are left; a module that is missing inside the folder is an error."""
    import importlib

    importing = importlib.import_module

    def gone(name, package=None):
        if name in ("tapegrid.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {hidden[0]!r}", name=hidden[0])
        return importing(name, package)

    monkeypatch.setattr(importlib, "import_module", gone)
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, package=None: None if name in hidden else object())
    if fails:
        with pytest.raises(ImportError):
            entry.queries()
    else:
        assert set(CORE) <= set(entry.queries()) and not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
