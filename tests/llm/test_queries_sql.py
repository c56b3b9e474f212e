import pytest

from tapegrid.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, sql = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    ours = sorted((tuple(r[c] for c in sql.columns) for r in df.collect()), key=repr)
    assert ours == sorted(sql.fetchall(), key=repr) and ours


def test_names():
    assert sorted({int(n[2 : n.index("_")]) for n in QUERIES}) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
