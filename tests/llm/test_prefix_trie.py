import hashlib
import math
import random
import zlib

import pytest

from tapegrid.llm import prefix_trie
from tapegrid.llm.common import table
from tapegrid.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs int, f1 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_force(rows):
    """The trie of whole rebuilt texts."""
    own: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes: dict = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    out = []
    for path, found in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c, last in found if last)))
        out.append((min(c for c, _ in found), len(path), min(c for c, _ in nodes[path[:-1]]) if path else None, len(found), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed: int, n: int, words: int, longest: int):
    rng = random.Random(seed)
    parts = ["", "a", "é", "日本", "aa", None, "b" * 50]
    rows = [(c, rng.choice([None, k, k]), rng.choice(["user", "bot", None]), rng.choice(parts[:words]), "x", 1, "y") for c in rng.sample(range(-n, 2 * n), n) for k in range(rng.randint(1, longest))]
    rows += rng.sample(rows, len(rows) // 5)
    rng.shuffle(rows)
    return rows


def found(df):
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed,n,words,longest", [(1, 12, 1, 12), (2, 40, 3, 14), (3, 40, 7, 10)])
def test_trie_equals_whole_texts(spark, seed, n, words, longest):
    rows = conversations(seed, n, words, longest)
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_force(rows)


def test_conversations_over_many_parts(spark, monkeypatch):
    """One conversation has most turns, and one ending most conversations; parts aren't put together and pieces are small."""
    monkeypatch.setattr(prefix_trie, "PIECE", 160)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        over_many_parts(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def over_many_parts(spark):
    rows = [(5, k, "u", f"t{k % 7}", "", 0, "") for k in range(900)] + [(8, k, "u", f"t{k % 7}", "", 0, "") for k in range(700)]
    rows += [(c, 0, "u", "same", "", 0, "") for c in range(1000, 1600)]
    assert prefix_trie.scanned(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA), (1, 2))).where("conv_id = 5").select("part").distinct().count() > 1
    some = [r for r in rows if r[1] < 40 or r[0] < 8 and r[1] < 60]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(some, SCHEMA))) == by_force(some)
    whole = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    deepest = whole.orderBy("depth", ascending=False).first()
    assert (deepest.depth, deepest.n_convs) == (900, 1) and whole.where("depth = 0").first().n_convs == 602


def test_odd_tables(spark):
    make = lambda rows: found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert make([]) == [] == make([(None, 1, "u", "x", "", 0, "")])
    long = [(10, 0, "u", "wort " * 100_000, "", 0, ""), (11, 0, "u", "wort " * 100_000, "", 0, ""), (None, 0, "u", "x", "", 0, ""), (-3, None, None, None, "", 0, "")]
    assert make(long) == by_force(long)


def test_clashing_hashes_are_seen(spark):
    rows = conversations(4, 30, 7, 8)
    df = prefix_trie.turns(spark.createDataFrame(rows, SCHEMA), (1, 2))
    assert not prefix_trie.hashes_clash(df)
    weak = df.withColumns({"g1": df.g1 % 2, "g2": df.g1 % 1})
    assert prefix_trie.hashes_clash(weak)
    members = prefix_trie.members(prefix_trie.composed(prefix_trie.scanned(df)))
    assert prefix_trie.trie(members) is not None and prefix_trie.trie(members.withColumns({"f1": members.f1 % 3, "f2": members.f2 % 2})) is None


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.001/conversations.parquet')")
    name = "op13_fingerprint_trie"
    ours = found(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert ours == sorted(con.sql(SQL[name]).select(*COLUMNS).fetchall(), key=repr)
    assert ours == by_force([tuple(r) for r in table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()])
