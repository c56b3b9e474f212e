import itertools
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapegrid.llm import ball_tree, hilbert_sharding, language_id
from tapegrid.llm.common import table

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("held_out", language_id.held_out())
    found = language_id.predict(docs, language_id.profiles(docs.where(~F.col("held_out")))).toPandas()
    true = docs.select("doc_id", "lang", "held_out").toPandas().merge(found, on="doc_id")
    true = true[true.held_out]
    assert len(true) > 100 and (true.lang == true.lang_pred).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in true.doc_id)


def test_languages_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred int, score string"
    docs = spark.createDataFrame([(1, "aaa bbb", "a", 1, "x"), (2, "xyz xyz", "x", 1, "x"), (3, None, "a", 1, ""), (None, "aaa", None, 1, ""), (5, "12 ?!", None, 1, ""), (6, "", None, 1, ""), (7, "aab aab", None, 1, ""), (7, "aab aab", None, 1, "")], schema)
    learned = language_id.profiles(docs.where("lang IS NOT NULL"))
    found = sorted(map(tuple, language_id.predict(docs, learned).select("doc_id", "lang_pred").collect()), key=repr)
    assert found == sorted([(1, "a"), (2, "x"), (3, "und"), (None, "a"), (5, "und"), (6, "und"), (7, "a"), (7, "a")], key=repr)
    empty = spark.createDataFrame([], schema)
    assert language_id.predict(empty, learned).collect() == [] and len(language_id.profiles(empty)) == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.profiles(empty)).collect()} == {"und"}


def test_profile_and_distance_by_hand(spark):
    letters = language_id.Letters()
    gram, count = language_id.counted(language_id.grams(letters("Ab, ab")))
    text = {"".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(g) >> s): int(n) for g, n in zip(gram, count, strict=True)}
    assert text == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2, "b a": 1}


@pytest.mark.parametrize("bits,n", [(3, 2), (2, 3), (2, 4)])
def test_hilbert_steps_are_neighbours(bits, n):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    index = hilbert_sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_shards_are_even_and_gapless(spark):
    docs = table(spark, SF, "documents")
    rows = docs.withColumn("size", F.lit("clash")).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "cast(null as string) lang", "source", "cast(null as long) n_chars", "'x' size"))
    found = hilbert_sharding.hilbert_shards(rows, ["lang", "source", "n_chars"], 7).toPandas()
    n = found.groupby("shard").size()
    assert len(found) == rows.count() and n.max() - n.min() <= 1 and len(n) == 7
    for _, s in found.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found[found.doc_id.notna()].itertuples():
        raw = texts[int(r.doc_id)].encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    assert found[found.doc_id.isna()]["size"].tolist() == [16]
    assert (found.sort_values(["shard", "slot"]).hilbert.diff().dropna() >= 0).all()
    few = hilbert_sharding.hilbert_shards(rows.limit(3), ["lang"], 40).toPandas()
    assert sorted(few.shard) == [0, 1, 2] and set(few.slot) == {0}
    assert hilbert_sharding.hilbert_shards(rows.limit(0), ["lang"]).collect() == []


def brute(rows: pd.DataFrame, k: int, every: int) -> list[tuple]:
    out = []
    for q in rows[rows.vec_id % every == 0].itertuples():
        scored = sorted((-sum(a * b for a, b in zip(q.v, c.v, strict=True)), c.vec_id) for c in rows.itertuples() if c.vec_id != q.vec_id and len(c.v) == len(q.v))
        out += [(q.vec_id, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows", [(8192, 2048), (60, 3)])
def test_top_k_against_brute_force(spark, shard_rows, block_rows):
    vectors = table(spark, SF, "embeddings").where("vec_id < 300")
    data = vectors.toPandas()
    data["v"] = [[int(np.floor(64 * float(x))) for x in e] for e in data.embedding]
    found = ball_tree.top_k(vectors, 20, 20, 64, shard_rows=shard_rows, block_rows=block_rows)
    assert sorted(map(tuple, found.collect())) == brute(data, 20, 20)


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (-20, [1.0, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (None, [1.0, 1.0]), (40, None), (60, []), (80, [1.0, None]), (100, [nan, 1.0]), (5, [inf, 1.0]), (120, [1e9, 1e9]), (140, [1.0, 2.0, 3.0])]
    schema = "vec_id long, embedding array<double>, score string, rank int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    used = [(0, [64, 0]), (-20, [64, 64]), (20, [64, 64]), (3, [64, 64]), (4, [64, 64]), (120, [64 * 10**9] * 2), (140, [64, 128, 192])]
    # 120 with itself left out: its products with the others fit.
    for size in (8192, 2):
        assert sorted(map(tuple, ball_tree.top_k(df, 3, 20, 64, shard_rows=size).collect())) == brute(pd.DataFrame(used, columns=["vec_id", "v"]), 3, 20)
    assert ball_tree.top_k(df.limit(0)).collect() == []


def test_strings_are_cut_as_a_whole(spark):
    rows = [(k, f"https://example.org/page/{k:05d}", k % 40) for k in range(800)] + [(800, None, 1), (801, "https://example.org/page/00003", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, url string, n int").withColumn("text", F.col("url"))
    found = hilbert_sharding.hilbert_shards(docs, ["url"], 4).toPandas()
    cells = found.hilbert.nunique()
    assert 31 <= cells <= 33
    # In one dimension the curve is the order of the values.
    by_id = found[found.doc_id < 800].sort_values("doc_id")
    assert (by_id.hilbert.diff().dropna() >= 0).all() and found[found.doc_id == 800].hilbert.max() == 0


def test_written_shards_let_filters_skip_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"doc_id": np.arange(4000), "text": "x", "a": rng.random(4000), "b": rng.random(4000)})
    path = str(tmp_path / "shards")
    hilbert_sharding.write_shards(spark.createDataFrame(data), path, ["a", "b"], 16)
    ranges = spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"), *[f(c).alias(n + c) for c in "ab" for f, n in ((F.min, "min"), (F.max, "max"))]).toPandas()
    assert ranges.n.tolist() == [250] * 16
    # A square of a hundredth of the plane meets a few of the sixteen shards, in either dimension alone about half at most.
    hit = ranges[(ranges.maxa >= 0.6) & (ranges.mina <= 0.7) & (ranges.maxb >= 0.2) & (ranges.minb <= 0.3)]
    assert len(hit) <= 4
    for c in "ab":
        assert ((ranges["max" + c] >= 0.6) & (ranges["min" + c] <= 0.7)).sum() <= 9


def plain_grams(text):
    """n-grams of a text, the most frequent first, in plain Python."""
    low = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    while "  " in low:
        low = low.replace("  ", " ")
    found = {}
    for n in (1, 2, 3):
        for k in range(len(low) - n + 1):
            if (g := low[k : k + n]) != " ":
                found[g] = found.get(g, 0) + 1
    return found


def plain_order(counts, size):
    # Ties by code: code points in 21 bits each.
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def test_predictions_equal_plain_distances(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    rows = docs.collect()
    total = {}
    for r in rows:
        if not r.held_out and r.lang is not None and r.text is not None:
            for g, n in plain_grams(r.text).items():
                total.setdefault(r.lang, {}).setdefault(g, 0)
                total[r.lang][g] += n
    profile = {lang: {g: k for k, g in enumerate(plain_order(counts, 300))} for lang, counts in total.items()}
    long = "na\u00efve \u0130x \u00df " * 5000
    extra = [(10**6, long), (10**6 + 1, "a"), (10**6 + 2, None), (10**6 + 3, "1 2")]
    asked = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = {r.doc_id: r for r in language_id.predict(asked, language_id.profiles(docs.where("NOT held_out"))).collect()}
    for i, text in [*((r.doc_id, r.text) for r in rows), *extra]:
        own = plain_order(plain_grams(text or ""), 300)
        if not any(c.isalpha() for c in text or ""):
            assert (found[i].lang_pred, found[i].score) == ("und", 0)
            continue
        distance = {lang: sum(abs(ranks[g] - k) if g in ranks else 300 for k, g in enumerate(own)) for lang, ranks in profile.items()}
        best = min(sorted(distance), key=distance.get)
        assert found[i].lang_pred == best and found[i].score == pytest.approx(1 - distance[best] / (300 * len(own))), i


def test_a_rare_language_keeps_its_profile(spark):
    rows = [(k, "common words of a large language") for k in range(5000)]
    docs = spark.createDataFrame([(i, t, "large") for i, t in rows] + [(9000 + k, "xyzzy plugh qwfp", "rare") for k in range(3)], "doc_id long, text string, lang string")
    learned = language_id.profiles(docs, max_training=100)
    assert set(learned.lang) == {"large", "rare"}
    assert [r.lang_pred for r in language_id.predict(spark.createDataFrame([(1, "plugh xyzzy")], "doc_id long, text string"), learned).collect()] == ["rare"]


def test_written_shards_hold_each_row_once(spark, tmp_path):
    rows = [(None, "a", 1, 7, "h"), (None, "b", 2, 7, "h"), (3, "c", 3, 7, "h"), (3, "c", 3, 7, "h"), (3, "other", 4, 7, "h"), *[(k, f"t{k}" * (k % 9), k % 5, 8, None) for k in range(10, 60)], (70, "x" * 300_000, 1, 1, ""), (71, None, None, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, hilbert int, lang string")
    path = str(tmp_path / "shards")
    hilbert_sharding.write_shards(docs, path, ["lang", "shard"], 5)
    found = spark.read.parquet(path)
    assert sorted(found.select("doc_id", "text", "shard_", "hilbert", "lang").collect(), key=repr) == sorted(docs.collect(), key=repr)
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    hilbert_sharding.write_shards(docs.limit(0), f"{path}-none", ["lang"], 5)


def test_cells_are_skipped_and_few_nodes_visited(spark):
    """Clustered vectors: a query with its k-th score enters few cells, and few nodes of a tree."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 12)) * 40
    v = np.floor(centers[rng.integers(0, 30, 6000)] * 10 + rng.normal(size=(6000, 12)) * 20)
    cells = ball_tree.Cells.cut(v[:2000], 60, 0)
    of = cells.of(v)
    cells.sizes = np.bincount(of, minlength=len(cells.centers))
    cells.radius = np.array([np.sqrt(((v[of == c] - cells.centers[c]) ** 2).sum(1)).max() if (of == c).any() else 0 for c in range(len(cells.centers))])
    q = v[::100]
    scores = q @ v.T
    least = np.sort(scores, 1)[:, -20]
    top = cells.bounds(q)
    for c in range(len(cells.centers)):
        assert (top[:, c] >= scores[:, of == c].max(1, initial=-np.inf)).all()
    entered = top >= least[:, None]
    assert entered[:, cells.sizes > 0].mean() < 0.35 and all(entered[np.arange(len(q)), of[scores[np.arange(len(q)), :].argmax(1)]])
    tree = ball_tree.BallTree(np.arange(6000), v)
    score, found = np.full((len(q), 20), -np.inf), np.full((len(q), 20), -1, np.int64)
    tree.search(np.full(len(q), -1), q, 20, score, found)
    assert np.array_equal(score, -np.sort(-scores, 1)[:, :20]) and tree.visited < 0.35 * len(q) * len(tree.nodes)


@pytest.mark.parametrize("wider,cells,queries", [(2, 4096, 7), (8, 5, 262_144)])
def test_top_k_over_rounds_and_hot_cells(spark, monkeypatch, wider, cells, queries):
    for name, value in (("WIDER", wider), ("CELLS", cells), ("QUERY_ROWS", queries), ("SAMPLE", 150)):
        monkeypatch.setattr(ball_tree, name, value)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 5)) * 3
    v[100:250] = v[100]  # more than a third of all rows are one vector
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(1000 + 20 * k, rng.normal(size=3).tolist()) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    data = pd.DataFrame([(i, [int(np.floor(64 * c)) for c in x]) for i, x in rows], columns=["vec_id", "v"])
    assert sorted(map(tuple, ball_tree.top_k(df, 20, 20, 64, shard_rows=30, block_rows=4).collect())) == brute(data, 20, 20)
