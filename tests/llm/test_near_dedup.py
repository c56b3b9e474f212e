import math
import random
import re

import numpy as np
import pytest

from tapegrid.llm import common, near_dedup
from tapegrid.llm.components import components
from tapegrid.llm.text_hashes import shingle_sets

SCHEMA = "doc_id long, text string, n_shingles string, component_id int"


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(plain_set(t))
    ids = sorted(x for x in sets if x is not None)
    label = {i: i for i in ids}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sorted(((i, len(plain_set(t)), label.get(i), i is None or label[i] == i) for i, t in rows), key=repr)


def corpus(n=260, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 6, 40, 120]))
        rows.append((i, (" \n"[i % 2]).join(w)))
    return rows


def test_shingles_against_sets():
    texts = ["", " ", "a", "A b\tc", "a b c d e", "a b c d e a b c d e f", "é Ü x " * 30, "x" * 400_000 + " y z", *[t for _, t in corpus()]]
    found = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in found] == [len(plain_set(t)) for t in texts]
    by_hash = {}
    for t, s in zip(texts, found, strict=True):
        assert by_hash.setdefault(s.tobytes(), plain_set(t)) == plain_set(t)


@pytest.mark.parametrize("block", [1024, 16])
def test_links_against_brute_force(spark, block):
    rows = [*corpus(), (1000, None), (1001, "  "), (None, "a b c d e f g"), (1002, "a b c d e f g"), (1003, "same"), (1004, "SAME"), (1004, "SAME")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = near_dedup.near_duplicates(df, block=block)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 10 for k in range(10, 41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


def test_one_document_with_several_sets(spark):
    words = [f"w{k}" for k in range(60)]
    one, other = " ".join(words), " ".join(words[::-1])
    near = " ".join([*words[:59], "x"])
    rows = [(9, one), (3, other), (7, one), (7, other), (7, " "), (5, near), (5, near), (2, "alone in this world of words")]
    found = near_dedup.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), block=2)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_a_posted_coordinate_is_shared_and_counts_are_exact():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 3, (200, near_dedup.COORDINATES)).astype(np.uint8)
    sketch[100:] = sketch[:100]
    for k in range(100, 200):
        sketch[k, rng.choice(near_dedup.COORDINATES, k % 40, replace=False)] = 9
    size = rng.integers(80, 120, 200)
    for similarity in (0.8, 0.85):
        least = near_dedup.least_matches(similarity)
        for i in range(0, 200, 7):
            rest = np.arange(i + 1, 200)
            wanted = [j for j in rest.tolist() if int((sketch[i] == sketch[j]).sum()) >= least and min(size[i], size[j]) >= similarity * max(size[i], size[j]) - 1e-9]
            assert near_dedup.matching(sketch, size, similarity, i, rest).tolist() == wanted
            assert all((sketch[i] == sketch[j])[: near_dedup.prefix(similarity)].any() for j in wanted)


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(4)
    for n in (1, 2, 30, 120):
        link = rng.random((n, n)) < 1.2 / n
        link |= link.T
        home, split = rng.integers(0, max(1, n // 3), n), rng.integers(0, 2, n)
        for h, s in ((None, None), (home, None), (home, split)):
            allowed = link if s is None else link & (s[:, None] != s)
            a, b = near_dedup.forest(n, lambda i, rest: rest[link[i, rest]], h, s)
            assert all(allowed[i, j] for i, j in zip(a, b, strict=True))

            def parts(pairs, n=n, h=h):
                label = list(range(n)) if h is None else [int((h == x).argmax()) for x in h]
                for _ in range(n):
                    for i, j in pairs:
                        low = min(label[i], label[j])
                        old = {label[i], label[j]}
                        label = [low if x in old else x for x in label]
                return label

            assert parts(list(zip(a, b, strict=True))) == parts(np.argwhere(allowed).tolist())


def test_many_near_copies(spark):
    """Each block is joined to the group's first row, so no pair of blocks is left to compare."""
    rng = random.Random(6)
    text = [f"w{rng.randrange(4000)}" for _ in range(200)]
    rows = []
    for i in range(1500):
        copy = list(text)
        copy[rng.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(copy), "x", 1))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=256).collect()
    assert {r.component_id for r in found} == {0}


def test_rows_are_looked_up_alike_by_broadcast_and_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, text string")
    ids = spark.createDataFrame([(1,), (None,), (9,)], "id long")
    for most in (common.MAX_BROADCAST_IDS, 0):
        monkeypatch.setattr(common, "MAX_BROADCAST_IDS", most)
        found = common.among(docs, ids, "id")
        assert sorted(r.text for r in found.collect()) == ["a", "b"] and found.columns == docs.columns


@pytest.mark.parametrize("frequent,most", [(2, 1_000_000), (5, 0), (64, 1_000_000)])
def test_likely_pairs_share_a_rare_post(spark, monkeypatch, frequent, most):
    """Whatever counts as frequent, documents with enough equal pairs meet in their prefixes."""
    monkeypatch.setattr(near_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST_IDS", most)
    rng = np.random.default_rng(3)
    n, least = near_dedup.COORDINATES, near_dedup.least_matches(0.85)
    pairs = rng.integers(0, 4, (150, n)) + 1000 * np.arange(n)
    pairs[75:] = pairs[:75]
    for k in range(75, 150):
        pairs[k, rng.choice(n, k % (n - least + 3), replace=False)] = 10**6 + 1000 * k + np.arange(k % (n - least + 3))
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pairs.tolist())], "id long, pairs array<long>")
    posts = {r.id: set(r.posts) for r in near_dedup.rarest(df, near_dedup.prefix(0.85)).collect()}
    assert len(posts) == 150 and {len(p) for p in posts.values()} == {near_dedup.prefix(0.85)}
    close = [(i, j) for i in range(150) for j in range(i) if (pairs[i] == pairs[j]).sum() >= least]
    assert len(close) > 30 and all(posts[i] & posts[j] for i, j in close) and all(posts[i] <= set(pairs[i].tolist()) for i in posts)


def test_a_common_passage_fills_no_list(spark):
    rng = random.Random(8)
    passage = " ".join(f"c{k}" for k in range(100))
    texts = [f"{passage} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(70))}" for _ in range(400)]
    pairs, _ = near_dedup.signatures(shingle_sets([t.encode() for t in texts]), near_dedup.COORDINATES)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pairs.tolist())], "id long, pairs array<long>")
    sizes = [r.n for r in near_dedup.rarest(df, near_dedup.prefix(0.85)).selectExpr("explode(posts) post").groupBy("post").count().withColumnRenamed("count", "n").collect()]
    fixed = np.unique(pairs[:, : near_dedup.prefix(0.85)], return_counts=True)[1]
    assert sum(x * x for x in sizes if x > 1) < 0.05 * (fixed[fixed > 1].astype(int) ** 2).sum()


def test_links_that_signatures_miss():
    """The chance that a pair at the threshold itself stays under the match threshold."""
    for s in (0.8, 0.85):
        n, least = near_dedup.COORDINATES, near_dedup.least_matches(s)
        missed = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(least))
        assert missed < 5e-6, (s, missed)


def test_joins_of_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 3, k) for k in range(40)] + [(7, 99), (None, 5)], "key int, x int")
    small = spark.createDataFrame([(0, 14, "a"), (1, 13, "b"), (2, 13, "c"), (8, 1, "d")], "key int, n long, name string")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(small, ["key"], how).collect()))
        for most in (1, 13, 1000):
            monkeypatch.setattr(common, "HOT_ROWS", most)
            assert sorted(map(str, common.join_counted(rows, small, ["key"], how=how).collect())) == want


def test_very_long_texts(spark):
    rng = random.Random(11)
    long = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near = [x if k % 40 else "changed" for k, x in enumerate(long)]
    rows = [(5, " ".join(long)), (3, " ".join(near)), (9, " ".join(long[:75_000])), (1, "x" * 2_000_000)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), 75).collect()}
    sets = {i: plain_set(t) for i, t in rows}
    linked = 100 * len(sets[5] & sets[3]) >= 75 * len(sets[5] | sets[3])
    assert linked and found == {i: (len(sets[i]), 3 if i in (3, 5) else i) for i, _ in rows}
