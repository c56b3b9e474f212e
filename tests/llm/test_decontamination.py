import random
import re
from itertools import combinations

import pytest

from tapegrid.llm import common, decontamination

DOCS, ITEMS = "doc_id long, text string, at string, item int", "item_id long, text string, words string"


def w(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def brute(docs, items, window=25, similarity=0.8):
    """Best count of equal words over all windows of each way to lay an item on a document that a seed allows; items of up to 11 words need none."""
    out = {}
    for d, t in docs:
        a = w(t)
        for i, it in items:
            b = w(it)
            n = min(len(b), window)
            for place in range(-len(b) + 1, len(a)):
                same = [0 <= place + k < len(a) and a[place + k] == x for k, x in enumerate(b)]
                met = len(b) <= decontamination.OWN_MASKS or any(all(same[q + k] for k, c in enumerate(m) if c == "1") and 0 <= place + q <= len(a) - len(m) for m in decontamination.MASKS for q in range(len(b) - len(m) + 1))
                best = max(sum(same[k : k + n]) for k in range(len(b) - n + 1))
                if met and best / n >= similarity:
                    out[d, i] = max(best, out.get((d, i), 0))
    return sorted((d, i, m) for (d, i), m in out.items())


@pytest.mark.parametrize("most", [200_000, 0])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MAX_BROADCAST", most)
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", most)
    rng = random.Random(5)
    v = [f"V{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(v, k=n))) for k, n in enumerate([3, 6, 8, 9, 12, 20, 30, 60, 40, 25])]
    docs = []
    for d in range(60):
        text = rng.choices(v, k=rng.randint(0, 60))
        if d % 2:
            piece = rng.choice(items)[1].split()
            piece = [x if rng.random() > 0.12 else "zz" for x in piece]
            cut = rng.randint(0, len(piece) // 2) if d % 3 == 0 else 0
            at = rng.randint(0, len(text))
            text[at:at] = piece[cut:]
        docs.append((d, (" \t" * (d % 2) + " ").join(text).lower()))
    wanted = brute(docs, items)
    assert len(wanted) > 10
    odd = [(1000, None), (1001, " "), (1002, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in [*docs, *odd, docs[1]]], DOCS)
    it = spark.createDataFrame([(*r, "x") for r in [*items, (50, None), (51, " "), items[3]]], ITEMS)
    found = decontamination.contaminated(df, it)
    assert sorted((r.doc_id, r.item_id, r.matched) for r in found.collect()) == wanted
    assert found.columns == ["doc_id", "item_id", "similarity", "matched", "compared", "at", "hits"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c", "x", 1)], DOCS), spark.createDataFrame([(1, "a b c", "x")], ITEMS)
    assert [tuple(r)[:2] for r in decontamination.contaminated(docs, items).collect()] == [(1, 1)]
    assert decontamination.contaminated(docs.limit(0), items).collect() == []
    assert decontamination.contaminated(docs, items.limit(0)).collect() == []


def test_all_windows_and_short_items(spark):
    rng = random.Random(3)
    v = [f"V{k}" for k in range(2000)]
    items = [(k, " ".join(rng.sample(v, n))) for k, n in enumerate([60, 75, 90, 8, 7, 6, 5, 4])]
    docs = []
    for d in range(200):
        piece = items[d % 8][1].split()
        begin = rng.randint(0, max(0, len(piece) - 25))
        piece = piece[begin : begin + 25]
        for k in rng.sample(range(len(piece)), rng.randint(3, 5) if len(piece) == 25 else 1):
            piece[k] = "zz"
        docs.append((d, " ".join(["aa"] * (d % 4) + piece + ["bb"] * 30)))
    wanted = {(d, i): m for d, i, m in brute(docs, items)}
    assert len(wanted) > 120 and {i for _, i in wanted} >= {0, 1, 2, 3, 4, 5, 6}
    found = decontamination.contaminated(spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS), spark.createDataFrame([(*r, "x") for r in items], ITEMS)).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in found} == wanted
    for r in found:
        assert r.compared == min(25, len(w(items[r.item_id][1]))) and r.similarity == r.matched / r.compared


def test_repeated_rows_and_rows_without_ids(spark):
    item = " ".join(f"b{k}" for k in range(12))
    rows = [(1, "x " + item), (None, item + " y"), (None, item + " z"), (None, None), (2, "nothing of it")]
    items = spark.createDataFrame([(7, item, "x"), (None, item, "x")], ITEMS)
    once = decontamination.contaminated(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS), items).collect()
    assert sorted(((r.doc_id, r.item_id, r.at) for r in once), key=repr) == sorted([(1, 7, 1), (1, None, 1), *[(None, i, 0) for i in (7, None)] * 2], key=repr)
    hits = {r.hits for r in once}
    assert len(hits) == 1
    again = decontamination.contaminated(spark.createDataFrame([(*r, "x", 1) for r in rows * 4], DOCS), items).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, once))


def test_a_very_long_text(spark):
    item = " ".join(f"b{k}" for k in range(30))
    text = " ".join(f"w{k % 977}" for k in range(100_000)) + " " + item
    found = decontamination.contaminated(spark.createDataFrame([(1, text, "x", 1)], DOCS), spark.createDataFrame([(7, item, "x")], ITEMS)).collect()
    assert [(r.doc_id, r.item_id, r.matched) for r in found] == [(1, 7, 25)] and 100_000 <= found[0].at <= 100_005


@pytest.mark.parametrize("n,least", [(5, 1), (8, 1), (9, 1), (10, 1), (11, 1), (12, 1), (14, 1), (15, 0.99), (16, 0.99)])
def test_recall_of_all_substitutions(spark, n, least):
    """Every way to substitute as many words as an overlap allows, with nothing equal outside the passage."""
    differ = max(t for t in range(n) if t == 0 or (n - t) / n >= 0.8)
    item = [f"b{k}" for k in range(n)]
    docs = [(d, " ".join(["x", *["y" if k in left_out else word for k, word in enumerate(item)], "z"])) for d, left_out in enumerate(combinations(range(n), differ))]
    found = decontamination.contaminated(spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS), spark.createDataFrame([(1, " ".join(item), "x")], ITEMS)).collect()
    assert {r.matched for r in found} == {n - differ} and least * len(docs) <= len({r.doc_id for r in found}) <= len(docs)
