import hashlib
import random

import numpy as np
import pytest

from tapegrid.llm import common, substring_dedup
from tapegrid.llm.suffix_sorting import adjacent_prefixes, heads, rising, suffix_array

SCHEMA = "doc_id long, text string, n_bytes string, key int"


@pytest.mark.parametrize("alphabet", [1, 2, 4, 200])
def test_suffix_array_against_sorting(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 17, 400):
        body = rng.integers(1, alphabet + 1, n).astype(np.uint8)
        body[rng.random(n) < 0.05] = 0
        text = np.append(body, 0).astype(np.uint8)
        raw = text.tobytes()
        found = suffix_array(text, heads(text), 56)
        assert sorted(found.tolist()) == list(range(len(text)))
        pad = raw + bytes(600)
        assert [pad[p : p + 56] for p in found] == sorted(pad[p : p + 56] for p in range(len(text)))
        same = adjacent_prefixes(heads(text), found, 10)
        assert same.tolist() == [pad[a : a + 10] == pad[b : b + 10] for a, b in zip(found[:-1].tolist(), found[1:].tolist(), strict=True)]
        up = rising(text)
        assert all(up[p] == (raw[p:] < raw[p + 1 :]) for p in range(len(raw)) if raw[p])


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        t = (t or "").encode()
        for p in range(len(t) - length + 1 if i is not None else 0):
            first[t[p : p + length]] = min(i, first.get(t[p : p + length], i))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1 if i is not None else 0):
            if first[t[p : p + length]] < i:
                gone[1 + p : 1 + p + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "é", "ção", "\n", " ", "  ", ". ", "日"]
    made = []
    for _ in range(n):
        text = "".join(rng.choices(syllables, k=rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            if made:
                other = rng.choice(made)
                a = rng.randint(0, len(other))
                at = rng.randint(0, len(text))
                text = text[:at] + other[a : a + rng.randint(20, 120)] + text[at:]
        made.append(rng.choice([text, text, text, rng.choice(made or [text]), "ab" * rng.randint(0, 90), "x" * rng.randint(0, 130)]))
    return list(enumerate(made))


@pytest.mark.parametrize("unit", [1 << 20, 300])
def test_against_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(substring_dedup, "SORT_UNIT", unit)
    monkeypatch.setattr(substring_dedup, "TEXT_UNIT", 4 * unit)
    rows = corpus(220, 4)
    rows += [(1000, None), (None, rows[5][1]), (1001, "a" * 49), (1002, "a" * 50), (1003, "a" * 50), (1003, "a" * 50), (-5, rows[7][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, substring_dedup.remove_repeats(df).collect()), key=repr) == brute(rows)


def test_texts_with_one_id(spark):
    rows = corpus(60, 9)
    rows += [(i, t) for (i, _), (_, t) in zip(rows[:30], rows[20:50], strict=True)]
    passage = "what two texts of one id share is removed from neither of them, but from later ids it is"
    # The largest and smallest ids there are, and one with two texts that share a passage, twice.
    rows += [(2**63 - 1, passage), (2**63 - 1, "x" + passage), (2**63 - 2, passage + " one"), (2**63 - 2, "two " + passage), (2**63 - 2, "two " + passage), (-(2**63), passage[:60])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert sorted(map(tuple, substring_dedup.remove_repeats(df).collect()), key=repr) == brute(rows)
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_hot_copies_and_very_long_texts(spark, monkeypatch, most):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(substring_dedup, "MAX_BROADCAST", most)
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh ", k=150_000))
    rows = [(k, "the same text of more than fifty bytes in a third of all rows") for k in range(12)] + [(20 + k, "") for k in range(12)] + [(40 + k, None) for k in range(3)]
    rows += [(50, long), (51, "x" + long[70_000:71_000] + "y"), (52, long[100:149_000] + "tail"), (53, "a short one")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, substring_dedup.remove_repeats(df).collect()), key=repr) == brute(rows)
