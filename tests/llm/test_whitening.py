import math
from fractions import Fraction

import numpy as np
import pytest

from tapegrid.llm import whitening
from tapegrid.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, id string, x int, dim int"


def by_force(rows, count=4):
    """Whitening in fractions, products taken directly; and the components for comparison by absolute value."""
    x = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({v for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[a] for v in fit) for a in range(d)]
    cov = [[Fraction(sum((n * v[a] - s[a]) * (n * v[b] - s[b]) for v in fit), n**3) for b in range(d)] for a in range(d)]
    e, u = np.linalg.eigh(np.array(cov, float))
    order = np.argsort(-e)[:count]
    out = {}
    for i, v in x:
        z = [n * v[a] - s[a] for a in range(d)]
        for k, c in enumerate(order):
            out.setdefault((i, k + 1), []).append((n, sum(t * t for t in z), np.array(z, float) / n @ u[:, c] / math.sqrt(e[c]), e[c] / float(sum(cov[a][a] for a in range(d)))))
    return out


def check(found, wanted):
    assert sum(map(len, wanted.values())) == len(found)
    sign = {}
    for r in found:
        n, deviation, whitened, explained = wanted[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / explained - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
        assert abs(abs(r.whitened) - abs(whitened)) < 1e-6 * max(1, abs(whitened))
        if abs(whitened) > 1e-3:
            assert sign.setdefault(r.component, np.sign(r.whitened * whitened)) == np.sign(r.whitened * whitened)


def test_whitening_equals_products(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=7) * [9, 5, 3, 2, 1, 1, 1] + 40).tolist(), "a", 1, 2) for i in range(60)]
    rows += [(100, None, "", 0, 0), (101, [1.0, None, *[2.0] * 5], "", 0, 0), (102, [float("nan"), *[2.0] * 6], "", 0, 0), (103, [float("inf"), *[2.0] * 6], "", 0, 0), *[rows[0]] * 30, (200, rows[1][1], "", 0, 0)]
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), by_force(rows))
    check(whitening.whiten(spark.createDataFrame(rows, SCHEMA), count=9).collect(), by_force(rows, 9))


def test_embeddings_of_a_given_table(spark):
    rows = table(spark, "/root/testdata/sf0.001", "embeddings")
    check(whitening.whiten(rows).collect(), by_force([(r.vec_id, r.embedding) for r in rows.collect()]))


def test_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    one = make([(1, [1.0, 2.0], "", 0, 0), (None, [1.0, 2.0], "", 0, 0), (3, [], "", 0, 0), (4, [1.0], "", 0, 0)])
    assert sorted(map(tuple, one.collect()), key=repr) == sorted([(i, c, 1, 0, None, None, None) for i in (1, None) for c in (1, 2)], key=repr)
    line = make([(k, [float(k), float(2 * k), 5.0], "", 0, 0) for k in range(4)] + [(9, [1.0], "", 0, 0)]).collect()
    assert {r.vec_id for r in line} == {0, 1, 2, 3} and {r.component for r in line} == {1, 2, 3}
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in line) and all(abs(r.explained - (r.component == 1)) < 1e-9 for r in line)
    for none in ([], [(1, None, "", 0, 0)], [(1, [], "", 0, 0)]):
        found = make(none)
        assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    large = make([(1, [3e38, 0.0], "", 0, 0), (2, [3e15, 0.0], "", 0, 0), (3, [1.0, 1.0], "", 0, 0)]).collect()
    assert {(r.vec_id, r.deviation) for r in large} == {(2, None), (3, None)}


@pytest.mark.parametrize("bits", [5, 20, 33, 47, 61])
def test_squares_are_exact(bits):
    rng = np.random.default_rng(bits)
    z = rng.integers(-(1 << bits), 1 << bits, (500, 3))
    z[0, 0], z[1, 1] = -(1 << bits), (1 << bits) - 1
    assert whitening.square_sums(z) == [sum(int(v) ** 2 for v in z[:, c]) for c in range(3)] == whitening.square_sums(z.astype(object))
    assert whitening.exact_sums(z) == [sum(map(int, z[:, c])) for c in range(3)]
    far = whitening.centred(z, 10**9, [7, -(10**14), 3])
    assert far.tolist() == [[10**9 * int(v) - s for v, s in zip(row, [7, -(10**14), 3])] for row in z]
