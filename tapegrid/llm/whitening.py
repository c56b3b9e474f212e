"""Operator 11: whitening of embeddings with a covariance from polarised squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.llm.common import cut_lineage, map_arrow

#: Rows whose pair sums are made at a time.
PAIR_ROWS = 2048
#: Bits of a limb of an exact sum; limbs of any number of tasks add up in a long.
LIMB = 40
_OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def coded(embeddings: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, x, dim of the vectors that take part: x holds floor(scale * entry) as little-endian whole numbers of the fewest bytes of 2, 4 and 8 that hold a vector's.

    Equal vectors have equal bytes. Null vectors, and those with an entry that is
    null or not finite, or doesn't fit a long once scaled, take no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, dims = [], [], []
            lists = batch.column(1).cast(pa.large_list(pa.float64()))
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum())) if len(lists) else lists.values
            values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.to_numpy(zero_copy_only=False)).astype(float)
            ends = np.cumsum(sizes)
            fits = np.isfinite(values) & (np.abs(scale * np.where(np.isfinite(values), values, 0)) < 2.0**63)
            bad = np.r_[0, np.cumsum(~fits)]
            good = (bad[ends] == bad[ends - sizes]) & (sizes > 0) & ~batch.column(1).is_null().to_numpy(zero_copy_only=False)
            whole = np.floor(scale * np.where(fits, values, 0)).astype(np.int64)
            for row in np.flatnonzero(good).tolist():
                v = whole[ends[row] - sizes[row] : ends[row]]
                low, high = int(v.min()), int(v.max())
                kind = next((k for k in ("<i2", "<i4") if np.iinfo(k).min <= low and high <= np.iinfo(k).max), "<i8")
                x.append(kind[-1].encode() + v.astype(kind).tobytes())
                dims.append(len(v))
                ids.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(x, pa.binary()), pa.array(dims, pa.int32())], ["id", "x", "dim"])

    return map_arrow(embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), work, "id long, x binary, dim int")


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Coded vectors of one length as rows of whole numbers."""
    out = np.empty((len(column), dim), np.int64)
    for k, raw in enumerate(column.to_pylist()):
        out[k] = np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1)
    return out


def exact_sums(columns: np.ndarray) -> list[int]:
    """The sum of each column, whatever its size."""
    top = int(np.abs(columns.astype(float)).max(initial=0))
    if columns.dtype != object and top * len(columns) >= 1 << 62:
        columns = columns.astype(object)
    return [int(s) for s in columns.sum(0)] if len(columns) else [0] * columns.shape[1]


def square_sums(z: np.ndarray) -> list[int]:
    """The exact sum of z * z down each column: whole numbers of 64 bits, or Python's own (dtype object)."""
    if z.dtype == object:
        return [int(s) for s in (z * z).sum(0)]
    bits = max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0)))).bit_length()
    if 2 * bits + len(z).bit_length() <= 62:
        return (z * z).sum(0).tolist()
    # In limbs of 24 bits, the highest signed, so that products and their sums stay within 62 bits.
    limbs = [(z >> 24 * k) & 0xFFFFFF if 24 * (k + 1) < bits + 1 else z >> 24 * k for k in range(max(1, -(-(bits + 1) // 24)))]
    out = np.zeros(z.shape[1], object)
    for i, a in enumerate(limbs):
        for j in range(i, len(limbs)):
            out = out + ((a * limbs[j]).sum(0).astype(object) << 24 * (i + j)) * (1 if i == j else 2)
    return [int(s) for s in out]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums without overflow: in 64 bits where these and the sums of two hold them, else in Python's numbers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if 2 * (n * most + max(map(abs, sums), default=0)) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _limbs(numbers: list[int]) -> pa.RecordBatch:
    """Exact numbers as rows place, limb, value; the sum over limbs of value << (LIMB * limb) is the number."""
    place, limb, value = [], [], []
    for k, number in enumerate(numbers):
        sign, rest, at = (1 if number >= 0 else -1), abs(number), 0
        while rest:
            place.append(k)
            limb.append(at)
            value.append(sign * (rest & ((1 << LIMB) - 1)))
            rest >>= LIMB
            at += 1
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["place", "limb", "value"])


def exact_totals(fit: DataFrame, size: int, numbers) -> list[int]:
    """`size` exact sums over all rows of fit (column x). numbers(batch) gives a batch's; each task adds up its own, and Spark the tasks' limbs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            for at in range(0, batch.num_rows, PAIR_ROWS):
                total = [a + b for a, b in zip(total, numbers(batch.column(0).slice(at, PAIR_ROWS)), strict=True)]
        yield _limbs(total)

    out = [0] * size
    # size is bounded by the dimensions, squared, not by the rows.
    for r in map_arrow(fit.select("x"), work, "place int, limb int, value long").groupBy("place", "limb").agg(F.sum("value").alias("value")).toLocalIterator():
        out[r.place] += r.value << (LIMB * r.limb)
    return out


def polarised(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums of each dimension, and n ** 3 times the covariances over the rows of fit, all exact.

    The squares of the centred n * x - S are summed for each dimension, and for each
    sum of two dimensions. What the square of a sum has more than the squares of its
    parts is twice their product: cov(a, b) = (var(a + b) - var(a) - var(b)) / 2.
    """
    counted = exact_totals(fit, dim + 1, lambda c: [len(c), *exact_sums(_vectors(c, dim))])
    n, sums = counted[0], counted[1:]

    def squares(column: pa.Array) -> list[int]:
        z = centred(_vectors(column, dim), n, sums)
        return square_sums(z) + [s for a in range(dim - 1) for s in square_sums(z[:, a : a + 1] + z[:, a + 1 :])]

    found = exact_totals(fit, dim + dim * (dim - 1) // 2, squares)
    cov = [[0] * dim for _ in range(dim)]
    pairs = iter(found[dim:])
    for a in range(dim):
        cov[a][a] = found[a]
        for b in range(a + 1, dim):
            cov[a][b] = cov[b][a] = (next(pairs) - found[a] - found[b]) // 2
    return n, sums, cov


def components(n: int, cov: list[list[int]], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projection (dimensions x components), 1 / sqrt(e) and e / trace of the first components by falling eigenvalue.

    A component without variance has no projection: nan. The sign is such that the
    largest entry of a component, by size, is above 0.
    """
    values, vectors = np.linalg.eigh(np.array([[c / n**3 for c in row] for row in cov]))
    order = np.argsort(-values, kind="stable")[:count]
    e, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    trace = sum(cov[a][a] for a in range(len(cov))) / n**3
    flat = e <= values.max() * len(cov) * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors, np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1, e))), np.where(flat, 0, e) / trace if trace else np.full(len(e), np.nan)


def _whitened(z: np.ndarray, n: int, vectors: np.ndarray, scales: np.ndarray) -> np.ndarray:
    return (z / n).astype(float) @ vectors * scales


def identity_error(fit: DataFrame, dim: int, n: int, sums: list[int], vectors: np.ndarray, scales: np.ndarray) -> float:
    """The largest entry, by size, of the covariance of the whitened fit list less the identity; nan without a component that varies."""
    live = np.flatnonzero(np.isfinite(scales))
    k = len(live)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, PAIR_ROWS):
                w = _whitened(centred(_vectors(batch.column(0).slice(at, PAIR_ROWS), dim), n, sums), n, vectors[:, live], scales[live])
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["place", "value"])

    if not k:
        return float("nan")
    cov = np.zeros(k * k)
    for r in map_arrow(fit.select("x"), work, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toLocalIterator():
        cov[r.place] = r.value / n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


def whiten(embeddings: DataFrame, count: int = 4, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component 1 .. count: id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * entry). Means and covariances are over the fit
    list, each different x vector once, and exact; eigh gives the components.
    deviation is the exact sum over dimensions of (n * x - S) ** 2, null if it
    exceeds a long. Left out: null vectors and those with entries that are null, not
    finite or too large for a long once scaled, empty vectors, and vectors of
    another length than the one that most different vectors have (of equally many
    the longer). Fewer dimensions than count give as many components. A component
    without variance, as with one vector or copies alone, has null in whitened and
    an explained of 0 (null if nothing varies); identity_error is over the others,
    null if there is none. Repeated rows and null ids keep their rows; other columns
    are left out; an empty table gives an empty one.
    """
    spark: SparkSession = embeddings.sparkSession
    rows = coded(embeddings, id_col, vector_col, scale)
    fit = cut_lineage(rows.select("x", "dim").distinct())
    common = fit.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], _OUT).withColumnRenamed("id", id_col)
    dim = common.dim
    fit = fit.where(F.col("dim") == dim)
    n, sums, cov = polarised(fit, dim)
    vectors, scales, explained = components(n, cov, count)
    error = identity_error(fit, dim, n, sums, vectors, scales)
    k = len(explained)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = centred(_vectors(batch.column(1), dim), n, sums)
            exact = z.astype(object) if z.dtype != object and z.size and float(np.abs(z).max()) ** 2 * dim >= 2.0**62 else z
            deviation = [d if d < 1 << 63 else None for d in (exact * exact).sum(1).tolist()]
            m = len(z)
            each = lambda values: pa.array(np.tile(values, m), from_pandas=True)
            out = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([n] * (m * k), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(_whitened(z, n, vectors, scales).ravel(), pa.float64(), from_pandas=True), each(explained), pa.array([error] * (m * k), pa.float64(), from_pandas=True),
            ]
            yield pa.RecordBatch.from_arrays(out, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows.where(F.col("dim") == dim).select("id", "x"), work, _OUT).withColumnRenamed("id", id_col)
