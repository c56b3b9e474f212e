"""Operator 9: packing by few-document length patterns, fitted by non-negative least squares."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.llm.common import cut_lineage, map_arrow
from tapegrid.llm.word_ids import WordIds

CAPACITY = 4096
END_ID = 1
#: Rows of one length that are numbered together, about; more are dealt to groups.
GROUP_ROWS = 1_000_000
#: Lengths tried as the second of three documents, and the third of four, of a pattern.
GRID = 24


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document: id, piece, start, length, ids_crc32.

    A document is its ids and the end id; a null text has the end id alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer_path)
        for batch in batches:
            for first, ids, ends in encoder(batch.column(1)):
                ids = np.insert(ids, ends, END_ID).astype("<u4")
                ends = ends + np.arange(1, len(ends) + 1)
                begins = np.r_[0, ends[:-1]]
                pieces = -(-(ends - begins) // capacity)
                row = np.repeat(np.arange(len(ends)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, (ends - begins)[row] - start)
                raw, at = memoryview(ids).cast("B"), 4 * (begins[row] + start)
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, "id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of one to four of the given lengths: (members, -1 for none; tokens).

    The largest member comes first. Each larger member gets the best-fitting last
    one, alone, after one other, and after two others from a grid.
    """
    lengths = np.sort(lengths)
    grid = lengths[np.unique(np.linspace(0, len(lengths) - 1, GRID).astype(int))]

    def fit(rest: np.ndarray) -> np.ndarray:
        k = np.searchsorted(lengths, rest, side="right") - 1
        return np.where(k >= 0, lengths[np.maximum(k, 0)], -1)

    one = lengths[:, None]
    none = np.full(len(one), -1)
    made = [np.c_[one, none, none, none], np.c_[one, fit(capacity - one[:, 0]), none, none]]
    two = np.array([(a, b) for a in lengths for b in grid if b <= a and a + b <= capacity] or np.zeros((0, 2)), int).reshape(-1, 2)
    none = np.full(len(two), -1)
    made.append(np.c_[two, fit(capacity - two.sum(1)), none])
    coarse = grid[:: max(1, GRID // 8)]
    three = np.array([(a, b, c) for a in grid for b in coarse for c in coarse if c <= b <= a and a + b + c <= capacity] or np.zeros((0, 3)), int).reshape(-1, 3)
    made.append(np.c_[three, fit(capacity - three.sum(1))])
    every = np.unique(-np.sort(-np.concatenate(made), axis=1), axis=0)
    tokens = np.where(every > 0, every, 0).sum(1)
    full = tokens >= 0.98 * capacity
    return every[full], tokens[full]


def nonnegative_fit(members: np.ndarray, wanted: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeats x >= 0 of the patterns that bring A x nearest to the histogram `wanted`.

    A holds how often each length is in each pattern. Projected gradient with
    momentum; A is used through its few entries and never made dense.
    """
    if not len(members):
        return np.zeros(0)
    col, row = np.nonzero(members > 0)[0], members[members > 0]
    size = len(wanted)
    scale = 1 / np.sqrt(np.maximum(wanted, 1))  # rare lengths count as much as common ones

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x[col], size) * scale

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, (r * scale)[row], len(members))

    v = np.ones(len(members))
    for _ in range(20):  # the largest singular value
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(members))
    t, target = 1.0, wanted * scale
    for _ in range(steps):
        nxt = np.maximum(0, y - back(forward(y) - target) / (1.05 * norm))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the k-th document of each length goes: rows length, first, count, sequence, offset.

    Documents first .. first + count - 1 of that length go to sequences sequence ..
    sequence + count - 1, at the offset. histogram[n]: documents of n tokens. The
    work depends on the number of lengths, not of documents.
    """
    left = histogram.astype(np.int64).copy()
    taken = np.zeros_like(left)
    out: list[tuple[int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, count)
    sizes: list[int] = []
    sequences = 0

    def put(length: int, count: int, sequence: int, free: int) -> None:
        out.append((length, int(taken[length]), count, sequence, capacity - free))
        taken[length] += count
        left[length] -= count

    def keep(free: int, sequence: int, count: int) -> None:
        if free > 0:
            if free not in open_at:
                open_at[free] = []
                bisect.insort(sizes, free)
            open_at[free].append((sequence, count))

    if left[capacity]:
        put(capacity, n := int(left[capacity]), sequences, capacity)
        sequences += n
    present = np.flatnonzero(left)
    if len(present):
        members, tokens = patterns(present, capacity)
        x = nonnegative_fit(members, left.astype(float))
        for k in np.lexsort((-x, -tokens)):
            own = members[k][members[k] > 0]
            lengths, times = np.unique(own, return_counts=True)
            n = int(min(np.rint(x[k]), (left[lengths] // times).min()))
            if n <= 0:
                continue
            free = capacity
            for length in own:
                put(int(length), n, sequences, free)
                free -= int(length)
            keep(free, sequences, n)
            sequences += n
    for length in np.flatnonzero(left)[::-1].tolist():  # the rest: best fit, longest first
        while left[length]:
            k = bisect.bisect_left(sizes, length)
            n = int(left[length])
            if k == len(sizes):
                each = capacity // length
                whole, more = divmod(n, each)
                for count, per in ((whole, each), (1, more)):
                    if count and per:
                        free = capacity
                        for _ in range(per):
                            put(length, count, sequences, free)
                            free -= length
                        keep(free, sequences, count)
                        sequences += count
                break
            free = sizes[k]
            sequence, count = open_at[free].pop()
            if not open_at[free]:
                del open_at[free]
                sizes.pop(k)
            n = min(n, count)
            put(length, n, sequence, free)
            keep(free - length, sequence, n)
            if count > n:
                keep(free, sequence + n, count - n)
    return pd.DataFrame(out, columns=["length", "first", "count", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces: `length` of 1 to capacity, and other columns.

    Lengths are counted where the rows are; only the histogram of at most `capacity`
    entries comes to the driver, and only the plan, which follows from it, goes
    back. Patterns are at most capacity * (GRID + 2) and a few thousand, and each row
    of the plan uses up a pattern's member, a length or a run of sequences, so the
    plan has under a million rows of 40 bytes whatever the input. Rows are numbered
    within a length through groups of about GROUP_ROWS, so that a length which a
    third of all rows share isn't numbered by one task. An empty table gives an
    empty one.
    """
    spark = pieces.sparkSession
    own = pieces.columns
    pieces = cut_lineage(pieces)
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[lengths["length"].to_numpy(np.int64)] = lengths["n"].to_numpy(np.int64)
    where = spark.sparkContext.broadcast(plan(histogram, capacity))
    lengths["salts"] = -(-lengths["n"] // GROUP_ROWS)
    salts = spark.createDataFrame(lengths[["length", "salts"]].astype("int64"), "length long, salts long")
    # At most `capacity` rows.
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(*own), F.col("salts"))).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "salt"], ignore_index=True)
    counts["before"] = counts.groupby("length")["n"].cumsum() - counts["n"] if len(counts) else 0
    before = spark.createDataFrame(counts[["length", "salt", "before"]].astype("int64"), "length long, salt long, before long")
    order = Window.partitionBy("length", "salt").orderBy(*[F.col(c) for c in own if c != "length"])
    # At most `capacity` rows and one for each GROUP_ROWS of the input.
    ranked = salted.join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.row_number().over(order) - 1 + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        w = where.value
        key = (w["length"].to_numpy(np.int64) << 40) + w["first"].to_numpy(np.int64)
        k = np.searchsorted(key, (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": w["sequence"].to_numpy()[k] + rank.to_numpy() - w["first"].to_numpy()[k], "offset": w["offset"].to_numpy()[k]})

    return ranked.withColumn("at", place("length", "rank")).select(*own, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each row of docs: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: the end id alone. Null ids stay null and repeated rows are packed as
    often as they come; other columns are left out; an empty table gives an empty one.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), capacity).withColumnRenamed("id", id_col)
