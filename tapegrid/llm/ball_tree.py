"""Operator 3: exact top-k by inner product, with a ball tree per spatial shard."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.llm.common import cut_lineage, map_arrow, partitions

LEAF = 64
SPLIT_LEVELS = 3
#: Vectors of a shard's tree and queries that go through it together, about.
SHARD_ROWS = 8_192
BLOCK_ROWS = 2_048
#: Vectors that the cells are cut by, picked by a hash of the id, about; and cells at most. They bound what the driver holds, not what is searched.
SAMPLE, CELLS = 16_384, 4_096
#: Queries that meet a tree in one task, about.
QUERY_ROWS = 262_144
#: A query's best cell is searched first, then in each round so many times the cells that it has been in.
WIDER = 8
#: Sums of products below this are exact in floating point.
_EXACT = 2.0**52


class BallTree:
    """Balls around halves, quarters ... of the vectors, down to leaves of LEAF."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.v = ids, vectors
        self.visited = 0  # nodes that a query has entered, counted for each query
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        v = self.v[rows].astype(float)
        center = v.mean(0)
        apart = ((v - center) ** 2).sum(1)
        radius = float(np.sqrt(apart.max()))
        if len(rows) <= LEAF or radius == 0:
            rows = rows[np.argsort(self.ids[rows], kind="stable")]
            self.nodes.append((center, radius, rows, -1, -1))
            return len(self.nodes) - 1
        one = v[apart.argmax()]
        other = v[((v - one) ** 2).sum(1).argmax()]
        side = np.argsort(v @ (other - one), kind="stable")
        left, right = self._build(rows[side[: len(rows) // 2]]), self._build(rows[side[len(rows) // 2 :]])
        self.nodes.append((center, radius, None, left, right))
        return len(self.nodes) - 1

    def search(self, own_id: np.ndarray, q: np.ndarray, k: int, score: np.ndarray, found: np.ndarray) -> None:
        """Better score and found, (queries, k) arrays of the best so far, in place.

        score is sorted from the best down, and its last column is what a node's upper
        bound must reach to be searched. In the upper SPLIT_LEVELS each query sees the
        child with the higher bound first; below, all queries that are there go together.
        """
        length = np.sqrt((q.astype(float) ** 2).sum(1))

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            center, radius = self.nodes[node][:2]
            top = q[who] @ center + length[who] * radius
            return top + 1e-9 * (np.abs(top) + 1)

        def visit(node: int, who: np.ndarray, top: np.ndarray, depth: int) -> None:
            who = who[top >= score[who, -1]]
            if not len(who):
                return
            self.visited += len(who)
            _, _, rows, left, right = self.nodes[node]
            if rows is None:
                a, b = bound(left, who), bound(right, who)
                ahead = a >= b if depth < SPLIT_LEVELS else np.full(len(who), a.mean() >= b.mean())
                for group, order in ((ahead, ((left, a), (right, b))), (~ahead, ((right, b), (left, a)))):
                    if group.any():
                        for child, value in order:
                            visit(child, who[group], value[group], depth + 1)
                return
            new = q[who] @ self.v[rows].T
            ids = np.broadcast_to(self.ids[rows], new.shape)
            new = np.where(ids == own_id[who][:, None], -np.inf, new)
            every, names = np.concatenate((score[who], new), 1), np.concatenate((found[who], ids), 1)
            order = np.lexsort((names, -every), axis=1)[:, :k]
            score[who] = np.take_along_axis(every, order, 1)
            found[who] = np.take_along_axis(names, order, 1)

        everyone = np.arange(len(q))
        visit(self.root, everyone, bound(self.root, everyone), 0)


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    most = max((float(np.abs(x).max()) for x in (a, b) if x.size), default=0.0)
    return most * most * a.shape[1] < _EXACT


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array<double> of whole numbers) and dim of the usable rows.

    Left out: null ids, null and empty vectors, and those with a null or non-finite component.
    """
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double"))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(x).alias("dim"))


@dataclass
class Cells:
    """Parts of space for vectors of one length: halves of halves of a sample, each with a ball around its centre."""

    first: int  # number of the first cell
    splits: list[tuple[np.ndarray | None, float, int, int]]  # direction, threshold, left and right split; a cell's own number instead
    centers: np.ndarray
    radius: np.ndarray | None = None
    sizes: np.ndarray | None = None

    @classmethod
    def cut(cls, sample: np.ndarray, cells: int, first: int) -> Cells:
        splits: list = []
        centers: list[np.ndarray] = []

        def build(rows: np.ndarray, n: int) -> int:
            v = sample[rows]
            center = v.mean(0)
            apart = ((v - center) ** 2).sum(1)
            at = len(splits)
            if n < 2 or len(rows) < 2 or not apart.max():
                splits.append((None, 0.0, len(centers), -1))
                centers.append(center)
                return at
            one = v[apart.argmax()]
            direction = v[((v - one) ** 2).sum(1).argmax()] - one
            along = v @ direction
            middle = float(np.median(along))
            left = along < middle if (along < middle).any() else along <= middle
            splits.append((direction, middle if (along < middle).any() else float(np.nextafter(middle, np.inf)), -1, -1))
            a, b = build(rows[left], n // 2), build(rows[~left], n - n // 2)
            splits[at] = (*splits[at][:2], a, b)
            return at

        build(np.arange(len(sample)), cells)
        return cls(first, splits, np.stack(centers))

    def of(self, v: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = np.zeros(len(v), np.int64)
        todo = [(0, np.arange(len(v)))]
        while todo:
            at, rows = todo.pop()
            direction, threshold, left, right = self.splits[at]
            if direction is None:
                out[rows] = left
            elif len(rows):
                below = v[rows] @ direction < threshold
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest inner product that a vector of each cell can have with each query; -inf for empty cells."""
        length = np.sqrt((q.astype(float) ** 2).sum(1))
        top = q @ self.centers.T + length[:, None] * self.radius
        # More than rounding can take away, also where the products of a sum cancel out.
        slack = 1e-9 * (length[:, None] * (np.sqrt((self.centers**2).sum(1)) + self.radius) + 1)
        return np.where(self.sizes > 0, top + slack, -np.inf)


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their vectors (column `at`): row numbers and vectors."""
    lists = batch.column(at)
    sizes = np.asarray(lists.value_lengths())
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _hits(tree: BallTree, own_id: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, vec_id, score of a tree's up to k best for each query that reach its least score (nan: any)."""
    if _exact(q, tree.v):
        score = np.full((len(q), k), -np.inf)
        # One below the shared score in all places: an equal score still counts, as its id may be smaller.
        score[~np.isnan(least)] = (least - 1)[~np.isnan(least), None]
        found = np.full((len(q), k), -1, np.int64)
        tree.search(own_id, q, k, score, found)
        # Without a shared score every entry found counts; with one, those that reach it.
        hit = np.where(np.isnan(least)[:, None], score > -np.inf, score >= least[:, None])
        at = np.nonzero(hit)[0]
        return pd.DataFrame({"query_id": own_id[at], "vec_id": found[hit], "score": score[hit].astype(np.int64)})
    # Sums that floating point can't hold: whole numbers of any size, row by row.
    big, limit, parts = [[int(x) for x in v] for v in tree.v], 2**63 - 1, []
    for name, v in zip(own_id, q, strict=True):
        mine = [int(x) for x in v]
        sums = sorted((-sum(a * b for a, b in zip(mine, w, strict=True)), int(i)) for i, w in zip(tree.ids, big, strict=True) if i != name)[:k]
        parts.append(pd.DataFrame({"query_id": [name] * len(sums), "vec_id": [i for _, i in sums], "score": [max(-limit - 1, min(limit, -s)) for s, _ in sums]}).astype("int64"))
    return pd.concat(parts)


def spatial_cells(rows: DataFrame, total: int, shard_rows: int) -> dict[int, Cells]:
    """Cells for each length of vectors, cut by a sample: all together about total / shard_rows, CELLS at most. Lengths that the sample lacks have none."""
    share = min(1.0, SAMPLE / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "v").toPandas().sort_values("id", kind="stable")
    out: dict[int, Cells] = {}
    first = 0
    for dim, own in sample.groupby(sample["v"].map(len)):
        cells = max(1, min(round(total / shard_rows * len(own) / len(sample)), len(own), CELLS))
        out[dim] = Cells.cut(np.stack(own["v"].to_numpy()).astype(float), cells, first)
        first += len(out[dim].centers)
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best rows for each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Vectors become floor(scale * x); the score is the integer inner product; ties
    go to the smaller id. A query is not its own candidate, nor is any row with its
    id. Vectors are compared within one length. Repeated rows (same id and vector)
    count once. Unusable vectors (see quantised) take no part; other columns are
    left out; an empty table gives an empty one.

    Space is cut into cells, and a cell with many vectors into shards of bounded
    size; each shard gets one ball tree. A query first searches the cell with the
    highest upper bound. The k-th score that it has so far goes with it to the next
    cells, in the order of their bounds, a few more each round; cells that cannot
    reach it are skipped whole, and a query without any such cell left is done. Trees
    stay where they are read; queries stream through them in blocks.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(quantised(vectors, scale, id_col, vector_col).dropDuplicates(["id", "v"]))
    total = rows.count()
    cells = spatial_cells(rows, total, shard_rows)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, apart = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, v in _by_dim(batch, 1):
                own = cells.get(v.shape[1])
                cell[at] = -v.shape[1]  # a length that the sample lacks is one cell
                if own is not None:
                    found = own.of(v)
                    cell[at], apart[at] = own.first + found, np.sqrt(((v - own.centers[found]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(apart)], ["id", "v", "cell", "apart"])

    placed = map_arrow(rows.select("id", "v"), put, "id long, v array<double>, cell long, apart double")
    # At most CELLS rows, and one for each other length.
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).toPandas()
    count, radius = dict(zip(found["cell"], found["n"], strict=True)), dict(zip(found["cell"], found["radius"], strict=True))
    for own in cells.values():
        numbers = range(own.first, own.first + len(own.centers))
        own.sizes = np.array([count.get(c, 0) for c in numbers])
        own.radius = np.array([radius.get(c, 0.0) for c in numbers]) * (1 + 1e-9)
    parts = {c: max(1, math.ceil(n / shard_rows)) for c, n in count.items()}
    table = spark.createDataFrame([(int(c), int(p)) for c, p in parts.items()], "cell long, parts int")
    shard = placed.join(F.broadcast(table), "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))

    def grown(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "tree": [pickle.dumps(BallTree(own["id"].to_numpy(np.int64), np.stack(own["v"].to_numpy())))]})

    trees = cut_lineage(shard.select("id", "v", "cell", "part").groupBy("cell", "part").applyInPandas(grown, "cell long, part int, tree binary"))
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("q_id"), F.col("v").alias("q_v"))
    salts = max(1, math.ceil(queries.count() / QUERY_ROWS))

    def routed(low: int, high: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, 1024):
                    batch = whole.slice(begin, 1024)
                    least = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                    at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                    for who, q in _by_dim(batch, 1):
                        own = cells.get(q.shape[1])
                        if own is None:
                            if low == 0:
                                at.append(who)
                                to.append(np.full(len(who), -q.shape[1]))
                            continue
                        top = own.bounds(q)
                        order = np.argsort(-top, axis=1, kind="stable")[:, low:high]
                        value = np.take_along_axis(top, order, 1)
                        wanted = (value > -np.inf) & ~(value < least[who][:, None])
                        row, column = np.nonzero(wanted)
                        at.append(who[row])
                        to.append(own.first + order[row, column])
                    at = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(np.concatenate(to))], ["q_id", "q_v", "least", "cell"])

        return work

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            held: list[int] = []
            raw, kept = batch.column(0), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at in range(batch.num_rows + 1):
                if held and (at == batch.num_rows or kept[at] or len(held) == block_rows):
                    own = batch.take(pa.array(held))
                    for who, q in _by_dim(own, 2):
                        ids = own.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[who]
                        least = own.column(3).to_numpy(zero_copy_only=False).astype(float)[who]
                        yield pa.RecordBatch.from_pandas(_hits(tree, ids, q, least, k), preserve_index=False)
                    held = []
                if at < batch.num_rows:
                    if kept[at]:
                        tree = pickle.loads(raw[at].as_py())  # written by this run into the shared folder
                    else:
                        held.append(at)

    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    widest = max([1, *(len(c.centers) for c in cells.values())])
    low, high = 0, 1
    while low < widest and total:
        least = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
        asked = queries.join(least, F.col("q_id") == F.col("query_id"), "left").select("q_id", "q_v", "least")
        pairs = cut_lineage(map_arrow(asked, routed(low, high), "q_id long, q_v array<double>, least double, cell long"))
        sent = pairs.join(F.broadcast(table), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("salt", F.pmod(F.xxhash64("q_id"), F.lit(salts)).cast("int"))
        # At most as many as there are shards; a tree comes before the queries of its shard and salt.
        wanted = trees.join(sent.select("cell", "part", "salt").distinct(), ["cell", "part"]).select("cell", "part", "salt", "tree")
        both = wanted.unionByName(sent.select("cell", "part", "salt", "q_id", "q_v", "least"), allowMissingColumns=True)
        met = both.repartition(partitions(spark), "cell", "part", "salt").sortWithinPartitions("cell", "part", "salt", F.col("tree").isNull())
        hits = map_arrow(met.select("tree", "q_id", "q_v", "least"), streamed, "query_id long, vec_id long, score long")
        every_hit = best.unionByName(hits).distinct()
        best = cut_lineage(every_hit.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).drop("rank"))
        low, high = high, high * WIDER
    return best.withColumn("rank", F.row_number().over(best_first)).select("query_id", "rank", "vec_id", "score")
