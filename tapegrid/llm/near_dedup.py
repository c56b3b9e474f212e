"""Operator 7: near-duplicates by a MinHash signature-coordinate inverted join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.common import MAX_BROADCAST_IDS, among, cut_lineage, join_counted, map_arrow, partitions, sliced
from tapegrid.llm.components import components
from tapegrid.llm.text_hashes import mix, shingle_sets

#: Coordinates of a signature.
COORDINATES = 64
#: Standard deviations by which the number of equal coordinates may stay below its mean.
DEVIATIONS = 5.0
#: Documents from which a coordinate-value pair is frequent.
FREQUENT = 64
#: Coordinates that are counted before rows that can't reach the match threshold are skipped.
STEP = 8
#: Documents of a group that are compared in one task, and shingles that count as one more; larger groups are split into blocks.
BLOCK = 1024
BLOCK_SHINGLES = 2048

_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_XOR, _ODD = _SEEDS[:COORDINATES], _SEEDS[COORDINATES:] | np.uint64(1)


def least_matches(similarity: float) -> int:
    """Equal coordinates that two sets of this similarity have, but for DEVIATIONS."""
    return int(COORDINATES * similarity - DEVIATIONS * (COORDINATES * similarity * (1 - similarity)) ** 0.5)


def prefix(similarity: float) -> int:
    """Coordinates of which two signatures with least_matches equal ones share one at least, whichever these are."""
    return COORDINATES - least_matches(similarity) + 1


def rarest(sets: DataFrame, posted: int) -> DataFrame:
    """id, posts: of each document's coordinate-value pairs the `posted` ones that come first in one order of all pairs, the rarest first.

    Any one order of all pairs lets two documents that share enough of them meet in
    such a prefix. Pairs under FREQUENT come in the order of coordinates, then frequent
    ones by their count. So a passage that many documents have fills long lists only
    with those documents that have hardly any pair of their own.
    sets: id, pairs (array<long>, one for each coordinate).
    """
    every = sets.select("id", F.posexplode("pairs").alias("k", "pair"))
    frequent = cut_lineage(every.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT))
    if frequent.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        frequent = F.broadcast(frequent)  # 16 bytes a row
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "pair")
    # A document has COORDINATES rows.
    ranked = every.join(frequent, "pair", "left").groupBy("id").agg(F.array_sort(F.collect_list(place)).alias("ranked"))
    return ranked.select("id", F.transform(F.slice("ranked", 1, posted), lambda t: t["pair"]).alias("posts"))


def signatures(sets: list[np.ndarray], posted: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For sets that aren't empty: keys of the first `posted` coordinate-value pairs (n, posted), and a byte of each value (n, COORDINATES)."""
    keys = np.zeros((len(sets), posted), np.int64)
    sketch = np.zeros((len(sets), COORDINATES), np.uint8)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        sizes = [len(s) for s in sets[at:end]]
        first = np.cumsum(sizes) - sizes
        for k in range(COORDINATES):
            least = mix(np.minimum.reduceat((x ^ _XOR[k]) * _ODD[k], first) + np.uint64(k))
            sketch[at:end, k] = (least >> np.uint64(56)).astype(np.uint8)
            if k < posted:
                keys[at:end, k] = least.view(np.int64)
        at = end
    return keys, sketch


def matching(sketch: np.ndarray, size: np.ndarray, similarity: float, i: int, rest: np.ndarray) -> np.ndarray:
    """Those of rest with enough coordinates equal to row i's, and near enough in size.

    Collisions are counted STEP coordinates at a time; a row whose count can't reach
    the match threshold with all coordinates to come is skipped.
    """
    least = least_matches(similarity)
    rest = rest[np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i]) - 1e-9]
    count = np.zeros(len(rest), np.int64)
    for at in range(0, COORDINATES, STEP):
        count += (sketch[rest, at : at + STEP] == sketch[i, at : at + STEP]).sum(1)
        keep = count >= least - (COORDINATES - at - STEP)
        rest, count = rest[keep], count[keep]
    return rest


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray], home: np.ndarray | None = None, split: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Edges (row, row) of a spanning forest of n rows, by breadth.

    linked(i, rest) gives the rows of rest that are linked with i. A row is only held
    against rows that nothing has reached yet, so a group of copies of one row costs
    one comparison each. Rows with one home are reached together; with split, only
    rows of different splits are compared.
    """
    a: list[int] = []
    b: list[int] = []
    alive = np.ones(n, bool)
    while alive.any():
        start = int(alive.argmax())
        frontier = [start] if home is None else np.flatnonzero(alive & (home == home[start])).tolist()
        alive[frontier] = False
        while frontier and alive.any():
            i = frontier.pop()
            found = linked(i, np.flatnonzero(alive if split is None else alive & (split != split[i])))
            if len(found):
                a += [i] * len(found)
                b += found.tolist()
                if home is not None:
                    found = np.flatnonzero(alive & np.isin(home, home[found]))
                alive[found] = False
                frontier += found.tolist()
    return a, b


def by_group(df: DataFrame, columns: list[str], work: Callable[[dict[str, list]], tuple[list, list]]) -> DataFrame:
    """Runs work on each group of rows with equal `columns` and returns its edges (a, b).

    df is dealt out and sorted by the columns; a task holds one group at a time, and
    groups are bounded by the caller.
    """
    spark = df.sparkSession
    sorted_rows = df.repartition(partitions(spark), *columns).sortWithinPartitions(*columns)
    names = df.columns
    key_at = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None

        def done() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) > 1:
                a, b = work({n: [x for part in held for x in part.column(k).to_pylist()] for k, n in enumerate(names) if k not in key_at} | {c: held[0].column(k)[0].as_py() for c, k in zip(columns, key_at, strict=True)})
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in key_at])
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                key = tuple(keys[:, s].tolist())
                if key != held_key:
                    yield from done()
                    held, held_key = [], key
                held.append(batch.slice(s, e - s))
        yield from done()

    return map_arrow(sorted_rows, run, "a long, b long")


def _links(found: DataFrame) -> DataFrame:
    """Components as edges."""
    return found.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def linked_rows(rows: DataFrame, held: DataFrame, sizes: DataFrame, key: str, work: Callable[[dict[str, list]], tuple[list, list]], block_rows: int) -> DataFrame:
    """Components (id, component) of the rows that `work` links within a key, directly or through others.

    rows: id and key, each once; held: id and what work needs; sizes: key, blocks,
    first (the key's smallest id). Rows of a key are dealt to its blocks, and the first
    one goes to each of them. Only keys whose rows aren't joined by that are looked at
    again, with what is joined already as one home: rows of different blocks meet
    unless both are of the key's largest home.
    """
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    to = F.when((F.col("id") == F.col("first")) & (F.col("blocks") > 1), every).otherwise(F.array(own))
    dealt = rows.join(sizes, key).select(key, "id", F.explode(to).alias("block"))
    found = components(by_group(dealt.join(held, "id"), [key, "block"], work))
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return found
    homes = found.withColumnRenamed("component", "home")
    labelled = cut_lineage(rows.join(large, key).join(homes, "id", "left").select(key, "id", own.alias("own"), "blocks", F.coalesce("home", "id").alias("home")))
    # Rows of a key's largest home stay in their block, and all others visit it, in chunks: n + others * blocks rows, if the others fit one chunk.
    counts = labelled.groupBy(key, "home").agg(F.count("*").alias("n"))
    most = counts.groupBy(key).agg(F.max_by("home", F.struct("n", "home")).alias("largest"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    apart = labelled.join(most.select(key, "largest", F.ceil(F.col("others") / block_rows).cast("int").alias("chunks")), key)
    chunk = F.pmod(F.xxhash64("id", F.lit(6)), F.col("chunks")).cast("int")
    stay = apart.select(key, "id", "home", F.col("own").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("visits"))
    visit = apart.where("home != largest").select(key, "id", "home", "own", chunk.alias("chunk"), F.explode(every).alias("block")).where("block != own")
    both = stay.unionByName(visit.select(key, "id", "home", "block", "chunk", F.lit(1).alias("visits")))
    more = cut_lineage(by_group(both.join(held, "id"), [key, "block", "chunk"], work))
    return found if more.isEmpty() else components(more.unionByName(_links(found)))


def _parts(group: dict) -> tuple[np.ndarray | None, np.ndarray | None]:
    return tuple(np.array(group[c]) if c in group else None for c in ("home", "visits"))


def _named(ids: list, edges: tuple[list[int], list[int]]) -> tuple[list, list]:
    return tuple([ids[k] for k in side] for side in edges)


def _likely_edges(similarity: float) -> Callable:
    def work(group: dict) -> tuple[list, list]:
        size = np.array(group["n_shingles"], np.int64)
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(size), COORDINATES)
        return _named(group["id"], forest(len(size), lambda i, rest: matching(sketch, size, similarity, i, rest), *_parts(group)))

    return work


def _true_edges(similarity_percent: int) -> Callable:
    def work(group: dict) -> tuple[list, list]:
        sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in group["text"]])
        full = [k for k, x in enumerate(sets) if len(x)]  # another row of an id may be blank
        group = {c: [x[k] for k in full] if isinstance(x, list) else x for c, x in group.items()}
        sets = [sets[k] for k in full]
        size = np.array([len(s) for s in sets], np.int64)
        _, sketch = signatures(sets)

        def linked(i: int, rest: np.ndarray) -> np.ndarray:
            mine, found = sets[i], []
            for j in matching(sketch, size, similarity_percent / 100, i, rest).tolist():
                at = np.searchsorted(mine, sets[j])
                common = int((mine[np.minimum(at, len(mine) - 1)] == sets[j]).sum())
                if 100 * common >= similarity_percent * (len(mine) + len(sets[j]) - common):
                    found.append(j)
            return np.array(found, np.int64)

        return _named(group["id"], forest(len(sets), linked, *_parts(group)))

    return work


def near_duplicates(docs: DataFrame, similarity_percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Documents are linked if 100 * |A & B| >= similarity_percent * |A | B| over their
    5-word shingle sets; component_id is the smallest id that links reach.

    Equal sets are one document from the start. Each other is posted under the
    rarest coordinate-value pairs of its MinHash signature: as many that two
    documents above the match threshold share one of them (prefix). Collisions are
    counted in each posting list, and rows that can't reach the threshold are skipped;
    a spanning forest of the pairs above it, not all pairs, leaves the list. Its
    components are the groups in which links are then tested on full sets. No list or
    group is capped: large ones are compared block by block.

    A null or blank text has an empty set and no link. A row with a null id is
    linked with nothing (component_id null, kept true). Rows with the same id are
    one document: linked if any of them is. Other columns are left out; an empty
    table gives an empty one.
    """
    similarity = similarity_percent / 100

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()])
            full = [k for k, s in enumerate(sets) if len(s)]
            keys, sketch = signatures([sets[k] for k in full], COORDINATES)
            place = {k: x for x, k in enumerate(full)}
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([keys[place[k]].tolist() if k in place else None for k in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([sketch[place[k]].tobytes() if k in place else None for k in range(len(sets))], pa.binary()),
                ],
                ["id", "n_shingles", "set_key", "pairs", "sketch"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = cut_lineage(map_arrow(own, sketched, "id long, n_shingles long, set_key binary, pairs array<long>, sketch binary"))
    usable = base.where("id IS NOT NULL AND set_key IS NOT NULL")
    # One row for each different set: that of its smallest id. Copies meet it again at the end only.
    same = cut_lineage(usable.groupBy("set_key").agg(F.min_by(F.struct("n_shingles", "pairs", "sketch"), "id").alias("set"), F.min("id").alias("first"), F.count("*").alias("n")))
    distinct = same.select(F.col("first").alias("id"), "set_key", "set.*")
    member = cut_lineage(join_counted(usable.select("id", "set_key").distinct(), same.select("set_key", "first", "n"), ["set_key"]).drop("n"))
    # An id with several sets is one document, and joins them.
    several = member.groupBy("id").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low != high").select("id")
    several = member.join(several, "id").select(F.col("id").alias("a"), F.col("first").alias("b"))

    posts = cut_lineage(rarest(distinct, prefix(similarity))).select("id", F.explode("posts").alias("post"))
    lists = posts.groupBy("post").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    lists = cut_lineage(lists.select("post", F.ceil(F.col("n") / block).cast("int").alias("blocks"), "first"))
    likely = linked_rows(posts, distinct.select("id", "n_shingles", "sketch"), lists, "post", _likely_edges(similarity), block)

    groups = cut_lineage(likely)
    weights = groups.join(distinct.select("id", "n_shingles"), "id").groupBy("component").agg(F.sum(1 + F.col("n_shingles") / BLOCK_SHINGLES).alias("weight"))
    weights = cut_lineage(weights.select("component", F.ceil(F.col("weight") / block).cast("int").alias("blocks"), F.col("component").alias("first")))
    # The texts of groups only, read from the documents once for both steps.
    texts = cut_lineage(among(own.where(F.col("text").isNotNull()), groups.select("id"), "id"))
    true = linked_rows(groups, texts, weights, "component", _true_edges(similarity_percent), block)

    if not several.isEmpty():
        true = components(_links(true).unionByName(several))
    linked = true.withColumnRenamed("id", "first")
    by_id = member.groupBy("id").agg(F.min("first").alias("first")).join(linked, "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    found = base.select("id", "n_shingles").join(by_id, "id", "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
