"""Operator 13: a trie of rebuilt conversations, keyed by composable fingerprints of their prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.common import cut_lineage, map_arrow

#: Conversations of a family share a head of at most HEADS - 1 turns.
FAMILY, HEADS = 5, 9
#: Odd multipliers of the two lanes of a fingerprint, and their inverses modulo 2 ** 64.
_M = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_INVERSE = tuple(pow(m, -1, 1 << 64) for m in _M)
#: Seeds of a turn's two hashes; other pairs are used if a hash turns out to stand for two different turns.
SEEDS = ((11, 29), (101, 211), (1009, 2003), (10007, 20011))
#: Bytes of joined ids in one piece.
PIECE = 1 << 16
_KEY = ("depth", "f1", "f2")


def power(lane: int, exponents: np.ndarray) -> np.ndarray:
    """The lane's multiplier to whole powers, negative ones too, modulo 2 ** 64."""
    out = np.ones(len(exponents), np.uint64)
    base = np.where(exponents < 0, np.uint64(_INVERSE[lane]), np.uint64(_M[lane]))
    rest = np.abs(exponents)
    while rest.any():
        out = np.where(rest & 1, out * base, out)
        base = base * base
        rest = rest >> 1
    return out


def turns(conversations: DataFrame, seeds: tuple[int, int]) -> DataFrame:
    """conv_id, turn, role, text, g1, g2, n_bytes of the rows that have a conv_id; null role and text are empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    g = [F.xxhash64(F.lit(s), "role", F.length("role"), "text").alias(f"g{k + 1}") for k, s in enumerate(seeds)]
    return rows.select("*", *g, F.octet_length("text").cast("long").alias("n_bytes"))


def hashes_clash(rows: DataFrame) -> bool:
    """Whether a pair of hashes stands for two different turns. Texts are compared once each; then only hashes move."""
    different = rows.select("g1", "g2", "role", "text").distinct()
    return not different.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _lanes(batch: pa.RecordBatch, prefix: str) -> list[np.ndarray]:
    return [_column(batch, f"{prefix}{k}").view(np.uint64) for k in (1, 2)]


_PREFIX = "part int, conv_id long, pos long, u1 long, u2 long, v1 long, v2 long, g1 long, g2 long, n_bytes long, before long"


def scanned(rows: DataFrame) -> DataFrame:
    """Prefix products within each part of the sorted turns: for a turn at pos, (u1, u2) of the turns of its conversation before it, (v1, v2) with it.

    The product of turns g_0 g_1 ... has the value sum of g_i * M ** i; that of two
    rows of turns of lengths k and l is (k + l, v + M ** k * w). A conversation whose
    turns fall into several parts is begun anew in each; composed() joins them.
    """
    tie = F.concat("role", F.lit("\0"), "text")
    # Turns of one number are in order of role and text; the first characters of these bound the parts, whole ones sort within.
    dealt = rows.repartitionByRange(F.asc("conv_id"), F.asc_nulls_first("turn"), F.substring(tie, 1, 64))
    ordered = dealt.sortWithinPartitions(F.asc("conv_id"), F.asc_nulls_first("turn"), "role", "text").select("conv_id", "g1", "g2", "n_bytes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, length, bytes_before, value = None, 0, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, size = _column(batch, "conv_id"), _column(batch, "n_bytes")
            begins = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            run = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(conv)]))
            goes_on = last is not None and conv[0] == last
            held = np.where((run == 0) & goes_on, 1, 0)
            at = np.arange(len(conv)) - begins[run] + held * length
            total = np.r_[0, np.cumsum(size)]
            before = total[:-1] - total[begins[run]] + held * bytes_before
            columns = []
            for lane, g in enumerate(_lanes(batch, "g")):
                term = g * power(lane, at)
                summed = np.r_[np.zeros(1, np.uint64), np.cumsum(term)]
                with_it = summed[1:] - summed[begins[run]] + np.where(held == 1, value[lane], np.uint64(0))
                columns.append((with_it - term, with_it))
            (u1, v1), (u2, v2) = columns
            last, length, bytes_before, value = conv[-1], int(at[-1]) + 1, int(before[-1] + size[-1]), [v1[-1], v2[-1]]
            arrays = [np.full(len(conv), part, np.int32), conv, at + 1, *(x.view(np.int64) for x in (u1, u2, v1, v2)), _column(batch, "g1"), _column(batch, "g2"), size, before]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], _PREFIX.replace(" long", "").replace(" int", "").split(", "))

    return map_arrow(ordered, work, _PREFIX)


def composed(parts: DataFrame) -> DataFrame:
    """scanned() parts as products of whole conversations.

    Only a conversation at a part's border goes on in the next, so at most two rows
    a part come to the driver: the parts' own products, whose running product is
    what stands before each later part.
    """
    ends = parts.groupBy("conv_id", "part").agg(F.max("pos").alias("length"), F.max_by(F.struct("v1", "v2"), "pos").alias("v"), F.sum("n_bytes").alias("bytes"))
    several = ends.groupBy("conv_id").agg(F.count("*").alias("n"), F.collect_list(F.struct("part", "length", "v", "bytes")).alias("parts")).where("n > 1")
    # Parts whose rows don't begin their conversation: (length, products, bytes) of what stands before.
    offset: dict[int, tuple[int, int, int, int, int]] = {}
    for r in several.toLocalIterator():
        length = v1 = v2 = size = 0
        for p in sorted(r.parts, key=lambda p: p.part):
            if length:
                offset[p.part] = (r.conv_id, length, v1, v2, size)
            v1 = (v1 + pow(_M[0], length, 1 << 64) * p.v.v1) % (1 << 64)
            v2 = (v2 + pow(_M[1], length, 1 << 64) * p.v.v2) % (1 << 64)
            length, size = length + p.length, size + p.bytes
    known = np.array(sorted(offset), np.int64)
    places = np.array([offset[k][:2] for k in known], np.int64).reshape(-1, 2)
    values = np.array([offset[k][2:4] for k in known], np.uint64).reshape(-1, 2)
    sizes = np.array([offset[k][4] for k in known], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv = _column(batch, "part"), _column(batch, "conv_id")
            k = np.minimum(np.searchsorted(known, part), len(known) - 1)
            later = (known[k] == part) & (places[k, 0] == conv)
            if not later.any():
                yield batch
                continue
            length = np.where(later, places[k, 1], 0)
            out = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            out["pos"] = pa.array(_column(batch, "pos") + length)
            out["before"] = pa.array(_column(batch, "before") + np.where(later, sizes[k], 0))
            for lane in (0, 1):
                start = np.where(later, values[k, lane], np.uint64(0))
                shift = power(lane, length)
                for name in (f"u{lane + 1}", f"v{lane + 1}"):
                    out[name] = pa.array((start + shift * _column(batch, name).view(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return map_arrow(parts, work, _PREFIX) if len(known) else parts


def head_turns(conv: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with, at most."""
    return (F.crc32(F.encode(conv.cast("string"), "UTF-8")) % HEADS).cast("int")


def members(prefixes: DataFrame) -> DataFrame:
    """A row for each conversation and prefix of it as rebuilt: conv_id, depth, fingerprints f1 f2 and those of its parent p1 p2, its last turn's hashes g1 g2 and n_bytes, bytes before, and whether the conversation ends there.

    Rebuilt texts are never made. The head's product is stored with the family's
    first conversation; the product of the turns after a conversation's own first h
    is the quotient of two of its prefixes; a head and such a suffix are multiplied.
    """
    item = F.struct("pos", "u1", "u2", "v1", "v2", "g1", "g2", "n_bytes", "before")
    # An array has at most HEADS - 1 items, whatever the conversation's length.
    convs = prefixes.groupBy("conv_id").agg(F.max("pos").alias("length"), F.array_sort(F.collect_list(F.when(F.col("pos") < HEADS, item))).alias("first"))
    convs = convs.withColumns({"base_id": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": head_turns(F.col("conv_id"))})
    bases = convs.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("of"), F.col("first").alias("head"))
    known = convs.join(bases, F.col("base_id") == F.col("of"), "left")
    head = F.filter(F.coalesce("head", F.array().cast(dict(bases.dtypes)["head"])), lambda t: t["pos"] <= F.col("h"))
    known = known.select("conv_id", "length", "h", head.alias("head"), F.get("first", F.col("h") - 1).alias("own"), F.greatest(F.col("length") - F.col("h"), F.lit(0)).alias("more"))
    known = known.withColumn("n_head", F.size("head"))

    none = F.lit(None).cast("long")
    roots = known.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("f1", "f2")], none.alias("p1"), none.alias("p2"), *[F.lit(0).cast("long").alias(c) for c in ("g1", "g2", "n_bytes", "before")], (F.col("n_head") + F.col("more") == 0).alias("ends"))
    heads = known.select("conv_id", "n_head", "more", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), F.col("t.v1").alias("f1"), F.col("t.v2").alias("f2"), F.col("t.u1").alias("p1"), F.col("t.u2").alias("p2"), "t.g1", "t.g2", "t.n_bytes", "t.before", ((F.col("t.pos") == F.col("n_head")) & (F.col("more") == 0)).alias("ends"))

    # The products of the whole head (a) and of the own turns that it replaces (o); of no turns: 0.
    ends = {"a": F.get("head", F.col("n_head") - 1), "o": F.col("own")}
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    frame = known.where("more > 0").select(F.col("conv_id").alias("of"), "length", "n_head", *[zero(t[f"v{k}"]).alias(f"{c}{k}") for c, t in ends.items() for k in (1, 2)], *[zero(t["before"] + t["n_bytes"]).alias(f"{c}_bytes") for c, t in ends.items()])
    later = prefixes.withColumn("h", head_turns(F.col("conv_id"))).where("pos > h").join(frame, F.col("conv_id") == F.col("of"))
    schema = "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, g1 long, g2 long, n_bytes long, before long, ends boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n_head, pos = (_column(batch, c).astype(np.int64) for c in ("h", "n_head", "pos"))
            products = {}
            for lane in (0, 1):
                a, o, u, v = (_column(batch, f"{c}{lane + 1}").view(np.uint64) for c in "aouv")
                shift = power(lane, n_head - h)
                products[f"f{lane + 1}"], products[f"p{lane + 1}"] = a + shift * (v - o), a + shift * (u - o)
            before = _column(batch, "a_bytes") + _column(batch, "before") - _column(batch, "o_bytes")
            arrays = [_column(batch, "conv_id"), n_head + pos - h, *(products[c].view(np.int64) for c in ("f1", "f2", "p1", "p2")), *(_column(batch, c) for c in ("g1", "g2", "n_bytes")), before, pos == _column(batch, "length")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [c.split()[0] for c in schema.split(", ")])

    names = [c.split()[0] for c in schema.split(", ")]
    return map_arrow(later.drop("of", "part"), work, schema).unionByName(heads.select(*names)).unionByName(roots.select(*names))


def end_hashes(ends: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256: of the decimal conv_ids that end at a node, rising, with commas between.

    Rows are dealt by node and id, so one node's may lie in many parts; each part
    joins its own to pieces of text, and only pieces meet to be hashed in order.
    """
    ordered = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([_column(batch, c) for c in _KEY], 1)
            ids = batch.column(3).cast(pa.string())
            begins = np.r_[True, (key[1:] != key[:-1]).any(1)]
            begins[:: PIECE // 16] = True
            begins = np.flatnonzero(begins)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, batch.num_rows].astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(begins)) for k in range(4)), pc.binary_join(lists, ",")], [*_KEY, "first", "ids"])

    pieces = map_arrow(ordered, join, "depth long, f1 long, f2 long, first long, ids string").repartition(*_KEY).sortWithinPartitions(*_KEY, "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            keys, sums = [], []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if key == own:
                    state.update(b"," + text.encode())
                    continue
                if own is not None:
                    keys.append(own)
                    sums.append(state.hexdigest())
                own, state = key, hashlib.sha256(text.encode())
            yield _digests(keys, sums)
        if own is not None:
            yield _digests([own], [state.hexdigest()])

    def _digests(keys: list[list[int]], sums: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array(sums, pa.string())], [*_KEY, "ends_sha256"])

    return map_arrow(pieces.select(*_KEY, "ids"), digest, "depth long, f1 long, f2 long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame | None:
    """The trie of members() rows; None if a fingerprint stands for two prefixes.

    Subtrees aren't walked. A node is represented by its smallest member, which then
    represents all further nodes on its own path. So a conversation has the bytes of
    the nodes below that it doesn't represent: those before the first one that it
    does. Sums over a subtree are sums over a node's members.
    """
    checks = ("p1", "p2", "g1", "g2")
    nodes = cut_lineage(
        rows.groupBy(*_KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.min("before").alias("before"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
            F.max(F.struct(*checks)).alias("most"), F.min(F.struct(*checks)).alias("least"),
        )
    )
    # Equal parents and equal last turns for all members, and so, by depth, equal turns throughout.
    if not nodes.where("most IS DISTINCT FROM least").isEmpty():
        return None
    # For each conversation that represents nodes: the first of them, and whether it ends at a leaf that it represents.
    first = nodes.groupBy("conv_id").agg(F.min("before").alias("from_bytes"), F.min("depth").alias("first_depth"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
    spared = F.coalesce(F.col("from_bytes"), F.col("all_bytes"))
    total = rows.groupBy("conv_id").agg(F.max(F.col("before") + F.col("n_bytes")).alias("all_bytes"))
    own = total.join(first, "conv_id", "left").select(F.col("conv_id").alias("of"), spared.alias("spared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = rows.join(own, F.col("conv_id") == F.col("of")).groupBy(*_KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("spared") - F.col("before"), F.lit(0))).alias("saved_tokens"))
    # A node's children: nodes one deeper that name it as parent.
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    # Below the first node that a conversation represents its nodes' parents are its own too, so only these firsts look for theirs.
    tops = first.select(F.col("conv_id").alias("of"), "first_depth")
    seek = nodes.where("depth > 0").select("conv_id", "depth", "p1", "p2", "f1", "f2").join(tops, (F.col("conv_id") == F.col("of")) & (F.col("depth") == F.col("first_depth")))
    above = nodes.select((F.col("depth") + 1).alias("d"), F.col("f1").alias("q1"), F.col("f2").alias("q2"), F.col("conv_id").alias("parent"))
    seek = seek.join(above, (F.col("depth") == F.col("d")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2"))).select(*_KEY, "parent")
    ends = end_hashes(rows.where("ends"))
    keys = list(_KEY)
    out = nodes.select(*keys, "conv_id", "n_convs").join(sums, keys).join(children, keys, "left").join(seek, keys, "left").join(ends, keys, "left")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns are in order of `turn`, null first, then role and text;
    null role and text are empty. Conversation c is rebuilt from the first h turns of
    c - c % FAMILY (% as in SQL, with the sign of c) and its own after its first h, h
    from a checksum of c. Rows without conv_id are left out; a repeated row is a turn
    as often as it comes; other columns are left out. An empty table gives an empty
    one, without a root.
    """
    for seeds in SEEDS:
        rows = turns(conversations, seeds)
        if hashes_clash(rows):
            continue
        found = trie(cut_lineage(members(composed(cut_lineage(scanned(rows))))))
        if found is not None:
            return found
    raise RuntimeError("all pairs of hashes stand for different turns or prefixes")
