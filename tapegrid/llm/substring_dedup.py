"""Operator 1: removal of repeated substrings by suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.llm.common import cut_lineage, join_counted, map_arrow, partitions, text_bytes
from tapegrid.llm.suffix_sorting import adjacent_prefixes, heads, suffix_array
from tapegrid.llm.text_hashes import mix

LENGTH = 50
#: Bytes of the strings among which each window has its anchor.
GRAM = 20
#: Bytes of texts looked at together, and of contexts in one suffix array, about.
TEXT_UNIT = 1 << 20
SORT_UNIT = 1 << 20
#: Copies that are broadcast at most (about 16 MB).
MAX_BROADCAST = 1_000_000
#: A place in a text and, above these bits, the number of the text among those of its id.
_ORDER_BITS = 40
_M = 0x9E3779B97F4A7C15
_POWER = {k: np.uint64(pow(_M, k, 1 << 64)) for k in (1, 2, 4, 8, 16)}


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 16 + 4 bytes from each position where they fit."""
    h = data.astype(np.uint64) + np.uint64(1)
    kept = {}
    for k in (1, 2, 4, 8):
        h = h[:-k] * _POWER[k] + h[k:]
        kept[2 * k] = h
    return mix(h[: len(data) - GRAM + 1] * _POWER[4] + kept[4][16 : 16 + len(data) - GRAM + 1])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor, text number, first window, last window), places in data.

    data: texts one after another, which end at `ends`. A window is `length` bytes of
    one text; its anchor is the least hash of a GRAM in it, so equal windows have
    equal anchors wherever they are.
    """
    value = np.zeros(max(0, len(data) - length + 1), np.uint64)
    step = 1 << 16
    for a in range(0, len(value), step):  # in parts that fit the caches
        b = min(a + step, len(value))
        value[a:b] = _least(_gram_hashes(data[a : b + length - 1]), length - GRAM + 1)
    at = np.arange(len(value))
    text = np.searchsorted(ends, at, side="right")
    at = at[at + length <= ends[text]]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    v, t = value[at], text[at]
    new = np.r_[True, (v[1:] != v[:-1]) | (t[1:] != t[:-1])]
    first = np.flatnonzero(new)
    return v[first], t[first], at[first], at[np.r_[first[1:] - 1, len(at) - 1]]


def _units(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a column of texts: (first row, bytes of the rows in one, where each row ends)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + TEXT_UNIT, side="right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        a = b


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and key, those whose anchor has another key; each once."""
    held: tuple[int, int] | None = None  # the last row, and whether its anchor was met before
    met = False
    for batch in batches:
        if not batch.num_rows:
            continue
        a, k = (batch.column(c).to_numpy() for c in (0, 1))
        if held is not None:
            a, k = np.r_[held[0], a], np.r_[held[1], k]
        new = np.r_[True, (a[1:] != a[:-1]) | (k[1:] != k[:-1])]
        a, k = a[new], k[new]
        same = a[1:] == a[:-1]
        keep = np.r_[met, same] | np.r_[same, False]
        last_met = bool(keep[-1]) if len(a) > 1 else met
        held, met = (a[-1], k[-1]), last_met
        yield pa.RecordBatch.from_arrays([pa.array(k[:-1][keep[:-1]]), pa.array(a[:-1][keep[:-1]])], ["key", "anchor"])
    if held is not None and met:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([held[1]], np.int64)), pa.array(np.array([held[0]], np.int64))], ["key", "anchor"])


class _Contexts:
    """Contexts with the same or different anchors, to be sorted together."""

    def __init__(self, length: int):
        self.length = length
        self.number: dict[bytes, int] = {}
        self.size = 0
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, start: np.ndarray, contexts: list[bytes]) -> None:
        number = self.number
        own = np.empty(len(contexts), np.int64)
        for k, c in enumerate(contexts):
            n = number.get(c)
            if n is None:
                n = number[c] = len(number)
                self.size += len(c)
            own[k] = n
        self.rows.append((key, start, own))

    def spans(self) -> pa.RecordBatch | None:
        """(key, start, stop) of the bytes that windows of smaller keys cover."""
        if not self.rows:
            return None
        key, start, own = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        contexts = list(self.number)
        least = np.full(len(contexts), np.iinfo(np.int64).max)
        np.minimum.at(least, own, key)
        # UTF-8 has no byte 255, so one more fits, and 0 parts the contexts.
        text = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8) + np.uint8(1)
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        begin = np.cumsum(sizes + 1) - sizes - 1
        windows = sizes - self.length + 1
        head = heads(text)
        order = suffix_array(text, head, self.length + 6)
        owner = np.full(len(text), -1, np.int64)
        place = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        owner[place] = np.repeat(np.arange(len(contexts)), windows)
        order = order[owner[order] >= 0]
        new = np.flatnonzero(np.r_[True, ~adjacent_prefixes(head, order, self.length)])
        smallest = np.minimum.reduceat(least[owner[order]], new)
        of_window = np.empty(len(text), np.int64)
        of_window[order] = np.repeat(smallest, np.diff(np.r_[new, len(order)]))
        ordered = of_window[place]
        cut = np.cumsum(windows) - windows
        low, high = np.minimum.reduceat(ordered, cut), np.maximum.reduceat(ordered, cut)
        whole = high[own] < key
        part = ~whole & (low[own] < key)
        out = [(key[whole], start[whole], start[whole] + sizes[own[whole]])]
        for k in np.flatnonzero(part).tolist():
            mine = ordered[cut[own[k]] : cut[own[k]] + windows[own[k]]] < key[k]
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False]))
            a, b = edge[::2], edge[1::2]
            out.append((np.full(len(a), key[k]), start[k] + a, start[k] + b + self.length - 1))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "start", "stop"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte goes that lies in a string of `length` bytes which also starts in a
    document with a smaller id, judged on the texts as they came; spans are maximal
    removed runs; the hash is of the bytes that are left.

    Copies of a whole text go at once. In the others every window of `length` bytes
    is known by its anchor. Windows whose anchor another document has are brought
    together with the bytes around them; there a suffix array (see suffix_sorting)
    of the different contexts puts equal windows side by side, their common prefixes
    show where one ends, and the smallest id of each counts.

    A null text is empty. Rows with null ids are kept whole and compared with
    nothing. Rows with one id take nothing from each other, whether their texts are
    the same or not. Other columns are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    raw = text_bytes(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw"))
    base = cut_lineage(own.select("id", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha")))
    rows = base.where("id IS NOT NULL")
    texts = own.where("id IS NOT NULL").select(F.col("id").alias("key"), "raw")
    each = rows.groupBy("id", "sha").agg(F.count("*").alias("n"))
    repeated = each.groupBy("id").agg(F.count("*").alias("texts"), F.max("n").alias("n")).agg(F.max("texts").alias("texts"), F.max("n").alias("n")).first()
    # Texts of one id are told apart by a number, in the order of their hashes.
    if (repeated["texts"] or 1) == 1:
        keyed, texts = rows.withColumn("ord", F.lit(0).cast("long")), texts.withColumn("ord", F.lit(0).cast("long"))
    else:
        number = each.select("id", "sha", (F.row_number().over(Window.partitionBy("id").orderBy("sha")) - 1).cast("long").alias("ord"))
        keyed = rows.join(number, ["id", "sha"])
        texts = texts.withColumn("sha", F.sha2("raw", 256)).join(number.withColumnRenamed("id", "key"), ["key", "sha"]).drop("sha")
    # Only whole texts that come more than once have a first one; short ones stay out, however often they come.
    firsts = cut_lineage(rows.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    if firsts.limit(MAX_BROADCAST // 8 + 1).count() <= MAX_BROADCAST // 8:  # some 100 bytes each
        keyed = cut_lineage(keyed.join(F.broadcast(firsts.drop("n")), "sha", "left"))
    else:
        long = join_counted(keyed.where(F.col("n_bytes") >= length), firsts, ["sha"], how="left").drop("n")
        keyed = cut_lineage(long.unionByName(keyed.where(F.col("n_bytes") < length), allowMissingColumns=True))
    copies = keyed.where("id > first").select(F.col("id").alias("copy"), F.col("ord").alias("copy_ord"))
    if copies.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        copies = F.broadcast(copies)
    texts = texts.where(F.octet_length("raw") >= length).join(copies, (F.col("key") == F.col("copy")) & (F.col("ord") == F.col("copy_ord")), "left_anti")
    n = partitions(spark)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for a, data, ends in _units(batch.column(1)):
                value, text, _, _ = anchors(data, ends, length)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(key[a + text])], ["anchor", "key"])

    dealt = map_arrow(texts, anchored, "anchor long, key long").repartition(n, "anchor").sortWithinPartitions("anchor", "key")
    shared = map_arrow(dealt, _shared, "key long, anchor long").groupBy("key").agg(F.collect_list("anchor").alias("anchors"))

    def surrounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lists, order = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            bounds = lists.offsets.to_numpy()
            wanted_all = lists.values.to_numpy()
            for a, data, ends in _units(batch.column(1)):
                value, text, first, last = anchors(data, ends, length)
                value = value.view(np.int64)
                wanted = wanted_all[bounds[a] : bounds[a + len(ends)]]
                # By text and anchor together; a rare false match only sends a context too many.
                tag = mix(np.repeat(np.arange(len(ends)), np.diff(bounds[a : a + len(ends) + 1])).astype(np.uint64)) ^ wanted.view(np.uint64)
                keep = np.isin(mix(text.astype(np.uint64)) ^ value.view(np.uint64), tag)
                value, text, first, last = value[keep], text[keep], first[keep], last[keep]
                begin = np.r_[0, ends[:-1]][text]
                raw = data.tobytes()
                contexts = [raw[s : e + length] for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(key[a + text]), pa.array((order[a + text] << _ORDER_BITS) + first - begin), pa.array(contexts, pa.binary())], ["anchor", "key", "start", "context"])

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, last = _Contexts(length), None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, key, start = (batch.column(c).to_numpy() for c in range(3))
            contexts = batch.column(3).to_pylist()
            cut = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            a = 0
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if unit.size > SORT_UNIT and anchor[s] != last:  # between anchors only
                    if s > a:
                        unit.add(key[a:s], start[a:s], contexts[a:s])
                        a = s
                    found = unit.spans()
                    if found is not None:
                        yield found
                    unit = _Contexts(length)
                elif e - a > 4096:
                    unit.add(key[a:e], start[a:e], contexts[a:e])
                    a = e
                last = anchor[s]
            unit.add(key[a:], start[a:], contexts[a:])
        found = unit.spans()
        if found is not None:
            yield found

    around = map_arrow(texts.join(shared, "key").select("key", "raw", "anchors", "ord"), surrounded, "anchor long, key long, start long, context binary")
    spans = map_arrow(around.repartition(n, "anchor").sortWithinPartitions("anchor"), covered, "key long, start long, stop long")
    in_text = lambda at: F.col(at).bitwiseAND((1 << _ORDER_BITS) - 1).alias(at)
    by_key = spans.groupBy("key", F.shiftright("start", _ORDER_BITS).alias("ord")).agg(F.array_sort(F.collect_list(F.struct(in_text("start"), in_text("stop")))).alias("spans"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
                for s in spans:
                    start, stop = s["start"], s["stop"]
                    if start > at or not runs:
                        kept.update(text[at:start])
                        runs += 1
                        removed += stop - start
                    else:
                        removed += max(0, stop - at)
                    at = max(at, stop)
                kept.update(text[at:])
                for column, x in zip(out, (removed, runs, kept.hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["id", "ord", "n_removed", "n_spans", "kept"])

    cut = map_arrow(texts.join(by_key, ["key", "ord"]).select("key", "raw", "spans", "ord"), cut_out, "id long, ord long, n_removed long, n_spans long, kept string")
    if (repeated["n"] or 1) > 1:
        cut = cut.dropDuplicates(["id", "ord"])
    gone = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    found = keyed.join(cut, ["id", "ord"], "left").select(
        "id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
    nameless = base.where("id IS NULL").select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return found.unionByName(nameless).withColumnRenamed("id", id_col)
