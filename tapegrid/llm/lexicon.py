"""A minimal acyclic transducer from words to token ids, as one memory-mapped file.

Equal endings of words share states. The outputs on a word's path add up to its
place among the sorted words, and so to its ids in a table behind the automaton.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from tapegrid.llm.common import shared_folder

#: Names and types of the arrays of a file, in their order; the file begins with their lengths.
LAYOUT = (("arc", "<i8"), ("target", "<i4"), ("output", "<i4"), ("final", "<i4"), ("begin", "<i4"), ("ids", "<u4"))


def _automaton(words: Iterable[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool]]:
    """Arcs (byte, target) and finality of the states of the least automaton for rising, different words; state 0 is the start."""
    arcs: list[list[tuple[int, int]]] = [[]]
    final = [False]
    known: dict[tuple, int] = {}
    free: list[int] = []
    path = [0]  # states of the last word, which may still get arcs

    def settle(depth: int, word: bytes) -> None:
        """Replaces the states of the last word's end by equal ones where there are any."""
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], *arcs[state])
            if (same := known.setdefault(key, state)) != state:
                arcs[path[-1]][-1] = (word[len(path) - 1], same)
                arcs[state], final[state] = [], False
                free.append(state)

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        settle(shared, last)
        for byte in word[shared:]:
            if free:
                state = free.pop()
            else:
                state = len(arcs)
                arcs.append([])
                final.append(False)
            arcs[path[-1]].append((byte, state))
            path.append(state)
        final[path[-1]] = True
        last = word
    settle(0, last)
    return arcs, final


def compiled(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The file for different words, none empty, and the ids of each."""
    order = sorted(range(len(words)), key=words.__getitem__)
    arcs, final = _automaton(words[k] for k in order)
    below = [-1] * len(arcs)  # words that end at or below a state
    stack = [0]
    while stack:
        state = stack[-1]
        if open_ones := [t for _, t in arcs[state] if below[t] < 0]:
            stack += open_ones
        else:
            below[state] = final[state] + sum(below[t] for _, t in arcs[state])
            stack.pop()
    arc, target, output = [], [], []
    for state, own in enumerate(arcs):
        before = int(final[state])
        for byte, t in own:
            arc.append(state << 8 | byte)
            target.append(t)
            output.append(before)
            before += below[t]
    sizes = [len(ids[k]) for k in order]
    arrays = {"arc": arc, "target": target, "output": output, "final": final, "begin": np.r_[0, np.cumsum(sizes, dtype=np.int64)], "ids": [i for k in order for i in ids[k]]}
    parts = [np.asarray(arrays[name]).astype(kind).tobytes() for name, kind in LAYOUT]
    return np.array([len(x) // int(kind[-1]) for x, (_, kind) in zip(parts, LAYOUT, strict=True)], "<i8").tobytes() + b"".join(parts)


class Lexicon:
    """Looks up many words at once in a file of compiled(); the file is mapped, not read."""

    def __init__(self, path: str):
        self.at = {}
        sizes = np.fromfile(path, "<i8", len(LAYOUT)).tolist()
        raw = np.memmap(path, np.uint8, "r")
        start = 8 * len(LAYOUT)
        for (name, kind), n in zip(LAYOUT, sizes, strict=True):
            self.at[name] = np.ndarray((n,), kind, raw, start)
            start += n * int(kind[-1])
        self.ids = self.at["ids"]

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each word (large_string) among the lexicon's; -1 if it isn't there. All words take a step together."""
        arc, target, output = (self.at[c] for c in ("arc", "target", "output"))
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        out = np.full(len(words), -1, np.int64)
        on = np.flatnonzero(np.diff(offsets) > 0) if len(arc) else np.zeros(0, np.int64)
        state, place, at = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64), offsets[on]
        ends = offsets[on + 1]
        while len(on):
            key = state << 8 | data[at]
            k = np.minimum(np.searchsorted(arc, key), len(arc) - 1)
            met = arc[k] == key
            on, k, at, ends, place = on[met], k[met], at[met] + 1, ends[met], place[met]
            state, place = target[k].astype(np.int64), place + output[k]
            done = at == ends
            stop = done & (self.at["final"][state] != 0)
            out[on[stop]] = place[stop]
            on, state, at, ends, place = on[~done], state[~done], at[~done], ends[~done], place[~done]
        return out

    def rows(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words begin, by their places, and how many they are."""
        begin = self.at["begin"].astype(np.int64)
        return begin[places], begin[places + 1] - begin[places]


def published(spark: SparkSession, raw: bytes) -> str:
    """Puts a file into the shared checkpoint folder and has Spark bring it to each executor, also to later ones. Its name there."""
    context = spark.sparkContext
    name = f"lexicon-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(raw))
    finally:
        stream.close()
    context.addFile(path.toString())
    return name


def mapped(name: str) -> Lexicon:
    """In a task: the file of that name."""
    return Lexicon(SparkFiles.get(name))


def is_word(units: pa.Array, longest: int) -> pa.Array:
    """Units that may stand in a lexicon."""
    size = pc.binary_length(units)
    return pc.and_(pc.greater(size, 0), pc.less_equal(size, longest))
