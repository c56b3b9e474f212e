"""Operator 6: token counts with overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.common import map_arrow
from tapegrid.llm.unit_tokens import UnitCounter

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK = 4096
OVERLAP = 256
#: Characters at a chunk's end in which a boundary isn't proven: the text after
#: the chunk could still change it (a special token begun, a run of spaces).
MARGIN = 32


def spliced(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text from overlapping chunks.

    encode(part) -> (boundaries, tokens before each boundary). Each chunk is right
    from a proven boundary on; the next one starts `overlap` characters before the
    chunk's end. A boundary that both have, MARGIN before the end of the first, is
    stable: scanning only looks forward from it. If there is none, the overlap is
    doubled, at last to the whole of the chunk, and then the chunk itself grows.
    """
    total, proven, start, size = 0, 0, 0, chunk
    at, before = encode(text[:size])
    while True:
        end = start + size
        if end >= len(text):
            return total + int(before[-1] - before[np.searchsorted(at, proven - start)])
        lap = overlap
        while True:
            lap = min(lap, end - proven)
            nxt = end - lap
            at2, before2 = encode(text[nxt : nxt + max(chunk, 2 * lap)])
            last = end - MARGIN
            own, other = at[:-1] + start, at2[:-1] + nxt
            # The next chunk's own start is a boundary only by chance, unless it is the proven one.
            both = np.intersect1d(own[(own <= last) & (own >= proven)], other if nxt == proven else other[1:])
            if len(both):
                break
            if lap == end - proven:
                break
            lap *= 2
        if len(both) and both[-1] > proven:
            stable = int(both[-1])
            total += int(before[np.searchsorted(at, stable - start)] - before[np.searchsorted(at, proven - start)])
            start, size, proven, at, before = nxt, max(chunk, 2 * lap), stable, at2, before2
        else:  # no stable boundary in the whole chunk: encode a longer one from the proven place
            start, size = proven, 2 * (end - proven)
            at, before = encode(text[start : start + size])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    A null text is empty: no bytes, no tokens. A null id stays null; repeated rows
    give repeated rows; an empty table gives an empty one; other columns of docs
    are left out. Texts over `chunk` characters go in overlapping chunks, so that a
    task never holds the encoding of a whole huge text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnitCounter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = np.zeros(len(texts), np.int64)
            group: list[tuple[int, list[str]]] = []
            held = 0

            def settle() -> None:
                counter.learn([u for _, units in group for u in units])
                for k, units in group:
                    counts[k] = counter.count(units)
                group.clear()

            for i, text in enumerate(texts):
                if len(text) > chunk:
                    counts[i] = spliced(text, counter.encode, chunk, overlap)
                elif not counter.plain(text):
                    counts[i] = counter.whole(text)
                else:
                    group.append((i, units := counter.units(text)))
                    held += len(units)
                    if held > 50_000:
                        settle()
                        held = 0
            settle()
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit, pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
