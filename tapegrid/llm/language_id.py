"""Operator 10: language identification by rank-order profiles of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.llm.common import map_arrow, sliced

#: N-grams of a profile, of a language and of a document.
PROFILE = 300
#: Learning rows at most (about): the rows with the smallest hashes of the id.
MAX_TRAINING = 40_000
UNKNOWN = "und"
_SPACE = 32


class Letters:
    """Code points in lower case, and one space for each run of anything but letters."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        code = self.table[raw]
        if (code < 0).any():
            for c in np.unique(raw[code < 0]).tolist():
                low = chr(c).lower()
                self.table[c] = ord(low[0]) if chr(c).isalpha() else _SPACE
            code = self.table[raw]
        code = np.concatenate(([_SPACE], code, [_SPACE])).astype(np.int64)
        return code[np.r_[True, (code[1:] != _SPACE) | (code[:-1] != _SPACE)]]


def grams(code: np.ndarray) -> np.ndarray:
    """Codes of all 1- to 3-grams, sorted; those that are a space alone left out."""
    two = (code[:-1] << 21) | code[1:]
    three = (two[:-1] << 21) | code[2:]
    every = np.concatenate((code[code != _SPACE], two, three))
    every.sort()
    return every


def counted(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[first], np.diff(np.r_[first, len(every)])


def ranked(gram: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, the first first; ties by code."""
    if len(gram) > 4 * size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        keep = count >= least
        gram, count = gram[keep], count[keep]
    return gram[np.argsort(-count, kind="stable")[:size]]


def profiles(docs: DataFrame, size: int = PROFILE, max_training: int = MAX_TRAINING, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> pd.DataFrame:
    """Columns lang, gram, rank (from 0), for each label of docs: its most frequent n-grams.

    Rows with a null text or label are left out. Only the `size` best n-grams of
    each label come to the driver. Over max_training rows each label gets an equal
    part of them: of labels with more rows a hash of the id picks about so many, of
    others all rows are taken, so a rare language keeps its profile.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if sum(counts.values()) > max_training:
        share = {lang: int(min(1.0, max_training / len(counts) / n) * (1 << 30)) for lang, n in counts.items()}
        share = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in sliced(batches):
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(letters(text)))
            for lang, parts in found.items():
                gram, count = counted(np.sort(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])

    counts = map_arrow(rows.select("lang", "text"), work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < size).select("lang", "gram", "rank").toPandas()


def predict(docs: DataFrame, learned: pd.DataFrame, size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score.

    The document's n-grams are ranked as the profiles are; an n-gram's distance is
    how far its ranks are apart, or `size` if the profile lacks it; the language
    with the least sum wins, on ties the first by name. score: 1 less the mean
    distance, as a part of the greatest one. A null text, or one without letters, is
    'und' with score 0, as is every text if no language was learned. Null ids stay
    null; repeated rows give repeated rows; other columns are left out.
    """
    langs = sorted(learned["lang"].unique())
    known = np.unique(learned["gram"].to_numpy(np.int64))
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    ranks[learned["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64), np.searchsorted(known, learned["gram"].to_numpy(np.int64))] = learned["rank"].to_numpy(np.int64)

    def one(text: str | None, letters: Letters) -> tuple[str, float]:
        code = letters(text) if text else None
        if code is None or not langs or not (code != _SPACE).any():
            return UNKNOWN, 0.0
        own = ranked(*counted(grams(code)), size)
        at = np.searchsorted(known, own)
        at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own), at, len(known))
        theirs = ranks[:, at]
        distance = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(own)))).sum(1)
        k = int(np.argmin(distance))
        return langs[k], float(1 - distance[k] / (size * len(own)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in sliced(batches):
            found = [one(t, letters) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    out = map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, "id long, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """True for the rows of the fold that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds == 0, F.lit(False))
