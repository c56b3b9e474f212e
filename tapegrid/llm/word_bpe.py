"""Operator 12: BPE encoding and decoding with a lexicon of frequent words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.llm.common import cut_lineage, map_arrow
from tapegrid.llm.lexicon import compiled, is_word, mapped, published
from tapegrid.llm.word_ids import WordIds, cut_places, text_parts, units_between

#: Words of a lexicon, and bytes of the longest. A file takes some 30 bytes a word; other words are merged when they are met.
WORDS, LONGEST = 50_000, 48
#: Different words whose counts a task holds; beyond, it passes them on.
HELD = 200_000
#: Steps of the histogram of word counts for each doubling of a count.
STEPS = 16


def word_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """word, n over all texts. A word is a unit that is encoded alone; each task adds up its own before Spark does."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for _, _, data, ends in text_parts(batch.column(0)):
                if not len(data):
                    continue
                coded = units_between(data, cut_places(data, ends)).dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                found = pa.table({"word": coded.dictionary.cast(pa.large_binary()), "n": n})
                held.append(found.filter(is_word(coded.dictionary, longest)))
                rows += len(held[-1])
                if rows > HELD:
                    held = [_summed(held)]
                    rows = len(held[0])
                    if rows > HELD // 2:
                        yield from _counts(held)
                        held, rows = [], 0
        if held:
            yield from _counts([_summed(held)])

    return map_arrow(docs.select(text_col), work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _counts(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    for t in tables:
        yield from t.cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches(max_chunksize=20_000)


def frequent(counts: DataFrame, words: int) -> DataFrame:
    """The most frequent words of counts (word, n), at most so many: those above a count that leaves no more.

    The count comes from a histogram in STEPS steps for each doubling, a few hundred
    rows whatever the corpus, so no task has to merge the first words of all others.
    """
    step = F.floor(F.log2("n") * STEPS)
    left, least = words, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n_words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        if r.n_words > left:
            break
        left, least = left - r.n_words, r.least
    return counts.where(F.col("n") >= least) if least else counts.where(F.lit(False))


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text", words: int = WORDS) -> str:
    """Compiles the most frequent words of all texts and brings the file to the executors. Its name.

    What comes to the driver is bounded by `words`. A lexicon only saves merges: ids
    don't depend on it.
    """
    top = frequent(cut_lineage(word_counts(docs, text_col)), words).select("word").toArrow()
    units = top.column("word").combine_chunks().cast(pa.large_string())
    encoder = WordIds(tokenizer_path)
    pool, begins, sizes = encoder.found(units)
    ids = [pool[b : b + n].tolist() for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
    return published(docs.sparkSession, compiled([w.encode() for w in units.to_pylist()], ids))


class LexiconIds(WordIds):
    """WordIds that looks units up in a lexicon first; the others are merged and kept for the task."""

    def __init__(self, path: str, name: str):
        super().__init__(path)
        self.lexicon = mapped(name)

    def found(self, different: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = self.lexicon.places(different)
        known = places >= 0
        begins, sizes = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        begins[known], sizes[known] = self.lexicon.rows(places[known])
        if known.all():
            return self.lexicon.ids, begins, sizes
        pool, own_begins, own_sizes = super().found(different.filter(pa.array(~known)))
        begins[~known], sizes[~known] = own_begins + len(self.lexicon.ids), own_sizes
        return np.concatenate([self.lexicon.ids, pool]), begins, sizes


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids (array<int>), as the library gives them without special tokens added, truncation and padding.

    A null or empty text has no ids. Special tokens' strings inside texts become
    their ids, as the library has it. A null id stays null; repeated rows give
    repeated rows; other columns are left out; an empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LexiconIds(tokenizer_path, lexicon)
        for batch in batches:
            for first, ids, ends in encoder(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ends)), lists], ["id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: id, ids, text, as the library's decode(ids, skip_special_tokens=False).

    This tokenizer has no decoder of its own, so a text is its tokens' strings with
    a space between them. Null ids are an empty text; ids without a token are left
    out, as the library does.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        known = {k: token for token, k in tok.get_vocab().items()}
        tokens = pa.array([known.get(k) for k in range(max(known, default=-1) + 1)], pa.string())
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            ids = lists.flatten()
            valid = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(tokens))), False)
            strings = tokens.take(pc.if_else(valid, ids, pa.scalar(None, pa.int32())))
            if strings.null_count:
                kept = np.r_[0, np.cumsum(strings.is_valid().to_numpy(zero_copy_only=False))]
                ends, strings = kept[ends], strings.drop_null()
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), strings), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, joined], ["id", "ids", "text"])

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")), work, "id long, ids array<int>, text string").withColumnRenamed("id", id_col)


def digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, words: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of texts that were encoded and decoded with a lexicon of their own words."""
    both = decode(encode(docs, tokenizer_path, build_lexicon(docs, tokenizer_path, words=words)), tokenizer_path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
