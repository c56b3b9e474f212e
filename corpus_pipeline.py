"""Corpus pipeline: quality, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
documents. Rows with a null id are judged by a key of their text, rows with one id
together; a null text is an empty document; other columns than doc_id, text, source
and lang are carried along, but for n_chars, which redaction counts anew. An empty
table gives an empty one at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.llm import decontamination, near_dedup, pattern_packing, secret_forest, site_quality
from tapegrid.llm.common import ROW, table, with_row_key, without, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents whose posterior of being good is below a half."""
    evidence = site_quality.fit_documents(docs, table(spark, sf_dir, "labels"))
    keyed = with_row_key(docs)
    scored = site_quality.site_quality(keyed, evidence, F.col("source"), F.col("lang"), id_col=ROW)
    return without(keyed, scored.where("NOT keep").select(ROW), ROW).drop(ROW)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates (similarity 0.8 or more); a row without an id only if none in its group has one."""
    keyed = with_row_key(docs)
    found = near_dedup.near_duplicates(keyed, similarity_percent=80, id_col=ROW)
    return without(keyed, found.where("NOT kept").select(ROW), ROW).drop(ROW)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that overlap with a benchmark item."""
    keyed = with_row_key(docs)
    return without(keyed, decontamination.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=ROW).select(ROW), ROW).drop(ROW)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark."""
    keyed = with_row_key(docs)
    return secret_forest.redacted(keyed, secret_forest.secrets(keyed, id_col=ROW), id_col=ROW).drop(ROW)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens."""
    return pattern_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scan", redact),
    ("pattern packing", pack),
]

#: The stages fit models, lay passages on each other and call a tokenizer, which SQL doesn't express. Tests hold each
#: stage against plain Python: posteriors, similarities and overlaps of all pairs, planted secrets, and the tokenizer's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
