"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only on a single machine where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read back from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch between Spark and its Python workers, about; texts of any length so take bounded memory on both sides.
BATCH_BYTES = 4 << 20
#: Rows of a batch that Python objects are made of at a time.
SLICE_ROWS = 256


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES; a reused worker gives the memory of its task back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: str | F.Column) -> F.Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def words(text: str | F.Column) -> F.Column:
    """Words of a text, with A-Z in lower case; null or blank: an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, SPACE), "")


#: Ids of rows to leave out, or to look up, that are broadcast at most (about 16 MB); more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def among(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is in ids (one column), which can be read again cheaply; columns and repeated rows stay as they are."""
    wanted = ids.toDF("wanted_id")
    if wanted.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs[id_col] == wanted["wanted_id"], "left_semi")


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is in ids (one column). Rows with a null id stay; columns and repeated rows stay as they are."""
    out = cut_lineage(ids.toDF("left_out_id").where("left_out_id IS NOT NULL").distinct())
    if out.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        out = F.broadcast(out)
    return docs.join(out, docs[id_col] == out["left_out_id"], "left_anti")


#: Rows of one key from which it is joined by broadcast, and bytes that are broadcast at most where rows have no bounded size.
HOT_ROWS, MAX_BROADCAST_BYTES = 1_000_000, 64 << 20


def join_counted(rows: DataFrame, small: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with small, which has a row for each key with the number n of rows that have it, and can be read again cheaply.

    Keys of more than HOT_ROWS rows, so at most a row of small for each HOT_ROWS of
    rows, are broadcast; their rows stay where they are. how: inner or left.
    """
    hot = small.where(F.col(n) > HOT_ROWS)
    if hot.isEmpty():
        return rows.join(small, keys, how)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.where(F.col(n) <= HOT_ROWS), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def broadcast_if_small(df: DataFrame, size: F.Column, most: int | None = None) -> DataFrame:
    """df with a hint to broadcast it, if its rows' sizes in bytes add up to no more than `most`. df can be read again cheaply."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= (MAX_BROADCAST_BYTES if most is None else most) else df


#: The column by which with_row_key tells rows apart.
ROW = "row key"


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ROW: the id, or for a row without one a number above 2 ** 62 from its text, so that rows without ids can be judged, too.

    Rows without ids have one key if their texts are the same, as repeated rows have.
    """
    nameless = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND((1 << 62) - 1) + (1 << 62)
    return docs.withColumn(ROW, F.coalesce(F.col(id_col).cast("long"), nameless))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)
