"""Operator 8: shards cut from a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapegrid.llm.common import cut_lineage, map_arrow, partitions, text_bytes

SHARDS = 40
#: Bits of each dimension; its range is cut at 2 ** BITS - 1 quantiles at most.
BITS = 5
#: Error of a quantile is 1 / ACCURACY of the rows.
ACCURACY = 2000


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of x, shape (rows, dimensions), values below 2 ** bits.

    Works from the highest bit down: each step inverts or exchanges the lower bits
    so that the next smaller cube has the curve's start and end where the larger
    one needs them; a Gray decode across dimensions gives the index.
    """
    x = x.T.astype(np.int64).copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _numbers(df: DataFrame, column: str) -> F.Column:
    """A column that isn't a string as a number in the same order; null and NaN are null."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("boolean", "date", "timestamp", "timestamp_ntz"):
        return F.col(column).cast("timestamp" if kind != "boolean" else "int").cast("double")
    return F.nanvl(F.col(column).cast("double"), F.lit(None))


def _string_cuts(rows: DataFrame, column: str, bits: int) -> list[str]:
    """Quantiles of whole strings: those at which the rows up to them pass a multiple of 1 / 2 ** bits of all.

    Different values are counted, sorted across partitions and summed up; only the
    cuts and the partitions' sums come to the driver.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = cut_lineage(counts.repartitionByRange(partitions(spark), "value").withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("part").agg(F.sum("n").alias("n")).toPandas().sort_values("part")
    total = int(sums["n"].sum())
    if not total:
        return []
    sums["before"] = sums["n"].cumsum() - sums["n"]
    before = spark.createDataFrame(sums[["part", "before"]].astype("int64"), "part long, before long")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    # One row per partition.
    passed = ordered.join(F.broadcast(before), "part").withColumn("upto", upto)
    step = total / (1 << bits)
    return sorted(r["value"] for r in passed.where(F.floor(F.col("upto") / step) > F.floor((F.col("upto") - F.col("n")) / step)).select("value").collect())


def hilbert_shards(docs: DataFrame, dimensions: list[str], shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard, hilbert.

    Each dimension is cut at its quantiles, strings as a whole (nulls and NaN in the lowest cell), rows
    are sorted by curve index, text checksum, size and id, and run k of the `shards`
    runs is shard k: counts are at most one apart (law `rows`). size is the text's
    bytes plus 16, a null text has none; null ids sort first; repeated rows each
    get a slot; columns that aren't used are left out; an empty table gives an
    empty one. Only partition sizes and quantiles come to the driver.
    """
    names = [f"d{k}" for k in range(len(dimensions))]
    strings = [docs.schema[c].dataType.typeName() == "string" for c in dimensions]
    raw = text_bytes(text_col)
    values = [(F.col(c) if string else _numbers(docs, c)).alias(n) for c, n, string in zip(dimensions, names, strings, strict=True)]
    rows = cut_lineage(docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *values))
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [n for n, string in zip(names, strings, strict=True) if not string]
    found = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(n, steps, ACCURACY).alias(n) for n in numbers]).first()
    cuts = [_string_cuts(rows, n, bits) if string else sorted(set(found[n] or [])) for n, string in zip(names, strings, strict=True)]

    def cell(name: str, string: bool, at: list) -> F.Column:
        """0: null; else one more than the cuts below the value, within the cube."""
        below = F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c < F.col(name) if string else c <= F.col(name))) if at else F.lit(0)
        return F.when(F.col(name).isNull(), 0).otherwise(F.least(below + 1, F.lit((1 << bits) - 1)))

    @F.pandas_udf("long")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in cells], 1), bits))

    order = ["hilbert", "text_crc32", "size", "id"]
    on_curve = rows.withColumn("hilbert", curve(*[cell(*x) for x in zip(names, strings, cuts, strict=True)])).drop(*names)
    dealt = on_curve.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    # Written and read in these partitions and this order.
    dealt = cut_lineage(dealt)
    sizes = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[k] for k in sorted(sizes))]).tolist(), strict=False))
    each, more = divmod(found["n"], shards)
    split = more * (each + 1)  # the first `more` shards have one row more

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(4)[0].as_py()  # a task has one partition
            at = before[part] + seen.get(part, 0) + np.arange(batch.num_rows)
            seen[part] = seen.get(part, 0) + batch.num_rows
            large = at < split
            shard = np.where(large, at // (each + 1), more + (at - split) // max(each, 1))
            slot = np.where(large, at % (each + 1), (at - split) % max(each, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shard.astype(np.int32)), pa.array(slot)], ["id", "size", "text_crc32", "hilbert", "shard", "slot"])

    out = map_arrow(dealt.select("id", "size", "text_crc32", "hilbert", "part"), numbered, "id long, size long, text_crc32 long, hilbert long, shard int, slot long")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, dimensions: list[str], shards: int = SHARDS, text_col: str = "text") -> None:
    """docs as one folder of Parquet per shard; a shard's rows lie together on the curve, so filters on the dimensions skip files.

    Each row meets its own shard, whatever its id: rows are numbered first, and the
    numbers written with them. A column of docs that is called shard is written as
    shard_.
    """
    number, curve = "row number", "place on the curve"
    docs = docs.withColumnRenamed("shard", "shard_") if "shard" in docs.columns else docs
    docs = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()))
    # The number stands in for the id, which decides between rows that are otherwise equal.
    placed = hilbert_shards(docs, ["shard_" if c == "shard" else c for c in dimensions], shards, number, text_col)
    placed = placed.select(F.col(number).alias("placed"), "shard", F.col("hilbert").alias(curve))
    joined = docs.join(placed, docs[number] == placed["placed"]).drop("placed", number)
    ordered = joined.repartitionByRange(shards, "shard").sortWithinPartitions("shard", curve).drop(curve)
    ordered.write.partitionBy("shard").parquet(path)
