"""Writing and keeping tables, and checks of their content."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrid.functions.timeconv import trade_date
from tapegrid.sources.landing import file_year

PRICES = ("open", "high", "low", "close")


def write_minute(bars: DataFrame, path: str, files_per_year: int = 8, keys: tuple[str, ...] = ("year",)) -> None:
    """Replaces the years that bars has, whole: a symbol that is no longer in the input goes.

    `year` is the only folder level, next to kind where keys has it; symbols are
    dealt to files_per_year files by hash and sorted, so that min and max of row
    groups prune scans of a few symbols.
    """
    rows = bars if "year" in bars.columns else bars.withColumn("year", F.year("ts"))
    dealt = rows.repartition(*keys, F.pmod(F.xxhash64("symbol"), F.lit(files_per_year))).sortWithinPartitions(*keys, "symbol", "ts")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def write_whole(rows: DataFrame, path: str, sort: str | list = "symbol", files: int | None = None) -> None:
    """Replaces a table; rows are in the order of one or more columns, within files and from file to file."""
    by = sort if isinstance(sort, list) else [sort]
    dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def compact(spark: SparkSession, path: str, year: int, files: int = 1) -> None:
    """Writes a year's rows anew into few files, in the table's own folder levels; Spark's committer exchanges them at the end.

    The rows are read from the folder that is replaced, so they are written to the
    checkpoint folder (spark.checkpoint.dir) first.
    """
    rows = spark.read.parquet(path).where(F.col("year") == year)
    one = rows.select("_metadata.file_path").first()
    if one is None:
        return
    keys = [k for k in re.findall(r"/([^/=]+)=[^/]*(?=/)", one["file_path"]) if k in rows.columns]
    write_minute(rows.checkpoint(), path, files, tuple(keys))


def input_manifest(rows: DataFrame) -> DataFrame:
    """file_name, file_size, year, n_rows of the files that rows were read from."""
    if "year" not in rows.columns:
        rows = rows.withColumn("year", F.year("ts"))
    named = rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"), "year")
    return named.groupBy("file_name", "file_size", "year").agg(F.count("*").alias("n_rows"))


def file_manifest(listing: DataFrame) -> DataFrame:
    """file_name, file_size, year of landed files that have a year in their path; from the listing alone."""
    return listing.select("file_name", "file_size", file_year(F.col("file_path")).alias("year")).where("year IS NOT NULL")


def stale_years(manifest: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """Years, or other parts by their keys, with a file that is new, changed in size, or gone since `done`."""
    key = ["file_name", "file_size", *keys]
    return manifest.join(done, key, "left_anti").select(*keys).unionByName(done.join(manifest, key, "left_anti").select(*keys)).distinct()


def stored_manifest(spark: SparkSession, path: str, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """The manifest of the last builds: file_name, file_size, build and the keys; no rows before the first."""
    types = {"year": "int"}
    fields = ", ".join(["file_name string", "file_size long", "build int", *(f"{k} {types.get(k, 'string')}" for k in keys)])
    try:
        return spark.read.schema(fields).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)


def store_manifest(manifest: DataFrame, path: str, build: int, keys: tuple[str, ...] = ("year",)) -> None:
    """Replaces the manifest of the parts that have just been built. It is written after their data: a build that fails is done again."""
    manifest.withColumn("build", F.lit(build)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_daily(rows: DataFrame, path: str, keys: tuple[str, ...] = ("year",), files_per_year: int = 1) -> None:
    """Replaces the daily rows of the years that rows has, whole, sorted by symbol."""
    dealt = rows.repartition(*keys, F.pmod(F.xxhash64("symbol"), F.lit(files_per_year))).sortWithinPartitions(*keys, "symbol", "trade_date")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only on a single machine where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def content_fingerprint(bars: DataFrame, columns: tuple[str, ...] = (*PRICES, "volume"), by: tuple[str, ...] = ()) -> DataFrame:
    """symbol, trade_date, n_bars, digest: equal digests mean equal bars, in whatever order they are stored. by: further columns to tell days apart by, such as year."""
    rows = bars if "trade_date" in bars.columns else bars.withColumn("trade_date", trade_date(F.col("ts")))
    # A day has 1440 minutes, so a group's list is short.
    row = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *[F.coalesce(F.col(c).cast("double").cast("string"), F.lit("null")) for c in columns])
    return rows.groupBy("symbol", "trade_date", *by).agg(F.count("*").alias("n_bars"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\n"), 256).alias("digest"))


def change_of(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol, trade_date, old_bars, new_bars, change of the days whose fingerprints differ."""
    a = old.select("symbol", "trade_date", F.col("n_bars").alias("old_bars"), F.col("digest").alias("old_digest"))
    b = new.select("symbol", "trade_date", F.col("n_bars").alias("new_bars"), F.col("digest").alias("new_digest"))
    change = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").when(F.col("old_digest") != F.col("new_digest"), "restated")
    joined = a.join(b, ["symbol", "trade_date"], "full_outer").withColumn("change", change)
    return joined.where("change IS NOT NULL").select("symbol", "trade_date", "old_bars", "new_bars", "change")


def detect_restatements(old: DataFrame, new: DataFrame) -> DataFrame:
    """change_of() two states of a table at hand; snapshots.restatements compares stored versions."""
    return change_of(content_fingerprint(old), content_fingerprint(new))


def reconcile_bars(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """symbol, ts, only_in ('a', 'b' or ''), and diff_{field}: where two sources differ, field by field."""
    fields = [*PRICES, "volume"]
    left = a.select("symbol", "ts", F.lit(True).alias("in_a"), *[F.col(c).cast("double").alias(f"a_{c}") for c in fields])
    right = b.select("symbol", "ts", F.lit(True).alias("in_b"), *[F.col(c).cast("double").alias(f"b_{c}") for c in fields])
    joined = left.join(right, ["symbol", "ts"], "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()

    def differs(c: str):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return both & ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())

    marked = joined.select("symbol", "ts", F.when(F.col("in_b").isNull(), "a").when(F.col("in_a").isNull(), "b").otherwise("").alias("only_in"), *[differs(c).alias(f"diff_{c}") for c in fields])
    bad = F.col("only_in") != ""
    for c in fields:
        bad = bad | F.col(f"diff_{c}")
    return marked.where(bad)


def profile_table(rows: DataFrame, name: str) -> DataFrame:
    """table_name, column_name, n_rows, n_null for each column, from one pass."""
    counts = rows.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(rows.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{k}").alias("n_null")) for k, c in enumerate(rows.columns)])
    return counts.select("n_rows", F.explode(pairs).alias("c")).select(F.lit(name).alias("table_name"), "c.column_name", "n_rows", "c.n_null")


#: Spark's types by the kind of profile that they get.
_KINDS = {"string": "text", "boolean": "flag", "date": "time", "timestamp": "time", "timestamp_ntz": "time", "tinyint": "whole", "smallint": "whole", "int": "whole", "bigint": "whole", "float": "number", "double": "number"}


def column_profile(rows: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """A row for each column of a table, from one pass: table_name, column_name, kind, n_rows, n_null, range and sample.

    kind: text, flag, time, whole, number, or other (lists, decimals and the like).
    min_number, max_number (of whole and number; flags as 0 and 1), min_text,
    max_text, min_time, max_time, mean_length (of text and lists); sample_number,
    sample_text, sample_time: the value in the row whose key (by default the first
    column) has the least md5, so it is the same however the rows lie; of several
    such rows the least. Columns that don't apply to a kind are null. NaN counts as
    no value. An empty table has 0 rows and nulls.
    """
    key = rows.columns[0] if key is None else key
    aggregates, structs = [], []
    for k, (c, kind) in enumerate((c, _KINDS.get(t, "number" if t.startswith("decimal") else "other")) for c, t in rows.dtypes):
        col = F.col(f"`{c}`")
        value = F.when(F.isnan(col), None).otherwise(col).cast("double") if kind == "number" else col.cast("double") if kind in ("whole", "flag") else col.cast("string") if kind == "text" else col.cast("timestamp_ntz") if kind == "time" else None
        length = F.length(col) if kind == "text" else F.size(col) if rows.schema[c].dataType.typeName() in ("array", "map") else None
        aggregates.append(F.count_if(col.isNull()).alias(f"null{k}"))
        names = {"whole": "number", "flag": "number"}.get(kind, kind)
        if value is not None:
            sample = F.min(F.when(value.isNotNull(), F.struct(F.md5(F.col(f"`{key}`").cast("string")).alias("h"), value.alias("v"))))
            aggregates += [F.min(value).alias(f"min{k}"), F.max(value).alias(f"max{k}"), sample["v"].alias(f"sample{k}")]
        if length is not None:
            aggregates.append(F.avg(F.when(col.isNotNull(), length)).alias(f"length{k}"))
        fields = [F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.col(f"null{k}").alias("n_null")]
        for to, type_ in (("number", "double"), ("text", "string"), ("time", "timestamp_ntz")):
            fields += [(F.col(f"{what}{k}") if value is not None and names == to else F.lit(None)).cast(type_).alias(f"{what}_{to}") for what in ("min", "max", "sample")]
        fields.append((F.col(f"length{k}") if length is not None else F.lit(None)).cast("double").alias("mean_length"))
        structs.append(F.struct(*fields))
    counts = rows.agg(F.count("*").alias("n_rows"), *aggregates)
    return counts.select("n_rows", F.explode(F.array(*structs)).alias("c")).select(F.lit(name).alias("table_name"), "n_rows", "c.*")
