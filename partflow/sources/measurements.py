"""Measurement tables on disk: typed CSV scan, Parquet sink, file audits and row reconciliation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partflow.sources.catalog import ID, table_schema

# Rows per Parquet file piece; text columns are wide, so their pieces are shorter.
ROWS_PER_GROUP = {"numeric": 50_000, "date": 50_000, "categorical": 10_000}
WHOLE_BYTES = 64 << 20  # files up to this size are read as one row
PACKED = r"\.(gz|bz2|zst|zstd|snappy|lz4|deflate)$"  # endings of files that a text reader unpacks
MANIFEST_SCHEMA = "name string, sha256 string"


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """First line only: a limit(1) text scan stops after one partition."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return first[0][0].strip().split(",")


def read_measurements(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Typed CSV scan. Types follow the column names; nothing is inferred and a bad value fails the job."""
    schema = table_schema(csv_header(spark, path), kind)
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").option("nullValue", "").csv(path))


def write_measurements(df: DataFrame, path: str, kind: str, block_bytes: int = 32 << 20) -> None:
    """zstd Parquet with bounded row groups: Spark bounds groups by bytes and files by rows."""
    (df.write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", block_bytes)
     .option("maxRecordsPerFile", ROWS_PER_GROUP[kind] * 20).parquet(path))


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """Bucketed and sorted by part, so the per-part joins of the three kinds need no shuffle."""
    (df.repartition(buckets, ID).write.mode("errorifexists").option("path", path).option("compression", "zstd")
     .bucketBy(buckets, ID).sortBy(ID).format("parquet").saveAsTable(table))


def write_by_split(df: DataFrame, splits: DataFrame, path: str) -> None:
    """One folder per split. Rows spread over tasks by part first, so a large split is written by many of them."""
    (df.join(splits.select(ID, "split"), ID).write.mode("errorifexists").option("compression", "zstd")
     .partitionBy("split").parquet(path))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A split of a table written by write_by_split: partition pruning instead of a semi join."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def reconcile_rows(spark: SparkSession, csv_path: str, parquet_path: str) -> DataFrame:
    """Independent line count of the CSV against the row count of the Parquet copy.

    The text reader counts a last line with or without a final newline alike. Each CSV file has one header.
    """
    lines = spark.read.text(csv_path).groupBy(F.input_file_name().alias("f")).agg((F.count(F.lit(1)) - 1).alias("n"))
    csv_rows = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    parquet_rows = spark.read.parquet(parquet_path).agg(F.count(F.lit(1)).alias("n"))
    one = spark.range(1).select(csv_rows.scalar().alias("csv_rows"), parquet_rows.scalar().alias("parquet_rows"))
    return one.withColumn("matches", F.col("csv_rows") == F.col("parquet_rows"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files whose lines arrive in order, one file after the other. The last line has its line feed or not, as the
    size of the file says."""
    now, size, seen, digest = None, 0, 0, hashlib.sha256()

    def ended() -> pa.RecordBatch:
        if seen == size - 1:
            digest.update(b"\n")
        elif seen != size:
            raise ValueError(f"{now}: {seen} bytes were read of {size}")
        return pa.record_batch([pa.array([now]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "length", "sha256"])

    for batch in batches:
        paths = batch.column("path").dictionary_encode()
        lines, at = batch.column("line").to_pylist(), 0
        ends = [*(np.flatnonzero(np.diff(paths.indices.to_numpy())) + 1).tolist(), len(lines)] if lines else []
        for end in ends:
            path = paths.dictionary[paths.indices[at].as_py()].as_py()
            if path != now:
                if now is not None:
                    yield ended()
                now, size, seen, digest = path, batch.column("size")[at].as_py(), 0, hashlib.sha256()
                piece = b"\n".join(lines[at:end])
            else:
                piece = b"\n" + b"\n".join(lines[at:end])
            digest.update(piece)
            seen, at = seen + len(piece), end
    if now is not None:
        yield ended()


def _digests(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length, sha256) of every file. The binary reader takes a file whole, so larger ones are read as lines, by as many
    tasks as they have blocks, and hashed as a stream in order. Of what a text reader would unpack only files below 2 GB can
    be read."""
    options = {"recursiveFileLookup": True, "pathGlobFilter": glob}
    files = spark.read.format("binaryFile").options(**options).load(path)
    digest = ("path", "length", F.sha2("content", 256).alias("sha256"))
    found = files.where(F.col("length") <= WHOLE_BYTES).select(*digest)  # asks for no content of a larger file
    packed = files.where((F.col("length") > WHOLE_BYTES) & F.col("path").rlike(PACKED)).select("path").collect()  # a name a large file
    if packed:
        found = found.unionByName(spark.read.format("binaryFile").load([r.path for r in packed]).select(*digest))
    meta = F.col("_metadata")
    large = (meta["file_size"] > WHOLE_BYTES) & ~meta["file_path"].rlike(PACKED)
    lines = spark.read.options(**options).option("lineSep", "\n").text(path).where(large).select(
        F.url_decode(F.replace(meta["file_path"], F.lit("+"), F.lit("%2B"))).alias("path"), meta["file_size"].alias("size"),
        meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))
    ordered = lines.repartition("path").sortWithinPartitions(F.xxhash64("path"), "path", "start", "place").select("path", "size", "line")
    return found.unionByName(ordered.mapInArrow(_hashed, "path string, length long, sha256 string"))


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 per file."""
    return _digests(spark, path, glob).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "sha256")


def table_digests(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(name, bytes, sha256) per entry of a folder that matches: a file, or a table that is a folder of files.

    A file has its own digest. A folder has that of its files' paths and digests in order, one short line a file, so the
    name of a table stays the same when it is written as several files.
    """
    files = _digests(spark, f"{path.rstrip('/')}/{glob}", "*.parquet")
    entry = f"^.*/{re.escape(path.rstrip('/').split('/')[-1])}/([^/]+)(/.*)?$"
    name, rest = F.regexp_extract("path", entry, 1), F.regexp_extract("path", entry, 2)
    one = files.select(name.alias("name"), rest.alias("inside"), F.col("length").alias("bytes"), "sha256")
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "inside", "sha256")))
    grouped = one.groupBy("name").agg(F.sum("bytes").alias("bytes"), F.max("inside").alias("inside"), F.first("sha256").alias("own"), lines.alias("lines"))
    return grouped.select("name", "bytes", F.when(F.col("inside") == "", F.col("own")).otherwise(F.sha2(F.array_join("lines", "\n"), 256)).alias("sha256"))


def audit_files(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file and every manifest entry with a verdict: ok, mismatch, missing or unlisted."""
    actual = digests.select("name", F.col("sha256").alias("actual"))
    listed = manifest.select("name", F.col("sha256").alias("listed"))
    verdict = (F.when(F.col("listed").isNull(), "unlisted").when(F.col("actual").isNull(), "missing")
               .when(F.col("actual") == F.col("listed"), "ok").otherwise("mismatch"))
    return actual.join(listed, "name", "full_outer").select("name", "actual", "listed", verdict.alias("verdict"))


def stale_inputs(inventory: DataFrame, log: DataFrame, converted: DataFrame) -> DataFrame:
    """Files that still need conversion.

    A file is current when its digest is the logged one and its Parquet copy still has the logged row count.
    inventory(name, sha256), log(name, sha256, rows), converted(name, rows).
    """
    valid = log.join(converted, ["name", "rows"], "left_semi")
    return inventory.join(valid, ["name", "sha256"], "left_anti")


def append_conversion_log(entries: DataFrame, path: str) -> None:
    entries.select("name", "sha256", "rows").write.mode("append").parquet(path)
