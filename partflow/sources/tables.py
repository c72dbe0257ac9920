"""Small result tables: scores, split assignments, the cost curve, the policy and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partflow.functions.scoring import hash_number

SCORE_COLUMNS = ("id", "y", "p")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, y byte, p double").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.select(F.col("id").cast("long"), F.col("y").cast("byte"), F.col("p").cast("double")) \
        .write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_splits(splits: DataFrame, path: str) -> None:
    """Globally ordered by (split, Id) over many files: ranges on both keys, so a large split spreads out."""
    (splits.select("Id", "split").repartitionByRange("split", "Id").sortWithinPartitions("split", "Id")
     .write.mode("errorifexists").parquet(path))


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest: row count, xor and a bounded sum of per-row digests.

    Map-side partial sums only, so neither row order nor partitioning changes the result and no rows are gathered.
    """
    h = hash_number(*[F.col(c) for c in columns])
    total = F.sum(F.pmod(h, F.lit(1 << 31)))
    aggs = [F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"), total.alias("sum_hash")]
    out = df.groupBy(*by).agg(*aggs)
    return out.withColumn("digest", F.sha2(F.concat_ws("|", "rows", "xor_hash", "sum_hash"), 256))


def split_fingerprint(splits: DataFrame, name: str) -> DataFrame:
    """Digest and size of one split's Ids: the sealed value that proves a split did not change."""
    return fingerprint(splits.where(F.col("split") == name), ["Id"]).withColumn("split", F.lit(name))


def curve_lines(curve: DataFrame) -> DataFrame:
    """The cost curve with the fixed decimals of the published file."""
    return curve.select(
        F.format_string("%.3f", "threshold").alias("threshold"),
        F.format_string("%.2f", "dollars_per_shift").alias("dollars_per_shift"),
        *[F.col(c).cast("string").alias(c) for c in ("tp", "fp", "tn", "fn")])


def write_curve_csv(curve: DataFrame, path: str) -> None:
    """One sorted CSV file: the curve has one row per threshold, a fixed 1,001 by default."""
    curve_lines(curve.coalesce(1).sortWithinPartitions("threshold")).write.mode("errorifexists") \
        .option("header", True).csv(path)


def write_policy_json(policy: DataFrame, path: str) -> None:
    """The policy is one row."""
    policy.coalesce(1).write.mode("errorifexists").json(path)
