"""Evidence tables for the review queue, built for the whole queue at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partflow.operators.cost import parts_in_band
from partflow.operators.ranking import exact_quantiles
from partflow.sources.catalog import ID


def normal_ranges(long: DataFrame, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """(name, low, high): 1st and 99th percentile of each numeric column; columns without data have no row.

    The default keeps one mergeable sketch per column. The exact form ranks distinct values instead.
    """
    if exact:
        return exact_quantiles(long, "value", {"low": 0.01, "high": 0.99}, by=["name"])
    ends = F.percentile_approx("value", F.array(F.lit(0.01), F.lit(0.99)), accuracy)
    return (long.where(F.col("value").isNotNull()).groupBy("name").agg(ends.alias("e"))
            .select("name", F.col("e")[0].alias("low"), F.col("e")[1].alias("high")))


SKETCH_K = 2000  # a sketch keeps some thousands of values; its ranks are off by 0.2 % of all at most, nearly always


def range_sketches(long: DataFrame, day: str = "day", k: int = SKETCH_K) -> DataFrame:
    """(day, name, sketch, n): a mergeable quantile sketch a day and column; long(day, name, value). To be stored by day: a
    new day is sketched from its own readings alone and appended."""
    kept = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.groupBy(day, "name").agg(F.kll_sketch_agg_double("value", k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def append_sketches(sketches: DataFrame, path: str, day: str = "day") -> None:
    sketches.write.mode("append").partitionBy(day).parquet(path)


def sketched_ranges(sketches: DataFrame, k: int = SKETCH_K, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(name, low, high) of the readings of all days given, from their sketches; no reading is read again."""
    merged = sketches.groupBy("name").agg(F.kll_merge_agg_double("sketch", k).alias("s"))
    return merged.select("name", *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(c) for c, q in (("low", low), ("high", high))])


def rank_errors(long: DataFrame, ranges: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(name, low_error, high_error): how far, as a share of all readings, the ends of ranges lie from their ranks."""
    kept = long.where(F.col("value").isNotNull()).join(F.broadcast(ranges), "name")  # a row a column of the schema

    def error(end: str, q: float) -> Column:
        under, upto = F.avg((F.col("value") < F.col(end)).cast("double")), F.avg((F.col("value") <= F.col(end)).cast("double"))
        return F.greatest(under - q, q - upto, F.lit(0.0))

    return kept.groupBy("name").agg(error("low", low).alias("low_error"), error("high", high).alias("high_error"))


def out_of_range(long: DataFrame, ranges: DataFrame) -> DataFrame:
    """Readings outside the inclusive range of their column. ranges has one row per column of the schema."""
    return (long.join(F.broadcast(ranges), "name")
            .where(~F.col("value").between(F.col("low"), F.col("high"))))


def queue_order(queue: DataFrame) -> DataFrame:
    """Highest score first, ties by id."""
    return queue.orderBy(F.col("p").desc(), F.col("id").asc())


def band_parts(scores: DataFrame, policy: DataFrame) -> DataFrame:
    """(part_id, score) of the parts in the policy's band, in no order: what joins with the queue need."""
    return parts_in_band(scores, policy).select(F.col("id").alias("part_id"), F.col("p").alias("score"))


def review_queue(scores: DataFrame, policy: DataFrame) -> DataFrame:
    """The parts in the policy's band as a reviewer reads them."""
    return queue_order(parts_in_band(scores, policy)).select(F.col("id").alias("part_id"), F.col("p").alias("score"))


def undecided(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue rows without a decision; the anti join tolerates any number of decisions per part."""
    return queue.join(decisions.select("part_id"), "part_id", "left_anti")


def open_queue(queue: DataFrame, decisions: DataFrame, dispositions: DataFrame, limit: int = 100) -> DataFrame:
    """The first page of open parts with a has_disposition flag and the totals of the whole queue."""
    open_parts = undecided(queue, decisions)
    total = open_parts.agg(F.count(F.lit(1)).alias("n")).scalar()
    decided = decisions.select("part_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    page = open_parts.orderBy(F.col("score").desc(), "part_id").limit(limit)
    written = dispositions.select("part_id").distinct().withColumn("has_disposition", F.lit(True))
    return (page.join(written, "part_id", "left")
            .select("part_id", "score", F.coalesce("has_disposition", F.lit(False)).alias("has_disposition"),
                    total.alias("total"), decided.alias("decided")))


def queue_membership(parts: DataFrame, queue: DataFrame) -> DataFrame:
    """Requested parts that are not in the queue, holdout parts included, with the reason."""
    return (parts.select("part_id").join(queue.select("part_id"), "part_id", "left_anti")
            .withColumn("error", F.lit("not in the review queue")))


def part_evidence(queue: DataFrame, numeric_long: DataFrame, dates_long: DataFrame, routes: DataFrame,
                  ranges: DataFrame, policy: DataFrame) -> DataFrame:
    """One record per queued part: route, readings present, out-of-range readings, columns, band.

    Long readings are cut to the queue by a semi join before anything is grouped; a part collects at most one
    entry per column of the schema.
    """
    ids = queue.select(F.col("part_id").alias(ID))
    bounds = F.broadcast(ranges)  # one row per column of the schema
    entry = F.struct("name", F.round("value", 6).alias("value"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
    outside = F.col("low").isNotNull() & ~F.col("value").between(F.col("low"), F.col("high"))
    numeric = (numeric_long.join(ids, ID, "left_semi").join(bounds, "name", "left").groupBy(ID)
               .agg(F.count(F.lit(1)).alias("measurements_present"),
                    F.array_sort(F.collect_list(F.when(outside, entry))).alias("out_of_range"),
                    F.array_sort(F.collect_list("name")).alias("numeric_columns")))
    dates = (dates_long.join(ids, ID, "left_semi").groupBy(ID)
             .agg(F.array_sort(F.collect_list("name")).alias("date_columns")))
    none = F.array().cast("array<string>")
    joined = (queue.withColumnRenamed("part_id", ID).join(routes.select(ID, "route"), ID, "left")
              .join(numeric, ID, "left").join(dates, ID, "left"))
    return joined.select(
        F.col(ID).alias("part_id"), "score", "route", F.coalesce("measurements_present", F.lit(0)).alias("measurements_present"),
        F.coalesce("out_of_range", F.array().cast("array<struct<name:string,value:double,low:double,high:double>>")).alias("out_of_range"),
        F.concat(F.coalesce("numeric_columns", none), F.coalesce("date_columns", none)).alias("columns"),
        F.array(policy.select("band_low").scalar(), policy.select("band_high").scalar()).alias("policy_band"))


def top_gain(gains: DataFrame, n: int = 25, exclude: Sequence[str] = ()) -> DataFrame:
    """The n features of highest summed gain; ties by name. gains has one row per feature."""
    return gains.where(~F.col("feature").isin(*exclude) if exclude else F.lit(True)) \
        .orderBy(F.col("gain").desc(), "feature").limit(n)
