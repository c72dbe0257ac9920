"""Time-ordered split assignment, split views and id-set checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partflow.functions.columns import least_of
from partflow.operators.ranking import exact_quantiles
from partflow.sources.catalog import ID, measurements_of

SPLITS = ("train", "validation", "holdout")


class SplitError(ValueError):
    """The configuration or the resulting assignment is invalid."""


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.6
    validation: float = 0.2
    holdout: float = 0.2

    def __post_init__(self) -> None:
        if abs(self.train + self.validation + self.holdout - 1.0) > 1e-9:
            raise SplitError("split fractions must sum to 1")


def start_times(dates: DataFrame) -> DataFrame:
    """(Id, min_ts): first time over all date columns, null for a part without any."""
    return dates.select(ID, least_of(measurements_of(dates.columns)).alias("min_ts"))


def time_cuts(parts: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """One row: the discrete quantiles of non-null start times that end train and validation."""
    return exact_quantiles(parts, "min_ts", {"cut_train": config.train,
                                             "cut_validation": config.train + config.validation})


def assign_splits(parts: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """(Id, min_ts, split). Parts sharing a time share a split; parts without time go to train.

    The two cuts reach the rows as scalar subqueries: no join and no driver round trip.
    """
    cuts = time_cuts(parts, config)
    train_end = cuts.select("cut_train").scalar()
    validation_end = cuts.select("cut_validation").scalar()
    split = (F.when(F.col("min_ts").isNull() | (F.col("min_ts") <= train_end), "train")
             .when(F.col("min_ts") <= validation_end, "validation").otherwise("holdout"))
    return parts.select(ID, "min_ts", split.alias("split"))


def split_report(assigned: DataFrame) -> DataFrame:
    """Parts and undated parts per split, zero-filled; an empty split has verdict 'empty'."""
    names = assigned.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    counted = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("parts"),
                                            F.count_if(F.col("min_ts").isNull()).alias("undated"))
    return (names.join(counted, "split", "left")
            .select("split", F.coalesce("parts", F.lit(0)).alias("parts"),
                    F.coalesce("undated", F.lit(0)).alias("undated"))
            .withColumn("verdict", F.when(F.col("parts") == 0, "empty").otherwise("ok")))


def require_no_empty_split(report: DataFrame) -> None:
    empty = [r.split for r in report.where(F.col("verdict") == "empty").collect()]
    if empty:
        raise SplitError(f"empty split: {empty}")


def in_split(splits: DataFrame, name: str) -> DataFrame:
    return splits.where(F.col("split") == name)


def split_view(table: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    """Rows of one split. A semi join on Id that never broadcasts: the id list grows with the data, and its file is far
    smaller than its rows."""
    return table.join(in_split(splits, name).select(ID).hint("merge"), ID, "left_semi")


def shared_bitmaps(ids: DataFrame, reference: DataFrame) -> DataFrame:
    """(bucket, bits): bitmaps of the Ids on both sides, a row for each run of 32,768 Ids that holds one.

    Both sides are folded into a bitmap a bucket before they shuffle, so what moves is a row a bucket and task however often
    an Id repeats. Null Ids are on neither side.
    """
    sides = ids.select(F.col(ID), F.lit(True).alias("__one")).unionByName(reference.select(F.col(ID), F.lit(False).alias("__one")))
    place = F.bitmap_bit_position(ID)
    both = sides.where(F.col(ID).isNotNull()).groupBy(F.bitmap_bucket_number(ID).alias("bucket")).agg(
        F.bitmap_construct_agg(F.when(F.col("__one"), place)).alias("a"), F.bitmap_construct_agg(F.when(~F.col("__one"), place)).alias("b"))
    pair = both.select("bucket", F.explode(F.array("a", "b")).alias("bits"))  # still dealt by bucket: no further shuffle
    return pair.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits")).where(F.bitmap_count("bits") > 0)


def bitmap_ids(bitmaps: DataFrame) -> DataFrame:
    """The Ids that bitmaps (bucket, bits) hold."""
    byte = F.expr("explode(filter(sequence(0, 4095), i -> substring(bits, i + 1, 1) <> X'00')) AS at")
    held = bitmaps.select("bucket", "bits", byte).select("bucket", "at", F.expr("CAST(conv(hex(substring(bits, at + 1, 1)), 16, 10) AS INT)").alias("byte"))
    place = held.select("bucket", F.explode(F.expr("transform(filter(sequence(0, 7), i -> shiftright(byte, i) % 2 = 1), i -> at * 8 + i)")).alias("place"))
    size = F.lit(32768).cast("long")
    return place.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * size + F.col("place") + 1).otherwise(F.col("bucket") * size - F.col("place")).alias(ID))


def intersect_ids(ids: DataFrame, reference: DataFrame) -> DataFrame:
    """Distinct Ids present on both sides."""
    return bitmap_ids(shared_bitmaps(ids, reference))


def _shared_count(ids: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    return shared_bitmaps(ids, reference).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0).cast("long")).alias(name))


def holdout_audit(ids: DataFrame, splits: DataFrame) -> DataFrame:
    """How many of the evaluated Ids belong to the holdout; anything but 0 is a breach."""
    return _shared_count(ids, in_split(splits, "holdout"), "holdout_ids_referenced")


def disjoint(exposed: DataFrame, holdout: DataFrame) -> DataFrame:
    """One row: size of the overlap of two id sets and whether they are disjoint."""
    return _shared_count(exposed, holdout, "overlap").withColumn("disjoint", F.col("overlap") == 0)


def point_lookup(df: DataFrame, part_id: int) -> DataFrame:
    """One part's row; the equality reaches the Parquet scan as a pushed filter."""
    return df.where(F.col(ID) == F.lit(part_id))


def by_id(df: DataFrame) -> DataFrame:
    return df.orderBy(ID)


def by_split(splits: DataFrame) -> DataFrame:
    return splits.orderBy("split", ID)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """A page of at most n rows (1 to 1000), the feature of the exploration and queue pages."""
    if not 1 <= n <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    return df.limit(n)
