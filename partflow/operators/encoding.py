"""Column coverage, selection of categorical columns, frequency codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partflow.operators.ranking import row_numbers
from partflow.sources.catalog import measurements_long, measurements_of

MIN_COUNT = 50


def column_coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(name, present, share): non-null count of every column, from a single aggregate row."""
    columns = list(columns or measurements_of(df.columns))
    counted = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("present")) for c in columns])
    return (counted.select("__rows", F.explode(entries).alias("e"))
            .select("e.name", "e.present",
                    F.try_divide(F.col("e.present").cast("double"), F.col("__rows")).alias("share")))


MIN_SHARE = 0.0001  # fixed value: train parts with a value, as a share of all, that a categorical column needs


def count_of_share(train: DataFrame, share: float = MIN_SHARE) -> Column:
    """The whole number of rows that a share of a table stands for, at least one; a scalar subquery."""
    return train.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(float(share)))).alias("n")).scalar()


def select_categorical(train: DataFrame, min_count: int | Column, min_distinct: int = 2) -> DataFrame:
    """(name, present): categorical columns worth coding, from train only. min_count may be that of a share.

    Coverage first. Two distinct values need only min <> max in the same aggregate row; more than two use a
    grouped count of (column, value) pairs, which combines map-side, never many COUNT DISTINCTs in one row.
    """
    columns = measurements_of(train.columns)
    if min_distinct <= 2:
        row = train.agg(*[F.struct(F.count(F.col(c)).alias("present"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                          for c in columns])
        entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}.present").alias("present"),
                                     F.when(F.col(f"{c}.lo") != F.col(f"{c}.hi"), 2)
                                     .when(F.col(f"{c}.lo").isNotNull(), 1).otherwise(0).alias("distinct"))
                            for c in columns])
        found = row.select(F.explode(entries).alias("e")).select("e.name", "e.present", "e.distinct")
    else:
        pairs = measurements_long(train, "categorical").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        found = pairs.groupBy("name").agg(F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct"))
    return found.where((F.col("present") >= min_count) & (F.col("distinct") >= min_distinct)).select("name", "present")


def value_frequency(train: DataFrame, column: str) -> DataFrame:
    """Count per value; the partial aggregation keeps a hot value down to one row per task."""
    return train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def rank_codes(frequency: DataFrame, column: str, code: str) -> DataFrame:
    """Codes from 1 by falling count, then value. The values may be many, so the ranking is distributed."""
    return row_numbers(frequency, [F.col("n").desc(), F.col(column).asc()], code)


def fit_codes(train: DataFrame, column: str, min_count: int = MIN_COUNT, code: str | None = None) -> DataFrame:
    frequent = value_frequency(train, column).where(F.col("n") >= min_count)
    return rank_codes(frequent, column, code or f"{column}_code")


def apply_codes(df: DataFrame, codes: DataFrame, column: str, code: str | None = None) -> DataFrame:
    """Left join with 0 for unknown, rare or null values. No hint: the planner broadcasts codes when small."""
    code = code or f"{column}_code"
    return (df.join(codes.select(column, code), column, "left")
            .withColumn(code, F.coalesce(F.col(code), F.lit(0))))


def encode(train: DataFrame, others: Sequence[DataFrame], min_count: int = MIN_COUNT) -> tuple[DataFrame, list[DataFrame]]:
    """Feature columns sorted by name; strings become train-fitted codes, numbers become float."""
    names = sorted(c for c in train.columns if c != "Id")
    types = dict(train.dtypes)
    frames = [train, *others]
    for name in names:
        if types[name] == "string":
            codes = fit_codes(train, name, min_count, "__code")
            frames = [apply_codes(f, codes, name, "__code").drop(name).withColumnRenamed("__code", name) for f in frames]
    out = [f.select("Id", *[F.col(n).cast("float").alias(n) for n in names]) for f in frames]
    return out[0], out[1:]


