"""Global order without a single task: row numbers, running totals and exact quantiles.

A window without PARTITION BY pulls every row into one task, and a window partitioned by a hot key pulls a
third of them. Here rows are range-partitioned on the full ordering (ties broken by the caller's keys, so a
hot value spreads over many ranges), the placement is fixed by a reliable checkpoint, and each range receives
the total of the ranges before it. Only one row per range is ever gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partflow.session import materialized

_BLOCK, _SEQ = "__block", "__seq"
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's position in its partition in the low 33 bits


def _placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    # without a fixed number AQE merges neighbouring ranges of a small table; their order stays, ids are given after
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialized(ranged.withColumn(_SEQ, F.monotonically_increasing_id())
                        .withColumn(_BLOCK, F.shiftright(F.col(_SEQ), _LOCAL_BITS).cast("int")))


def row_numbers(df: DataFrame, order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """1-based position of each row in the global order. One range shuffle, no window over the data."""
    placed = _placed(df, order)
    earlier = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("__n"))
               .select(_BLOCK, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")))
    position = F.col(_SEQ).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # offsets holds one row per range, so its size is bounded by spark.sql.shuffle.partitions
    return (placed.join(F.broadcast(offsets), _BLOCK)
            .withColumn(name, position + F.col("__before") + 1)
            .drop(_BLOCK, _SEQ, "__before"))


def running_totals(df: DataFrame, order: Sequence[Column | str], totals: Mapping[str, str],
                   row_number: str | None = None) -> DataFrame:
    """Inclusive running sums along the global order: totals maps new column -> summed column."""
    placed = _placed(df, order)
    earlier = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("__n"),
                                      *[F.sum(c).alias(f"__t_{n}") for n, c in totals.items()])
    offsets = sums.select(_BLOCK, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
                          *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in totals])
    within = Window.partitionBy(_BLOCK).orderBy(_SEQ).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(within).alias(n) for n, c in totals.items()])
    out = local.join(F.broadcast(offsets), _BLOCK)
    for n in totals:
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(0)) + F.col(f"__o_{n}"))
    if row_number is not None:
        position = F.col(_SEQ).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
        out = out.withColumn(row_number, position + F.col("__before") + 1)
    return out.drop(_BLOCK, _SEQ, "__before", *[f"__o_{n}" for n in totals])


def discrete_position(total: Column, q: float) -> Column:
    """1-based position of the discrete q-quantile among `total` sorted values."""
    n = total.cast("double")
    return F.greatest(F.lit(1.0), n - F.floor(n - n * F.lit(float(q))))


def exact_quantiles(df: DataFrame, value: str, quantiles: Mapping[str, float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Exact discrete quantiles, one output column per entry of `quantiles`, one row per group of `by`.

    Equal values are counted first, so the ranked rows are distinct values, and no group is held in one
    aggregation buffer the way percentile_disc holds it.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_totals(counts, [*by, value], {"__cum": "__c"})
    spans = ranked.groupBy(*by).agg(F.sum("__c").alias("__total"),
                                    F.min(F.col("__cum") - F.col("__c")).alias("__base"))
    if by:
        joined = ranked.join(spans, by)
    else:
        joined = (ranked.withColumn("__total", spans.select("__total").scalar()).withColumn("__base", F.lit(0)))
    picks = [F.min(F.when(F.col("__cum") - F.col("__base") >= discrete_position(F.col("__total"), q),
                          F.col(value))).alias(name) for name, q in quantiles.items()]
    return joined.groupBy(*by).agg(*picks)
