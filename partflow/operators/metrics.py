"""Threshold sweeps and ranking metrics over scores(id, y, p), optionally per group.

Every metric starts from counts that combine map-side, so a score shared by a third of all rows costs one row
per task. Windows run over at most one row per threshold; ranks over all rows use the distributed ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partflow.functions.draws import inverse_binomial, uniform
from partflow.functions.scoring import GRID, GRID_STEPS, mcc, threshold_bucket
from partflow.operators.ranking import running_totals

COUNTS = ("tp", "fp", "tn", "fn")
DRAW_TASKS = 64  # tasks that share the draws of a resampling


def score_counts(scores: DataFrame, thresholds: Sequence[float] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per threshold bucket: the only pass over the scores a sweep needs."""
    bucket = threshold_bucket(F.col("p"), thresholds).alias("bucket")
    positive = F.col("y") == 1
    return scores.groupBy(*by, bucket).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def sweep_from_counts(counts: DataFrame, thresholds: Sequence[float] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix and MCC at every threshold; a part is flagged when p >= threshold."""
    by, spark, last = list(by), counts.sparkSession, len(thresholds) - 1
    if by:
        every = counts.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bucket"))
    else:
        every = spark.range(last + 1).select(F.col("id").cast("int").alias("bucket"))
    zero = every.select(*by, "bucket", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    full = (counts.select(*by, "bucket", "pos", "neg").unionByName(zero)
            .groupBy(*by, "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    # one row per threshold and group from here on
    down = Window.partitionBy(*by).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    swept = full.select(*by, "bucket", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
                        F.sum("pos").over(whole).alias("all_pos"), F.sum("neg").over(whole).alias("all_neg"))
    if tuple(thresholds) == GRID:
        value = F.col("bucket").cast("double") / GRID_STEPS
    else:
        value = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("bucket") + 1)
    return (swept.where(F.col("bucket") >= 0)
            .select(*by, value.alias("threshold"), "tp", "fp", (F.col("all_neg") - F.col("fp")).alias("tn"),
                    (F.col("all_pos") - F.col("tp")).alias("fn"))
            .withColumn("mcc", mcc(*[F.col(c) for c in COUNTS])))


def confusion_sweep(scores: DataFrame, thresholds: Sequence[float] = GRID, by: Sequence[str] = ()) -> DataFrame:
    return sweep_from_counts(score_counts(scores, thresholds, by), thresholds, by)


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The lowest threshold of maximum MCC, with its row of the sweep."""
    row = F.struct("threshold", *COUNTS, "mcc")
    best = F.max_by(row, F.struct(F.col("mcc"), -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def confusion_at(sweep: DataFrame, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Sweep row nearest to a threshold; the lower one on ties."""
    target = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    row = F.struct("threshold", *COUNTS, "mcc")
    near = F.min_by(row, F.struct("__gap", "threshold"))
    return sweep.withColumn("__gap", F.abs(F.col("threshold") - target)).groupBy(*by).agg(near.alias("b")).select(*by, "b.*")


def counts_at(scores: DataFrame, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Exact confusion matrix at one threshold: a single partial aggregation."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    bad, flagged = F.col("bad"), F.col("flagged")
    marked = scores.select(*by, (F.col("y") == 1).alias("bad"), (F.col("p") >= t).alias("flagged"))
    return marked.groupBy(*by).agg(F.count_if(bad & flagged).alias("tp"), F.count_if(~bad & flagged).alias("fp"),
                                   F.count_if(~bad & ~flagged).alias("tn"), F.count_if(bad & ~flagged).alias("fn"))


def roc_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mid-rank AUC (a tie counts one half), null when a class is missing. Pair counts stay exact in decimals."""
    by = list(by)
    positive = F.col("y") == 1
    values = scores.groupBy(*by, "p").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    ranked = running_totals(values, [*by, "p"], {"cum_neg": "neg"})
    wide = "decimal(38,0)"
    below = (F.col("cum_neg") - F.col("neg")).cast("decimal(19,0)")
    pos, neg = F.col("pos").cast("decimal(18,0)"), F.col("neg").cast("decimal(18,0)")
    parts = ranked.groupBy(*by).agg(
        F.sum((pos * below * 2 + pos * neg).cast(wide)).alias("twice"),
        F.min(F.col("cum_neg") - F.col("neg")).alias("base"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    pairs = F.col("positives").cast("decimal(19,0)") * F.col("negatives").cast("decimal(19,0)")
    own = F.col("twice") - F.col("base").cast("decimal(19,0)") * F.col("positives").cast("decimal(18,0)") * 2
    auc = F.when(pairs > 0, own.cast("double") / (pairs.cast("double") * 2))
    return parts.select(*by, "positives", "negatives", auc.alias("auc"))


def average_precision(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean precision at each positive, scores descending, ties by id; 0 without positives.

    Only (group, p, id, y) moves, in one range shuffle on (p, id): a score shared by many rows is split by id.
    """
    by = list(by)
    rows = scores.select(*by, "id", "p", (F.col("y") == 1).cast("long").alias("hit"))
    ranked = running_totals(rows, [*by, F.col("p").desc(), "id"], {"cum_hit": "hit"}, row_number="rank")
    if by:
        base = ranked.groupBy(*by).agg((F.min("rank") - 1).alias("rank0"), F.min(F.col("cum_hit") - F.col("hit")).alias("hit0"))
        ranked = (ranked.join(base, by).withColumn("rank", F.col("rank") - F.col("rank0"))
                  .withColumn("cum_hit", F.col("cum_hit") - F.col("hit0")))
    precision = F.when(F.col("hit") == 1, F.col("cum_hit").cast("double") / F.col("rank"))
    return ranked.groupBy(*by).agg(F.coalesce(F.avg(precision), F.lit(0.0)).alias("average_precision"))


def resampled_counts(cells: DataFrame, draws: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """cells (tp, fp, tn, fn) resampled with replacement, one row a draw: three binomial counts one after the other, each of
    what the ones before left over, together a multinomial draw."""
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    out = cells.select(*by, *COUNTS, total.alias("__left"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    out = out.repartition(DRAW_TASKS, *by, "draw")  # a draw sums as many numbers as the root of all rows: not one task's work
    rest, left = F.col("__left"), F.col("__left")
    for at, cell in enumerate(("tp", "fp", "fn")):
        share = F.when(rest > 0, F.col(cell).cast("double") / rest.cast("double")).otherwise(0.0)
        out = out.withColumn(f"__{cell}", inverse_binomial(left, share, uniform(F.col("draw"), F.lit(seed), F.lit(at))))
        rest, left = rest - F.col(cell), left - F.col(f"__{cell}")
    return out.select(*by, "draw", *[F.col(f"__{c}").alias(c) for c in ("tp", "fp")], left.alias("tn"), F.col("__fn").alias("fn"))


def bootstrap_mcc(scores: DataFrame, threshold: float | Column, draws: int = 500, seed: int = 0,
                  by: Sequence[str] = ()) -> DataFrame:
    """5th and 95th percentile of MCC at a fixed threshold over resamples of the same size.

    At a fixed threshold a resample of n rows is one multinomial draw over the four cells, so the scores are
    read once and each replicate costs four numbers, however large n is. The draws are column expressions keyed by seed and
    number of the draw.
    """
    by = list(by)
    drawn = resampled_counts(counts_at(scores, threshold, by), draws, seed, by).withColumn("mcc", mcc(*[F.col(c) for c in COUNTS]))
    ends = F.percentile("mcc", F.array(F.lit(0.05), F.lit(0.95)))  # draws values per group
    return drawn.groupBy(*by).agg(ends.alias("e")).select(*by, F.col("e")[0].alias("mcc_p05"), F.col("e")[1].alias("mcc_p95"))


# A validation MCC above the first is taken for leakage, below the second for a broken job.
LEAK_TRIPWIRE, BROKEN_FLOOR = 0.40, 0.12


def mcc_verdict(value: Column, high: float = LEAK_TRIPWIRE, low: float = BROKEN_FLOOR) -> Column:
    return F.when(value > high, "leakage").when(value < low, "broken").otherwise("ok")


def threshold_report(validation: DataFrame, tail: DataFrame, draws: int = 500, seed: int = 0) -> DataFrame:
    """One row: best validation threshold, its counts and interval, and how the train-tail threshold does there."""
    sweep = confusion_sweep(validation)
    best = best_threshold(sweep)
    tail_best = best_threshold(confusion_sweep(tail)).select("threshold")
    at_tail = confusion_at(sweep, tail_best.scalar())
    ends = bootstrap_mcc(validation, best.select("threshold").scalar(), draws, seed)
    return best.select(
        F.col("mcc").alias("validation_mcc"), "threshold", *COUNTS,
        tail_best.scalar().alias("train_tail_threshold"),
        at_tail.select("mcc").scalar().alias("validation_mcc_at_train_tail_threshold"),
        ends.select("mcc_p05").scalar().alias("mcc_p05"), ends.select("mcc_p95").scalar().alias("mcc_p95"),
        mcc_verdict(F.col("mcc")).alias("verdict"))


def per_seed_mcc(member_scores: DataFrame) -> DataFrame:
    """Best MCC of every ensemble member from (seed, id, y, p)."""
    return best_threshold(confusion_sweep(member_scores, by=["seed"]), by=["seed"]).select("seed", "threshold", "mcc")


def class_balance(scores: DataFrame) -> DataFrame:
    """Positives, their rate, and negatives per positive."""
    bad = F.count_if(F.col("y") == 1)
    return scores.agg(F.count(F.lit(1)).alias("parts"), bad.alias("positives")).select(
        "parts", "positives", F.try_divide(F.col("positives").cast("double"), F.col("parts")).alias("rate"),
        F.try_divide((F.col("parts") - F.col("positives")).cast("double"), F.col("positives")).alias("negative_weight"))
