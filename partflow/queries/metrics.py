"""Threshold sweeps and ranking metrics over the scores of all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partflow.functions.draws import inverse_binomial_sql
from partflow.operators import metrics as m
from partflow.operators.cost import build_policy
from partflow.plans.ensemble import early_stopping_tail
from partflow.plans.holdout import decision_metrics
from partflow.queries import bindings as b
from partflow.queries.registry import Query
from partflow.queries.sqlparts import dollars_sql, hash_sql, mcc_sql, policy_sql, sweep_sql
from partflow.session import materialized

GRID10 = tuple(k / 10 for k in range(11))


def seeded_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Three members per part: the score shifted by a member-specific whole number of thousandths."""
    s = b.scores(spark, folder)
    return s.select(F.explode(F.array(F.lit(17), F.lit(1), F.lit(2))).alias("seed"), "id", "y", "p").withColumn(
        "p", F.least(F.lit(999), F.round(F.col("p") * 1000).cast("int") + (F.col("id") * F.col("seed")) % 50).cast("double") / 1000)


SEEDED = ("seeded AS (SELECT seed, id, y, CAST(least(999, CAST(round(p * 1000) AS INTEGER) + (id * seed) % 50) AS DOUBLE) / 1000 AS p "
          "FROM (SELECT unnest([17, 1, 2]) AS seed, id, y, p FROM scores))")


def m2(spark, folder):
    counts = m.counts_at(b.scores(spark, folder), 0.25)
    return counts.withColumn("mcc", m.mcc(*[F.col(c) for c in m.COUNTS]))


def m11(spark, folder):
    scores = b.scores(spark, folder)
    policy = materialized(build_policy(scores, b.COSTS))
    one = lambda c: policy.select(c).scalar()
    return decision_metrics(scores, b.COSTS, one("threshold"), one("band_low"), one("band_high"), 0.25)


def m8(spark, folder):
    """The tail is the latest share of the train parts."""
    validation, train = (b.split_scores(spark, folder, s) for s in ("validation", "train"))
    begun = b.split_table(spark, folder).where("split = 'train'").select("Id", F.col("min_ts").alias("start_ts"))
    latest = early_stopping_tail(begun, 0.15).where("in_tail").select(F.col("Id").alias("id"))
    return m.threshold_report(materialized(validation), materialized(train.join(latest.hint("merge"), "id", "left_semi")))


def bootstrap(spark, folder):
    """The point estimate lies inside the interval."""
    ends = m.bootstrap_mcc(b.scores(spark, folder), 0.25, draws=500, seed=0)
    point = m2(spark, folder).select("mcc").scalar()
    return ends.select((F.col("mcc_p05") <= point).alias("low_ok"), (F.col("mcc_p95") >= point).alias("high_ok"))


def draws_sql(cells: str, draws: int = 500, seed: int = 0) -> str:
    """CTEs ending in ends(mcc_p05, mcc_p95): the same keyed draws over the one row (tp, fp, tn, fn) of cells."""
    number = lambda at: f"(CAST({hash_sql('draw', str(seed), str(at))} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({1 << 60} AS DOUBLE)"
    parts, rest, left, source = [f"d0 AS (SELECT *, tp + fp + tn + fn AS n, draw FROM {cells}, range({draws}) AS r(draw))"], "n", "n", "d0"
    for at, cell in enumerate(("tp", "fp", "fn")):
        share = f"(CASE WHEN {rest} > 0 THEN CAST({cell} AS DOUBLE) / CAST({rest} AS DOUBLE) ELSE 0 END)"
        parts.append(f"d{at + 1} AS ({inverse_binomial_sql(source, 'draw', f'({left})', share, number(at), 'r' + cell, '*')})")
        rest, left, source = f"({rest} - {cell})", f"{left} - r{cell}", f"d{at + 1}"
    parts.append(f"ends AS (SELECT quantile_cont(v, 0.05) AS mcc_p05, quantile_cont(v, 0.95) AS mcc_p95 FROM (SELECT {mcc_sql('rtp', 'rfp', '(n - rtp - rfp - rfn)', 'rfn')} AS v FROM d3))")
    return ", ".join(parts)


RANKED = "CAST(count(*) FILTER (y = 1) AS BIGINT)"
AUC = ("agg AS (SELECT {by} sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rs, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM ("
       "SELECT {by} y, rank() OVER ({part} ORDER BY p) + (count(*) OVER ({same}) - 1) / 2.0 AS r FROM {src}) {group})")
AP = ("hits AS (SELECT {by} y, row_number() OVER ({part} ORDER BY p DESC, id) AS rk, sum(y) OVER ({part} ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS k FROM {src})")

QUERIES = [
    Query("M1_confusion_sweep", lambda s, d: m.confusion_sweep(b.scores(s, d)),
          b.with_ctes("scores", "SELECT * FROM sweep", sweep_sql()), ["mcc"]),
    Query("M1_confusion_sweep_custom_thresholds", lambda s, d: m.confusion_sweep(b.scores(s, d), GRID10),
          b.with_ctes("scores", "SELECT * FROM sweep WHERE CAST(round(threshold * 1000) AS INTEGER) % 100 = 0", sweep_sql()), ["mcc", "threshold"]),
    Query("M2_mcc", m2, b.with_ctes("scores", f"SELECT *, {mcc_sql()} AS mcc FROM c",
          "c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.25) AS tp, count(*) FILTER (y = 0 AND p >= 0.25) AS fp, "
          "count(*) FILTER (y = 0 AND p < 0.25) AS tn, count(*) FILTER (y = 1 AND p < 0.25) AS fn FROM scores)"), ["mcc"]),
    Query("M3_best_threshold", lambda s, d: m.best_threshold(m.confusion_sweep(b.scores(s, d))),
          b.with_ctes("scores", "SELECT * FROM sweep ORDER BY mcc DESC, threshold LIMIT 1", sweep_sql()), ["mcc"]),
    Query("M4_confusion_at", lambda s, d: m.confusion_at(m.confusion_sweep(b.scores(s, d)), 0.31415),
          b.with_ctes("scores", "SELECT * FROM sweep ORDER BY abs(threshold - CAST(0.31415 AS DOUBLE)), threshold LIMIT 1", sweep_sql()), ["mcc"]),
    Query("M5_roc_auc", lambda s, d: m.roc_auc(b.scores(s, d)),
          b.with_ctes("scores", "SELECT np AS positives, nn AS negatives, (rs - CAST(np AS DOUBLE) * (np + 1) / 2) / (CAST(np AS DOUBLE) * nn) AS auc FROM agg",
                      AUC.format(by="", part="", same="PARTITION BY p", src="scores", group="")), ["auc"]),
    Query("M5_roc_auc_by_seed", lambda s, d: m.roc_auc(seeded_scores(s, d), by=["seed"]),
          b.with_ctes("scores", "SELECT seed, np AS positives, nn AS negatives, (rs - CAST(np AS DOUBLE) * (np + 1) / 2) / (CAST(np AS DOUBLE) * nn) AS auc FROM agg",
                      SEEDED + ", " + AUC.format(by="seed,", part="PARTITION BY seed", same="PARTITION BY seed, p", src="seeded", group="GROUP BY seed")), ["auc"]),
    Query("M6_average_precision", lambda s, d: m.average_precision(b.scores(s, d)),
          b.with_ctes("scores", "SELECT coalesce(avg(CAST(k AS DOUBLE) / rk) FILTER (y = 1), 0) AS average_precision FROM hits",
                      AP.format(by="", part="", src="scores")), ["average_precision"]),
    Query("M6_average_precision_by_seed", lambda s, d: m.average_precision(seeded_scores(s, d), by=["seed"]),
          b.with_ctes("scores", "SELECT seed, coalesce(avg(CAST(k AS DOUBLE) / rk) FILTER (y = 1), 0) AS average_precision FROM hits GROUP BY seed",
                      SEEDED + ", " + AP.format(by="seed,", part="PARTITION BY seed", src="seeded")), ["average_precision"]),
    Query("M7_bootstrap_mcc", bootstrap, b.with_ctes("scores", "SELECT count(*) > 0 AS low_ok, count(*) > 0 AS high_ok FROM scores")),
    Query("M7_bootstrap_interval", lambda s, d: m.bootstrap_mcc(b.scores(s, d), 0.25, draws=500, seed=0),
          b.with_ctes("scores", "SELECT * FROM ends", "cells AS (SELECT count(*) FILTER (y = 1 AND p >= 0.25) AS tp, count(*) FILTER (y = 0 AND p >= 0.25) AS fp, "
                      "count(*) FILTER (y = 0 AND p < 0.25) AS tn, count(*) FILTER (y = 1 AND p < 0.25) AS fn FROM scores), " + draws_sql("cells")), ["mcc_p05", "mcc_p95"]),
    Query("M8_threshold_report", m8,
          b.with_ctes("scores splits starts",
                      "SELECT mcc_p05, mcc_p95, v.mcc AS validation_mcc, v.threshold, v.tp, v.fp, v.tn, v.fn, t.threshold AS train_tail_threshold, "
                      "(SELECT mcc FROM asweep ORDER BY abs(threshold - t.threshold), threshold LIMIT 1) AS validation_mcc_at_train_tail_threshold, "
                      "CASE WHEN v.mcc > 0.4 THEN 'leakage' WHEN v.mcc < 0.12 THEN 'broken' ELSE 'ok' END AS verdict FROM "
                      "best v, (SELECT * FROM bsweep ORDER BY mcc DESC, threshold LIMIT 1) t, ends",
                      "val AS (SELECT c.* FROM scores c JOIN splits s ON s.Id = c.id WHERE split = 'validation'), "
                      "late AS (SELECT s.Id, row_number() OVER (ORDER BY s.min_ts DESC, s.Id DESC) AS r FROM starts s JOIN splits p ON p.Id = s.Id WHERE split = 'train' AND s.min_ts IS NOT NULL), "
                      "trn AS (SELECT c.* FROM scores c JOIN late ON late.Id = c.id WHERE r <= (SELECT CAST(round_even(count(*) * CAST(0.15 AS DOUBLE), 0) AS BIGINT) FROM splits WHERE split = 'train')), "
                      + sweep_sql("val", "a") + ", " + sweep_sql("trn", "b") + ", best AS (SELECT * FROM asweep ORDER BY mcc DESC, threshold LIMIT 1), "
                      + draws_sql("(SELECT tp, fp, tn, fn FROM best)")),
          ["validation_mcc", "validation_mcc_at_train_tail_threshold", "mcc_p05", "mcc_p95"]),
    Query("M9_per_seed_mcc", lambda s, d: m.per_seed_mcc(seeded_scores(s, d)),
          b.with_ctes("scores", "SELECT seed, threshold, mcc FROM sw QUALIFY row_number() OVER (PARTITION BY seed ORDER BY mcc DESC, threshold) = 1",
                      SEEDED + ", vals AS (SELECT seed, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM seeded GROUP BY seed, p), "
                      "cells AS (SELECT seed, CAST(i AS DOUBLE) / 1000 AS threshold, coalesce(sum(pos) FILTER (p >= CAST(i AS DOUBLE) / 1000), 0) AS tp, "
                      "coalesce(sum(neg) FILTER (p >= CAST(i AS DOUBLE) / 1000), 0) AS fp, coalesce(sum(neg) FILTER (p < CAST(i AS DOUBLE) / 1000), 0) AS tn, "
                      "coalesce(sum(pos) FILTER (p < CAST(i AS DOUBLE) / 1000), 0) AS fn FROM range(1001) AS r(i), vals GROUP BY seed, i), "
                      f"sw AS (SELECT *, {mcc_sql()} AS mcc FROM cells)"), ["mcc"]),
    Query("M11_decision_metrics", m11,
          b.with_ctes("scores",
                      f"SELECT c.parts, c.failures, {mcc_sql('mtp', 'mfp', 'mtn', 'mfn')} AS mcc_at_validation_threshold, "
                      "(SELECT (rs - CAST(np AS DOUBLE) * (np + 1) / 2) / (CAST(np AS DOUBLE) * nn) FROM agg) AS auc, "
                      "(SELECT coalesce(avg(CAST(k AS DOUBLE) / rk) FILTER (y = 1), 0) FROM hits) AS average_precision, "
                      f"{dollars_sql(b.COSTS, 'ctp', 'cfp', 'ctn', 'cfn')} AS dollars_per_shift, "
                      f"{dollars_sql(b.COSTS, '0', '0', '(c.parts - c.failures)', 'c.failures')} AS ship_all_dollars_per_shift, "
                      "1 - CAST(in_review AS DOUBLE) / c.parts AS committed_share, CAST(in_review AS DOUBLE) / c.parts AS abstain_share, "
                      "escaped_failures, failures_in_review, failures_inspected, good_parts_inspected, "
                      f"{mcc_sql('mtp', 'mfp', 'mtn', 'mfn')} > 0.4 AS leak_tripwire FROM c",
                      policy_sql(b.COSTS) + ", " + AUC.format(by="", part="", same="PARTITION BY p", src="scores", group="") + ", "
                      + AP.format(by="", part="", src="scores") + ", c AS (SELECT count(*) AS parts, count(*) FILTER (y = 1) AS failures, "
                      "count(*) FILTER (p >= band_low AND p < band_high) AS in_review, count(*) FILTER (y = 1 AND p < band_low) AS escaped_failures, "
                      "count(*) FILTER (y = 1 AND p >= band_low AND p < band_high) AS failures_in_review, "
                      "count(*) FILTER (y = 1 AND p >= band_high) AS failures_inspected, count(*) FILTER (y = 0 AND p >= band_high) AS good_parts_inspected, "
                      "count(*) FILTER (y = 1 AND p >= 0.25) AS mtp, count(*) FILTER (y = 0 AND p >= 0.25) AS mfp, "
                      "count(*) FILTER (y = 0 AND p < 0.25) AS mtn, count(*) FILTER (y = 1 AND p < 0.25) AS mfn, "
                      "count(*) FILTER (y = 1 AND p >= threshold) AS ctp, count(*) FILTER (y = 0 AND p >= threshold) AS cfp, "
                      "count(*) FILTER (y = 0 AND p < threshold) AS ctn, count(*) FILTER (y = 1 AND p < threshold) AS cfn FROM scores, policy)"),
          ["mcc_at_validation_threshold", "auc", "average_precision", "dollars_per_shift", "ship_all_dollars_per_shift", "committed_share", "abstain_share"]),
    Query("A12_class_balance", lambda s, d: m.class_balance(b.scores(s, d)),
          b.with_ctes("scores", "SELECT count(*) AS parts, count(*) FILTER (y = 1) AS positives, CAST(count(*) FILTER (y = 1) AS DOUBLE) / count(*) AS rate, "
                                "CAST(count(*) FILTER (y = 0) AS DOUBLE) / count(*) FILTER (y = 1) AS negative_weight FROM scores"), ["rate", "negative_weight"]),
]
