import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from partflow.functions.scoring import GRID, threshold_bucket
from partflow.operators import cost as c, metrics as m
from partflow.operators.cost import CostParameters
from partflow.plans.holdout import decision_metrics

COSTS = CostParameters(42.0, 1850.0, 6.5, 240_000, 90, 1500.0)

# Rows of the published cost curve (threshold, dollars, tp, fp, tn, fn)
PUBLISHED = [(0.0, 17677.89, 728, 235915, 0, 0), (0.008, 13462.70, 401, 87738, 148177, 327), (0.027, 12360.76, 149, 2851, 233064, 579),
             (0.185, 13058.79, 105, 186, 235729, 623), (0.258, 13844.36, 66, 102, 235813, 662), (1.0, 15176.73, 0, 0, 235915, 728)]
STEPS = [row[0] for row in PUBLISHED]


def frame(spark, y, p):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y int, p double")


@pytest.fixture(scope="module")
def published(spark):
    """236,643 scored parts whose counts at the published thresholds are the published ones."""
    runs, rows = [], 0
    for (t, _, tp, fp, _, _), (_, _, tp2, fp2, _, _) in zip(PUBLISHED, PUBLISHED[1:]):
        for label, n in ((1, tp - tp2), (0, fp - fp2)):
            runs.append((label, t, rows, n))
            rows += n
    groups = spark.createDataFrame(runs, "y int, p double, first long, n long")
    spread = groups.select("y", "p", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return spread.select((F.col("first") + F.col("i")).alias("id"), "y", "p").persist()


@pytest.fixture(scope="module")
def scored(spark):
    """A third of all parts share one score."""
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.1
    p = np.round(np.where(np.arange(4000) % 3 == 0, 0.125, rng.random(4000) * 0.9 + y * 0.1), 3)
    return frame(spark, y, p).repartition(5), y, p


def test_sweep_matches_brute_force_at_every_threshold(scored):
    df, y, p = scored
    rows = {round(r.threshold, 3): r for r in m.confusion_sweep(df).collect()}
    assert len(rows) == 1001
    for t in GRID:
        r, hit = rows[round(t, 3)], p >= t
        assert (r.tp, r.fp, r.tn, r.fn) == ((hit & y).sum(), (hit & ~y).sum(), (~hit & ~y).sum(), (~hit & y).sum())


def test_bucket_is_exact_next_to_every_grid_value(spark):
    values = [v for t in GRID for v in (t, np.nextafter(t, -1), np.nextafter(t, 2))] + [-0.5, 1.5, float("nan"), float("inf")]
    df = spark.createDataFrame([(float(v),) for v in values], "p double").select("p", threshold_bucket(F.col("p")).alias("b"))
    for r in df.collect():
        want = len(GRID) - 1 if np.isnan(r.p) else int(np.searchsorted(GRID, r.p, side="right")) - 1
        assert r.b == want, r


def test_custom_thresholds_and_first_maximum(spark):
    df = frame(spark, [0, 0, 0, 1, 1], [.1, .2, .6, .7, .9])
    best = m.best_threshold(m.confusion_sweep(df, (.05, .5, .65))).first()
    assert (best.threshold, best.mcc) == (.65, 1.0)
    with pytest.raises(ValueError):
        m.confusion_sweep(df, (.5, .1))


def test_mcc_does_not_overflow(spark):
    big = spark.createDataFrame([(10 ** 9, 10 ** 9, 10 ** 9, 10 ** 9), (0, 0, 5, 5)], "tp long, fp long, tn long, fn long")
    assert [r[0] for r in big.select(m.mcc(*[F.col(x) for x in m.COUNTS])).collect()] == [0.0, 0.0]


def test_auc_is_the_pairwise_definition(scored, spark):
    df, y, p = scored
    pos, neg = p[y], p[~y]
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert m.roc_auc(df).first().auc == pytest.approx(want, abs=1e-12)
    assert m.roc_auc(frame(spark, [1, 1], [.1, .2])).first().auc is None


def test_average_precision(scored, spark):
    df, y, p = scored
    hits = y[np.argsort(-p, kind="mergesort")]
    ranks = np.flatnonzero(hits) + 1
    assert m.average_precision(df).first()[0] == pytest.approx((np.arange(1, len(ranks) + 1) / ranks).mean(), abs=1e-12)
    small = frame(spark, [1, 0, 1, 0, 0, 1], [.9, .8, .7, .6, .5, .1])
    assert m.average_precision(small).first()[0] == pytest.approx((1 + 2 / 3 + 1 / 2) / 3)
    assert m.average_precision(frame(spark, [0, 0], [.1, .2])).first()[0] == 0.0


def test_grouped_metrics_equal_separate_ones(scored):
    df, _, _ = scored
    both = df.withColumn("seed", F.lit(1)).unionByName(df.withColumn("seed", F.lit(2)).withColumn("p", 1 - F.col("p")))
    one, two = df, df.withColumn("p", 1 - F.col("p"))
    auc = {r.seed: r.auc for r in m.roc_auc(both, by=["seed"]).collect()}
    ap = {r.seed: r.average_precision for r in m.average_precision(both, by=["seed"]).collect()}
    assert (auc[1], auc[2]) == pytest.approx((m.roc_auc(one).first().auc, m.roc_auc(two).first().auc))
    assert (ap[1], ap[2]) == pytest.approx((m.average_precision(one).first()[0], m.average_precision(two).first()[0]))
    best = {r.seed: r.mcc for r in m.per_seed_mcc(both).collect()}
    assert best[2] == pytest.approx(m.best_threshold(m.confusion_sweep(two)).first().mcc)


def test_published_curve(published):
    curve = {r.threshold: r for r in c.cost_curve(published, COSTS, STEPS).collect()}
    for t, dollars, tp, fp, tn, fn in PUBLISHED:
        r = curve[t]
        assert (r.tp, r.fp, r.tn, r.fn) == (tp, fp, tn, fn) and round(r.dollars_per_shift, 2) == dollars
    assert curve[0.185].mcc == pytest.approx(0.2266703538, abs=1e-9)
    assert m.best_threshold(m.confusion_sweep(published, STEPS)).first().threshold == 0.185
    table = c.cost_curve(published, COSTS, STEPS)
    assert c.argmin_threshold(table).first().threshold == 0.027
    assert tuple(c.abstain_band(table, 1500.0).first()) == (0.008, 0.258)
    assert [round(v, 2) for v in c.trivial_costs(published, COSTS).first()] == [15176.73, 17677.89]


def test_published_decisions(published):
    d = decision_metrics(published, COSTS, 0.027, 0.008, 0.258, 0.185).first()
    assert (d.parts, d.failures, d.escaped_failures, d.failures_in_review, d.failures_inspected, d.good_parts_inspected) == (236643, 728, 327, 335, 66, 102)
    assert d.abstain_share == pytest.approx(0.37174562526675203) and round(d.dollars_per_shift, 2) == 12360.76
    assert d.mcc_at_validation_threshold == pytest.approx(0.22667035382963036) and not d.leak_tripwire


def test_bootstrap_interval_of_the_published_counts(published):
    lo, hi = m.bootstrap_mcc(published, 0.185, draws=2000).first()
    assert lo == pytest.approx(0.197, abs=0.006) and hi == pytest.approx(0.256, abs=0.006)
    assert m.bootstrap_mcc(published, 0.185, draws=50, seed=3).first() == m.bootstrap_mcc(published.repartition(3), 0.185, draws=50, seed=3).first()


def test_inverse_binomial_is_exact(spark):
    from partflow.functions.draws import inverse_binomial, uniform
    cases = [(n, p, u) for n in (0, 1, 7, 40, 900) for p in (0.0, 0.003, 0.3, 0.5, 0.97, 1.0) for u in (1e-6, 0.04, 0.5, 0.77, 0.999)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, p double, u double")
    got = {r.i: r.k for r in rows.select("i", inverse_binomial(F.col("n"), F.col("p"), F.col("u")).alias("k")).collect()}
    for i, (n, p, u) in enumerate(cases):
        total, k = 0.0, -1
        while k < n and (k < 0 or total < u):
            k += 1
            total += math.comb(n, k) * (p**k) * ((1 - p) ** (n - k))
        assert got[i] == k, (n, p, u)
    u = spark.range(4000).select(uniform(F.col("id"), F.lit(3)).alias("u")).agg(F.min("u"), F.avg("u"), F.max("u")).first()
    assert 0 < u[0] < 0.01 and 0.48 < u[1] < 0.52 and 0.99 < u[2] < 1


def test_resamples_keep_their_size_and_shares(spark):
    cells = spark.createDataFrame([(700, 0, 9000, 300)], "tp long, fp long, tn long, fn long")
    drawn = m.resampled_counts(cells, 400, 5)
    row = drawn.agg(F.min(F.expr("tp + fp + tn + fn")), F.max(F.expr("tp + fp + tn + fn")), F.avg("tp"), F.stddev("tp"), F.max("fp")).first()
    assert row[0] == row[1] == 10_000 and row[4] == 0
    assert row[2] == pytest.approx(700, abs=5) and row[3] == pytest.approx(math.sqrt(700 * 0.93), rel=0.12)


def curve_of(spark, dollars):
    return spark.createDataFrame([(i / (len(dollars) - 1), float(d)) for i, d in enumerate(dollars)], "threshold double, dollars_per_shift double")


def test_band_hull(spark):
    plain = curve_of(spark, [900, 500, 300, 450, 800])
    assert tuple(c.abstain_band(plain, 0).first()) == (.5, .5)
    assert tuple(c.abstain_band(plain, 200).first()) == (.25, .75)
    assert tuple(c.abstain_band(curve_of(spark, [300, 900, 310, 900, 305]), 20).first()) == (0.0, 1.0)
    with pytest.raises(ValueError):
        c.abstain_band(plain, -1)


def test_band_grows_with_indifference(scored):
    curve = c.cost_curve(scored[0], COSTS).persist()
    previous = (1.0, 0.0)
    for indifference in (0, 100, 1000, 5000):
        low, high = c.abstain_band(curve, indifference).first()
        assert low <= previous[0] and high >= previous[1]
        previous = (low, high)


def test_decisions_fixture(spark):
    df = frame(spark, [1, 0, 0, 1, 1, 0, 0, 0], [.005, .002, .1, .3, .02, .5, .009, .2])
    d = decision_metrics(df, COSTS, .1, .01, .25, .1).first()
    assert (d.escaped_failures, d.committed_share, d.abstain_share) == (1, 5 / 8, 3 / 8)


def test_policy_routes_and_versions(spark, scored):
    df, _, p = scored
    policy = c.build_policy(df, COSTS).persist()
    row = policy.first()
    band = (p >= row.band_low) & (p < row.band_high)
    assert row.abstain_share == pytest.approx(band.mean())
    routed = {r.decision: r["count"] for r in c.route_parts(df, policy).groupBy("decision").count().collect()}
    assert routed.get("review", 0) == band.sum() and routed.get("ship", 0) == (p < row.band_low).sum()
    assert c.build_policy(df.repartition(9), COSTS).first().version == row.version
    assert c.build_policy(df, CostParameters(43.0, 1850.0, 6.5, 240_000, 90, 1500.0)).first().version != row.version
    assert c.build_policy(df.where("id > 0"), COSTS).first().version != row.version
    useless = frame(spark, [1, 0, 0, 0], [0.5, 0.5, 0.5, 0.5])
    assert c.build_policy(useless, COSTS).first().verdict == "rejected"


def test_compare_policies_lists_changes(scored):
    new = CostParameters(42.0, 2400.0, 6.5, 240_000, 90, 1500.0)
    rows = {(r.section, r.item): r for r in c.compare_policies(scored[0], COSTS, new).collect()}
    changed = [k for k in rows if k[0] == "parameter"]
    assert changed == [("parameter", "field_failure_cost_usd")] and rows[changed[0]].delta == 550.0
    assert rows[("curve", "threshold")].new_value == c.argmin_threshold(c.cost_curve(scored[0], new)).first().threshold
    assert len([k for k in rows if k[1].startswith("dollars_at_")]) == 9


def test_negative_indifference_is_rejected():
    with pytest.raises(ValueError):
        CostParameters(1, 1, 1, 1, 1, -1)


def test_draws_are_dealt_over_tasks(spark):
    """A draw sums as many numbers as the root of all rows, so the draws of one row of counts are not one task's work."""
    from partflow.operators.metrics import resampled_counts
    cells = spark.createDataFrame([(5, 7, 80, 8)], "tp long, fp long, tn long, fn long")
    drawn = resampled_counts(cells, 200, 0)
    assert drawn.select(F.spark_partition_id().alias("t")).distinct().count() > 8
    rows = drawn.collect()
    assert {r.draw for r in rows} == set(range(200)) and all(r.tp + r.fp + r.tn + r.fn == 100 for r in rows)


def test_report_and_splits_write_no_date_table(spark, folder):
    """The start of a part is one number; fourteen date columns a part are not written to find it."""
    import datetime
    from partflow.queries import bindings as b
    from partflow.queries.metrics import m8
    at = datetime.datetime(1994, 1, 1)
    spark.createDataFrame([(i, i, "F" if i % 3 else "O", "1-URGENT" if i % 2 else "2-HIGH") for i in range(60)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, n, at + datetime.timedelta(days=i + n)) for i in range(59) for n in (1, 2)],
                          "l_orderkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    assert m8(spark, folder).count() == 1
    assert {r.Id: r.split for r in b.split_table(spark, folder).collect()}[59] == "train"  # a part without readings
    assert {name for _, d, name in b._WRITTEN if d == folder} == {"starts", "splits"}
