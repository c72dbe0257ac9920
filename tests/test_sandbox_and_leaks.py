import pytest
from pyspark.sql import functions as F

from partflow.operators import sandbox as sb
from partflow.plans import leaks as lk
from partflow.plans.search import accept, accept_all, AcceptConfig


@pytest.fixture(scope="module")
def layout(spark):
    """Two splits; batches of four share a start time; the label depends on one reading only."""
    n = 400
    ids = spark.range(1, n + 1).withColumnRenamed("id", "Id")
    reading = (F.col("Id") * 37 % 101).cast("double")
    numeric = ids.select("Id", (reading > 80).cast("byte").alias("Response"), reading.alias("L0_S0_F0"))
    start = F.floor((F.col("Id") * 53 % n) / 4).cast("double")
    dates = ids.select("Id", start.alias("L0_S0_D1"), (start + 1).alias("L0_S1_D3"))
    categorical = ids.select("Id", F.lit("T1").alias("L0_S0_F2"))
    splits = ids.select("Id", F.when(start < 60, "train").when(start < 80, "validation").otherwise("holdout").alias("split"))
    return {"numeric": numeric.persist(), "date": dates.persist(), "categorical": categorical.persist()}, splits.persist()


def feature(sql, name="candidate"):
    return sb.FeatureDef(name, "an idea", sql=sql)


def mapping(layout, mode="plain", split="train"):
    return sb.id_map(layout[1].where(F.col("split") == split), mode)


def test_shuffled_ids_are_a_permutation(layout):
    rows = mapping(layout, "shuffled").collect()
    assert sorted(r.Id for r in rows) == sorted(r.bound_id for r in rows)
    assert sum(r.Id != r.bound_id for r in rows) > 0.9 * len(rows)
    assert sorted(mapping(layout, "shuffled").collect()) == sorted(rows)


def test_subset_is_a_stable_fraction(layout):
    ids = layout[1].where("split = 'train'")
    half = {r.Id for r in sb.id_map(ids, "subset").collect()}
    assert 0.35 < len(half) / ids.count() < 0.65
    assert half == {r.Id for r in sb.id_map(ids.repartition(9), "subset").collect()}


def test_row_local_feature_ignores_the_binding(layout):
    f = feature("SELECT Id, L0_S0_F0 * 2 AS twice FROM parts_numeric")
    plain = sorted(sb.compute_feature(f, layout[0], mapping(layout)).collect())
    assert plain == sorted(sb.compute_feature(f, layout[0], mapping(layout, "shuffled")).collect())


def test_labels_are_hidden(layout):
    with pytest.raises(sb.FeatureError):
        sb.compute_feature(feature("SELECT Id, Response FROM parts_numeric"), layout[0], mapping(layout))


@pytest.mark.parametrize("sql", [
    "SELECT L0_S0_F0 FROM parts_numeric", "SELECT Id FROM parts_numeric",
    "SELECT Id, 1 AS x FROM parts_numeric UNION ALL SELECT Id, 2 AS x FROM parts_numeric",
    "SELECT Id, 1 AS x FROM parts_numeric WHERE L0_S0_F0 > 50", "SELECT Id + 100000 AS Id, 1 AS x FROM parts_numeric"])
def test_wrong_shapes_are_rejected(layout, sql):
    with pytest.raises(sb.FeatureError):
        sb.compute_feature(feature(sql), layout[0], mapping(layout))


def test_definitions_are_checked_and_ids_are_stable():
    for bad in ({"name": "Bad Name"}, {"hypothesis": " "}, {"sql": ""}):
        with pytest.raises(sb.FeatureError):
            sb.FeatureDef(**{"name": "ok", "hypothesis": "h", "sql": "SELECT 1", **bad})
    assert feature("SELECT 1").feature_id == feature("SELECT 1").feature_id != feature("SELECT 2").feature_id


def scope(layout, f):
    full, half = (sb.compute_feature(f, layout[0], mapping(layout, mode)) for mode in ("plain", "subset"))
    return sb.compare_frames(full, half).first()


def test_row_scope_catches_the_neighbour_leak(layout):
    leak = sb.FeatureDef("gap", "neighbours fail together", build=lambda v: lk.id_gap(v["date"]))
    found = scope(layout, leak)
    assert found.mismatch_share > 0.3
    windowed = feature("SELECT Id, Id - lag(Id) OVER (ORDER BY L0_S0_D1, Id) AS gap FROM parts_date")
    assert scope(layout, windowed).mismatched == found.mismatched
    assert scope(layout, feature("SELECT Id, L0_S0_F0 FROM parts_numeric")).mismatched == 0


def test_nan_and_null_are_equal_in_comparisons(spark):
    a = spark.createDataFrame([(1, float("nan"), None), (2, None, "x"), (3, 1.0, "y"), (4, 2.0, None)], "Id long, v double, s string")
    b = spark.createDataFrame([(1, None, None), (2, float("nan"), "x"), (3, 1.5, "y"), (4, 2.0, "z")], "Id long, v double, s string")
    assert tuple(sb.compare_frames(a, b).first())[:2] == (4, 2)


def test_honest_feature_passes_and_lift_is_found(layout):
    lab = lk.LeakLab(*layout, config=lk.LeakConfig(min_lift=0.005), lift_config=lk.LiftConfig(trees=3, depth=2, min_instances=5))
    f = feature("SELECT Id, L0_S0_F0 FROM parts_numeric", "honest")
    row = lk.leak_verdict(lab.results([f]), lab.config).first()
    assert row.lift > 0.4 and row.decision == "approve" and row.failed_tests == []


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, lift double, shuffled_lift double, time_lift double, random_lift double, rows_compared long, mismatched long")


def test_collapse_and_retention(spark):
    rows = results(spark, ("a", .20, .02, .05, .20, 10, 0), ("b", .20, .25, .2, .01, 10, 0), ("c", .01, .0, .2, .2, 10, 3))
    got = {r.name: r for r in lk.leak_verdict(rows).collect()}
    assert (got["a"].collapse, got["a"].retention) == (pytest.approx(.9), pytest.approx(.25))
    assert (got["b"].collapse, got["b"].retention, got["c"].collapse) == (0.0, 1.0, 0.0)
    assert got["a"].failed_tests == ["id shuffle", "strict time refit"] and got["b"].decision == "approve"
    assert got["c"].failed_tests == ["row scope"]


def test_either_side_may_quarantine(spark):
    rule = spark.createDataFrame([("a", "approve"), ("b", "quarantine"), ("c", "approve"), ("d", "quarantine")], "name string, decision string")
    reviewer = spark.createDataFrame([("a", "quarantined"), ("b", "approved"), ("c", "approved")], "name string, status string")
    got = {r.name: (r.final_status, r.overridden, r.disagreement) for r in lk.final_status(reviewer, rule).collect()}
    assert got == {"a": ("quarantined", False, True), "b": ("quarantined", True, False), "c": ("approved", False, False), "d": ("quarantined", False, False)}


def test_quarantine_is_final_and_only_the_decider_counts(spark):
    log = [("1", "x", "warden", "quarantined", "bad", 1), ("1", "x", "warden", "approved", "good", 2), ("2", "y", "other", "approved", "good", 1),
           ("3", "z", "warden", "approved", "", 1), ("4", "w", "warden", "approved", "good", 5)]
    df = spark.createDataFrame(log, "feature_id string, name string, actor string, status string, finding string, at int")
    assert {r.name: r.status for r in sb.feature_status(df).collect()} == {"x": "quarantined", "y": "proposed", "z": "proposed", "w": "approved"}


def test_acceptance_moves_the_bar_and_stops(spark):
    runs = [("s", i, mcc, ap) for i, (mcc, ap) in enumerate([(.21, .08), (.25, .09), (.251, .2), (.26, .08), (.2, .1), (.9, .9)])]
    evals = spark.createDataFrame(runs, "search string, seq int, mcc double, ap double")
    ref = spark.createDataFrame([("s", .22, .07, .005, .001)], "search string, mcc double, ap double, sd_mcc double, sd_ap double")
    got = accept(evals, ref).orderBy("seq").collect()
    assert [r.improved for r in got] == [False, True, False, False, False]
    assert got[1].mcc_bar == pytest.approx(.23) and got[2].mcc_bar == pytest.approx(.26) and got[3].ap_bar == pytest.approx(.092)
    assert got[-1].stop_reason == "consecutive failures" and got[-1].best_mcc == .25
    capped = accept(evals, ref, AcceptConfig(max_evaluations=2)).orderBy("seq").collect()
    assert [r.stop_reason for r in capped] == [None, "evaluation budget"]
    every = accept_all(evals, ref).orderBy("seq").collect()
    assert [r.counted for r in every] == [True] * 5 + [False] and every[-1].mcc == .9 and every[-1].improved is None


def test_new_columns_are_prefixed_capped_and_covering(spark, layout):
    base = layout[0]["numeric"].select("Id", "Response")
    frames = {"one": layout[0]["date"]}
    assert sb.feature_columns_for(base, frames).columns == ["Id", "Response", "fx_one__L0_S0_D1", "fx_one__L0_S1_D3"]
    with pytest.raises(sb.FeatureError):
        sb.feature_columns_for(base, frames, max_columns=1)
    assert sb.coverage_gap(base, {"half": layout[0]["date"].where("Id <= 200")}).first().missing == 200


def test_exploration_sees_labels_and_is_paged(layout):
    rows = sb.explore(layout[0], layout[0]["numeric"], "SELECT l.Response, count(*) AS n FROM parts_numeric n JOIN parts_labels l ON n.Id = l.Id GROUP BY 1", 10).collect()
    assert sum(r.n for r in rows) == 400


def test_views_of_the_caller_come_back(spark):
    own = spark.range(3)
    own.createOrReplaceTempView("parts_numeric")
    tables = {"numeric": spark.createDataFrame([(1, 0, 2.0)], "Id long, Response byte, L0_S0_F0 double")}
    labels = spark.createDataFrame([(1, 0)], "Id long, Response byte")
    assert sb.explore(tables, labels, "SELECT sum(L0_S0_F0) AS s FROM parts_numeric JOIN parts_labels USING (Id)").first().s == 2.0
    assert spark.table("parts_numeric").count() == 3 and not spark.catalog.tableExists("parts_labels")
    spark.catalog.dropTempView("parts_numeric")
