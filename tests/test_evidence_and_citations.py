import pytest
from pyspark.sql import functions as F

from partflow.operators import citations as ci, evidence as ev
from partflow.queries import evidence as queries
from partflow.queries.evidence import dispositions
from partflow.sources.catalog import measurements_long


@pytest.fixture(scope="module")
def policy(spark):
    return spark.createDataFrame([(.1, .4)], "band_low double, band_high double")


@pytest.fixture(scope="module")
def scores(spark):
    return spark.range(51).select("id", F.lit(0).alias("y"), (F.col("id") / 100).alias("p"))


def test_queue_is_the_half_open_band_in_score_order(scores, policy):
    rows = ev.review_queue(scores, policy).collect()
    assert [r.part_id for r in rows] == list(range(39, 9, -1))


def test_open_queue_and_membership(spark, scores, policy):
    queue = ev.review_queue(scores, policy)
    decisions = spark.createDataFrame([(39, "ship"), (39, "scrap"), (5, "ship")], "part_id long, action string")
    written = spark.createDataFrame([(38,)], "part_id long")
    page = ev.open_queue(queue, decisions, written, 5).orderBy(F.col("score").desc()).collect()
    assert [r.part_id for r in page] == [38, 37, 36, 35, 34] and [r.has_disposition for r in page][:2] == [True, False]
    assert (page[0].total, page[0].decided) == (29, 2)
    asked = spark.createDataFrame([(20,), (45,), (1,)], "part_id long")
    assert {r.part_id for r in ev.queue_membership(asked, queue).collect()} == {45, 1}


def test_sketch_ranges_are_close_in_rank(spark):
    long = spark.range(20_000).select(F.lit("L0_S0_F0").alias("name"), (F.col("id") * 7919 % 20011).cast("double").alias("value"))
    values = sorted(r.value for r in long.collect())
    exact, sketch = ev.normal_ranges(long, exact=True).first(), ev.normal_ranges(long).first()
    for e, s in ((exact.low, sketch.low), (exact.high, sketch.high)):
        assert abs(values.index(e) - values.index(s)) <= 4
    assert ev.normal_ranges(long.where("value < 0")).count() == 0


def test_a_new_day_is_sketched_alone_and_merged(spark, folder):
    sorted_day = spark.range(40_000).select(F.lit(1).alias("day"), F.lit("a").alias("name"), F.col("id").cast("double").alias("value"))
    skewed_day = spark.range(60_000).select(F.lit(2).alias("day"), F.lit("a").alias("name"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.lit(1.0002), F.col("id"))).alias("value"))
    ev.append_sketches(ev.range_sketches(sorted_day), folder + "/s")
    first = spark.read.parquet(folder + "/s")
    assert first.count() == 1 and first.first().n == 40_000
    ev.append_sketches(ev.range_sketches(skewed_day.unionByName(skewed_day.limit(3).withColumn("value", F.lit(None).cast("double")))), folder + "/s")
    both = ev.sketched_ranges(spark.read.parquet(folder + "/s"))
    errors = ev.rank_errors(sorted_day.unionByName(skewed_day), both).first()
    assert errors.low_error <= 0.003 and errors.high_error <= 0.003
    assert ev.sketched_ranges(ev.range_sketches(skewed_day.where("value < 0"))).count() == 0


def test_part_evidence(spark, tables, policy):
    queue = spark.createDataFrame([(1, .2), (4, .3)], "part_id long, score double")
    ranges = spark.createDataFrame([("L0_S0_F0", 0.0, 0.4), ("L0_S0_F2", -1.0, 1.0)], "name string, low double, high double")
    routes = spark.createDataFrame([(1, "L0_S0-L1_S24"), (2, "L0_S0"), (4, "")], "Id long, route string")
    got = {r.part_id: r for r in ev.part_evidence(queue, measurements_long(tables["numeric"], "numeric"), measurements_long(tables["date"], "date"),
                                                  routes, ranges, policy).collect()}
    assert set(got) == {1, 4}
    assert [tuple(o) for o in got[1].out_of_range] == [("L0_S0_F0", 4.0, 0.0, .4), ("L0_S0_F2", 1.25, -1.0, 1.0)]
    assert got[1].columns == ["L0_S0_F0", "L0_S0_F2", "L1_S24_F1", "L0_S0_D1", "L0_S0_D3", "L1_S24_D2"]
    assert (got[1].measurements_present, got[4].measurements_present, got[4].columns, got[4].out_of_range) == (3, 0, [], [])
    assert got[1].policy_band == [.1, .4]


GOOD = dict(route="L0_S0", recommendation="scrap", reason="L0_S0_F0 is high", out_of_range=[("L0_S0_F0", .50001, 0.0, .4)], neighbor_summary="part 7 failed",
            citations=[("column", "L0_S0_F0"), ("part", "7")])
CASES = {
    "good": ({}, []),
    "choice": ({"recommendation": "rework"}, ["recommendation rework"]),
    "unknown column": ({"citations": [("column", "L9_S9_F9")]}, ["L9_S9_F9 names no column of the tables"]),
    "unseen column": ({"citations": [("column", "L0_S0_F2")]}, ["L0_S0_F2 is missing from the part record"]),
    "unseen part": ({"citations": [("part", "8"), ("part", "x7"), ("part", "99999999999999999999")]}, ["part 8", "part x7", "part 99999999999999999999"]),
    "kind": ({"citations": [("web", "x")]}, ["no such kind web"]),
    "token": ({"reason": "see L9_S9_D9 and L0_S0_F2 and L9_S9_D9, not XL0_S0_F7"}, ["reason: column L0_S0_F2 is missing from", "reason: column L9_S9_D9 names no column"]),
    "value": ({"out_of_range": [("L0_S0_F0", .6, 0.0, .4)]}, ["quoted with other values"]),
    "null value": ({"out_of_range": [("L0_S0_F0", None, 0.0, .4)]}, ["quoted with other values"]),
    "not outside": ({"out_of_range": [("L0_S0_F2", .6, 0.0, .4)]}, ["lies within its range here"]),
    "missing": ({"reason": None, "route": None}, ["left out: route, reason"]),
}


def test_dispositions(spark):
    rows = []
    for i, (change, _) in enumerate(CASES.values()):
        d = {**GOOD, **change}
        rows.append((i, tuple(d[k] for k in ("route", "recommendation", "reason", "out_of_range", "neighbor_summary", "citations")), ["L0_S0_F0"], [7]))
    written = spark.createDataFrame(rows, ci.DISPOSITION_SCHEMA)
    queue = spark.range(len(CASES) + 1).withColumnRenamed("id", "part_id")
    record = queue.select("part_id", F.array(F.struct(F.lit("L0_S0_F0").alias("name"), F.lit(.5).alias("value"), F.lit(0.0).alias("low"), F.lit(.4).alias("high"))).alias("out_of_range"))
    names = spark.createDataFrame([("L0_S0_F0",), ("L0_S0_F2",)], "name string")
    got = {r.part_id: r for r in ci.validate_dispositions(queue, written, record, names).collect()}
    for i, (name, (_, errors)) in enumerate(CASES.items()):
        assert got[i].status == ("rejected" if errors else "valid"), name
        assert len(got[i].errors) == len(errors) and all(want in have for want, have in zip(errors, got[i].errors)), (name, got[i].errors)
        assert got[i].recommendation == ("senior_review" if errors else "scrap")
    assert (got[len(CASES)].status, got[len(CASES)].recommendation) == ("missing", "senior_review")
    unknown = {(r.part_id, r.column) for r in ci.unknown_columns(written, names).collect()}
    order = list(CASES)
    assert unknown == {(order.index("unknown column"), "L9_S9_F9"), (order.index("token"), "L9_S9_D9")}


def test_misquoted_large_readings_are_found(spark):
    records = spark.createDataFrame([(11, "r", ["L0_S1_F2"], [("L0_S1_F2", 90000.0, 1.0, 80000.0)]), (12, "r", ["L0_S1_F2"], [("L0_S1_F2", 90000.0, 1.0, 80000.0)])],
                                    "part_id long, route string, columns array<string>, out_of_range array<struct<name:string,value:double,low:double,high:double>>")
    names = spark.createDataFrame([("L0_S1_F2",)], "name string")
    found = ci.validate_dispositions(records.select("part_id"), dispositions(records), records, names)
    wrong = "out_of_range: L0_S1_F2 is quoted with other values"
    assert {r.part_id: wrong in r.errors for r in found.collect()} == {11: True, 12: False}


def test_train_readings_are_cut_before_they_are_long(spark, tables, monkeypatch):
    splits = spark.createDataFrame([(1, "train"), (2, "validation")], "Id long, split string")
    monkeypatch.setattr(queries.b, "numeric", lambda spark, folder: tables["numeric"])
    monkeypatch.setattr(queries.b, "split_table", lambda spark, folder: splits)
    long = queries.train_long(spark, "")
    assert {r.Id for r in long.collect()} == {1}
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # the join lies below: it moves a row a part


def test_top_gain(spark):
    gains = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("route_code", 9.0)], "feature string, gain double")
    assert [r.feature for r in ev.top_gain(gains, 2, exclude=["route_code"]).collect()] == ["b", "c"]
