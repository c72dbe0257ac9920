import pytest
from pyspark.sql import functions as F

from partflow.functions import columns as fc
from partflow.operators import encoding as en, stations as st
from partflow.sources.catalog import by_station, column_catalog, measurements_long


def by_id(df):
    return {r.Id: r for r in df.collect()}


def test_feature_values_by_hand(tables):
    f = by_id(st.build_features(tables["numeric"], tables["date"], tables["categorical"], ["L0_S0_F4"]))
    one = f[1]
    assert (one.L0_S0_num_min, one.L0_S0_num_max, one.L0_S0_num_range, one.L0_S0_num_missing) == (1.25, 4.0, 2.75, 0)
    assert (one.start_ts, one.elapsed, one.n_stations, one.L0_S0_dwell, one.L1_S24_arrival) == (3.0, 5.0, 2, 5.0, 2.5)
    assert (one.L0_span, one.L1_span, one.L1_arrival) == (5.0, 0.0, 2.5)
    assert {i: r.route for i, r in f.items()} == {1: "L0_S0-L1_S24", 2: "L0_S0", 3: "L1_S24", 4: ""}
    assert (f[2].L0_S0_num_missing, f[2].L0_S0_num_min, f[2].L0_S0_dwell, f[3].L1_S24_num_range) == (1, 2.5, 0.0, 0.0)
    assert (f[4].start_ts, f[4].elapsed, f[4].n_stations) == (None, None, 0)
    assert ([f[i].cat_L0_S0_F4 for i in (1, 2, 3)], [f[i].L1_S24_cat_count for i in (1, 2, 3)]) == ([40, 7, None], [0, 1, 1])


def test_long_form_agrees_with_wide_form(spark, tables):
    long = measurements_long(tables["numeric"], "numeric")
    sizes = column_catalog(tables["numeric"], "numeric").groupBy("line", "station").agg(F.count(F.lit(1)).alias("columns"))
    wide = by_id(st.station_numeric(tables["numeric"]))
    for r in st.station_numeric_long(long, sizes).collect():
        s = f"L{r.line}_S{r.station}"
        assert (r.num_min, r.num_max, r.num_range, r.num_missing) == tuple(wide[r.Id][f"{s}_num_{k}"] for k in ("min", "max", "range", "missing"))
    visits = st.station_visits(measurements_long(tables["date"], "date"))
    timing = by_id(st.date_features(tables["date"]))
    for r in st.station_timing_long(visits).collect():
        assert (r.dwell, r.arrival) == (timing[r.Id][f"L{r.line}_S{r.station}_dwell"], timing[r.Id][f"L{r.line}_S{r.station}_arrival"])
    for r in st.line_timing_long(visits).collect():
        assert (r.span, r.arrival) == (timing[r.Id][f"L{r.line}_span"], timing[r.Id][f"L{r.line}_arrival"])
    for r in st.part_timing_long(visits).collect():
        assert (r.elapsed, r.n_stations, r.start_ts) == tuple(timing[r.Id][c] for c in ("elapsed", "n_stations", "start_ts"))
    seen = long.select("Id", "line", "station").union(measurements_long(tables["date"], "date").select("Id", "line", "station"))
    routes = by_id(st.build_features(tables["numeric"], tables["date"], tables["categorical"], []))
    assert {r.Id: r.route for r in st.route_long(tables["numeric"], seen).collect()} == {i: r.route for i, r in routes.items()}
    gaps = st.transition_gaps_long(visits).collect()
    assert [(g.Id, g.from_station, g.to_station, g.gap) for g in gaps] == [(1, "L0_S0", "L1_S24", -2.5)]


def test_wide_features_need_no_shuffle(tables):
    plan = st.date_features(tables["date"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stations_in_numeric_order():
    assert list(by_station(["Id", "L0_S10_F1", "L0_S2_F3", "L10_S0_F9", "L2_S0_F1"], "numeric")) == ["L0_S2", "L0_S10", "L2_S0", "L10_S0"]


def test_row_local_extras(spark, tables):
    n = tables["numeric"]
    cols = ["L0_S0_F0", "L0_S0_F2", "L1_S24_F1"]
    got = by_id(n.select("Id", fc.presence_pattern(cols).alias("bits"), fc.first_present(cols).alias("first"),
                         fc.normalised_spread(cols[:2]).alias("ns"), fc.present_count(cols).alias("n")))
    assert [(got[i].bits, got[i]["first"], got[i].ns, got[i].n) for i in (1, 2, 3)] == [([7], "L0_S0_F0", 1.375, 3), ([2], "L0_S0_F2", 0.0, 1), ([4], "L1_S24_F1", None, 1)]
    wide = spark.range(1).select(*[F.when(F.lit(i % 2 == 0), 1.0).alias(f"c{i}") for i in range(130)])
    words = wide.select(fc.presence_pattern(wide.columns).alias("w")).first().w
    assert [(w >> i) & 1 for w in words for i in range(63)][:130] == [1 - i % 2 for i in range(130)] and len(words) == 3
    assert fc.columns_like(n, "^L1_") == ["L1_S24_F1"]
    with pytest.raises(ValueError):
        fc.columns_like(n, "^L9_")
    codes = spark.createDataFrame([("T8",), ("T-3",), ("8.5",), ("T8.5",), ("T1e3",), (None,), ("T",)], "c string").select(fc.category_code("c")).collect()
    assert [r[0] for r in codes] == [8, -3, None, None, None, None, None]


def test_codes_by_count_then_value(spark):
    train = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("a",)], "v string")
    codes = en.fit_codes(train, "v", 1)
    assert {r.v: r.v_code for r in codes.collect()} == {"a": 1, "b": 2}
    other = spark.createDataFrame([(1, "b"), (2, "c"), (3, "a"), (4, None)], "Id long, v string")
    assert {r.Id: r.v_code for r in en.apply_codes(other, codes, "v").collect()} == {1: 2, 2: 0, 3: 1, 4: 0}


def test_route_codes_of_the_four_parts(tables):
    f = st.build_features(tables["numeric"], tables["date"], tables["categorical"], [])
    for low, want in ((2, {1: 0, 2: 0, 3: 0, 4: 0}), (1, {4: 1, 2: 2, 1: 3, 3: 4})):
        coded = en.apply_codes(f, en.fit_codes(f, "route", low), "route")
        assert {r.Id: r.route_code for r in coded.collect()} == want


def test_categorical_selection(spark):
    df = spark.createDataFrame([(i, "T1", f"T{i % 3}", "T1" if i == 0 else None) for i in range(6)],
                               "Id long, L0_S0_F1 string, L0_S0_F2 string, L0_S0_F3 string")
    assert [r.name for r in en.select_categorical(df, 2).collect()] == ["L0_S0_F2"]
    assert [r.name for r in en.select_categorical(df, 2, min_distinct=3).collect()] == ["L0_S0_F2"]
    assert en.select_categorical(df, 2, min_distinct=4).count() == 0


def test_out_of_fold_rate_excludes_the_own_fold(spark):
    parts = spark.createDataFrame([(i, i % 2, "hot" if i % 3 else "rare") for i in range(300)], "Id long, Response int, route string")
    rows = st.route_failure_rate_oof(parts, folds=4).collect()
    labels = {i: i % 2 for i in range(300)}
    for r in rows[:40]:
        others = [labels[o.Id] for o in rows if o.route == r.route and o.fold != r.fold]
        assert r.route_failure_rate == pytest.approx(sum(others) / len(others))
    assert len(rows) == 300


def test_tables_of_parts_are_never_broadcast(tables):
    features = st.build_features(tables["numeric"], tables["date"], tables["categorical"], ["L0_S0_F4"]).select("Id", "route")
    assert "Broadcast" not in features._jdf.queryExecution().executedPlan().toString()
    assert features.count() == 4


def test_routes_alone_are_those_of_the_feature_table(tables):
    whole = by_id(st.build_features(tables["numeric"], tables["date"], tables["categorical"], ["L0_S0_F4"]).select("Id", "route"))
    alone = st.part_routes(tables["numeric"], tables["date"])
    assert by_id(alone) == whole and alone.columns == ["Id", "route"]


def test_out_of_range_counts_of_wide_rows_need_no_shuffle(spark, tables):
    ranges = spark.createDataFrame([("L0_S0_F0", 1.0, 3.0), ("L0_S0_F2", 1.5, 9.0)], "name string, low double, high double")
    found = st.out_of_range_by_station(tables["numeric"], ranges)
    long = st.out_of_range_count(measurements_long(tables["numeric"], "numeric"), ranges)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, long.collect())) == [(1, 0, 0, 2), (2, 0, 0, 0)]
    rows = found._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in rows and "Aggregate" not in rows


def test_readings_are_dealt_before_they_are_reduced(spark):
    from partflow.queries import bindings as b
    from partflow.session import dealt, tasks_for

    folder = "/root/testdata/sf0.001"
    for table in (b._numeric, b._dates, b._categorical, b.starts):
        plan = table(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan.split("Exchange")[-1] and plan.count("Exchange hashpartitioning") == 2
    rows = spark.range(1000)
    assert (tasks_for(rows, 1000), tasks_for(rows, 100)) == (None, 10)
    assert dealt(rows, "id", 10).rdd.getNumPartitions() == 10


def test_all_joins_of_parts_are_dealt_by_their_rows(spark, monkeypatch):
    """With more rows than the session's own partitions take, both sides of every join move once, over as many tasks."""
    from partflow.queries import bindings as b

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(b, "tasks_for", lambda df: 7)
    t = b.dealt_wide(spark, folder)
    for frame, moves in ((st.join_features(*t.values()), 3), (b.train_numeric(spark, folder), 2)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == moves == plan.count(", 7), ")
