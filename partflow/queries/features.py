"""Station, line and part features, categorical selection and codes over all orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from partflow.functions import columns as fc
from partflow.operators import encoding as en, stations as st
from partflow.operators.evidence import normal_ranges
from partflow.operators.splits import split_view
from partflow.operators.sandbox import align_labels
from partflow.queries import bindings as b
from partflow.queries.registry import Query
from partflow.queries.sqlparts import hash_sql
from partflow.session import materialized
from partflow.sources.catalog import measurements_long

S = b.STATIONS
NUM = {b.station(s): [f"{b.station(s)}_F{n}" for n in ((1, 2, 3) if s < 7 else (1,))] for s in S}
DAT = {b.station(s): [f"{b.station(s)}_D{n}" for n in (1, 2)] for s in S}
CAT = {b.station(s): [f"{b.station(s)}_F{n}" for n in (4, 5)] for s in S}
LINES = {f"L{x}": [s for s in DAT if s.startswith(f"L{x}_")] for x in range(3)}


def least(cols):
    return cols[0] if len(cols) == 1 else f"least({', '.join(cols)})"


def greatest(cols):
    return cols[0] if len(cols) == 1 else f"greatest({', '.join(cols)})"


def present(cols):
    return " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)


def flat(groups):
    return [c for cols in groups.values() for c in cols]


START = least(flat(DAT))
NUM_SQL = ", ".join(f"{least(c)} AS {s}_num_min, {greatest(c)} AS {s}_num_max, {greatest(c)} - {least(c)} AS {s}_num_range, "
                    f"{len(c)} - ({present(c)}) AS {s}_num_missing" for s, c in NUM.items())
TIMING_SQL = ", ".join(f"{greatest(c)} - {least(c)} AS {s}_dwell, {least(c)} - {START} AS {s}_arrival" for s, c in DAT.items())
LINE_SQL = ", ".join(f"{greatest(flat({x: DAT[x] for x in ss}))} - {least(flat({x: DAT[x] for x in ss}))} AS {line}_span, "
                     f"{least(flat({x: DAT[x] for x in ss}))} - {START} AS {line}_arrival" for line, ss in LINES.items())
PART_SQL = (f"{greatest(flat(DAT))} - {START} AS elapsed, " + " + ".join(f"CAST({greatest(c)} IS NOT NULL AS INTEGER)" for c in DAT.values())
            + f" AS n_stations, {START} AS start_ts")
CODE_SQL = ", ".join(f"CASE WHEN regexp_matches({c}, '^[A-Za-z]-?[0-9]{{1,19}}$') THEN TRY_CAST(substr({c}, 2) AS BIGINT) END AS cat_{c}" for c in flat(CAT))
COUNT_SQL = ", ".join(f"{present(c)} AS {s}_cat_count" for s, c in CAT.items())
ROUTE_SQL = "concat_ws('-', " + ", ".join(f"CASE WHEN {greatest(NUM[s])} IS NOT NULL OR {greatest(DAT[s])} IS NOT NULL THEN '{s}' END" for s in DAT) + ")"
ALL_SQL = f"SELECT Id, Response, {NUM_SQL}, {TIMING_SQL}, {LINE_SQL}, {PART_SQL}, {CODE_SQL}, {COUNT_SQL}, {ROUTE_SQL} AS route FROM num JOIN dat USING (Id) JOIN cat USING (Id)"


def number_long(spark, folder):
    return measurements_long(b.numeric(spark, folder), "numeric")


def date_visits(spark, folder):
    return st.station_visits(measurements_long(b.dates(spark, folder), "date"))


def p1_long(spark, folder):
    sizes = spark.createDataFrame([((s - 1) // 3, s, 3 if s < 7 else 1) for s in S], "line int, station int, columns int")
    return st.station_numeric_long(number_long(spark, folder), sizes)


def p2(spark, folder):
    t = b.wide(spark, folder)
    joined = t["numeric"].join(t["date"], "Id").join(t["categorical"], "Id")
    return joined.select("Id", fc.present_count(b.numeric_columns()).alias("n_numeric"), fc.present_count(b.date_columns()).alias("n_date"),
                         fc.present_count(b.categorical_columns()).alias("n_categorical"))


def p8_long(spark, folder):
    seen = number_long(spark, folder).select("Id", "line", "station").unionByName(
        measurements_long(b.dates(spark, folder), "date").select("Id", "line", "station"))
    return st.route_long(b.parts(spark, folder), seen)


def p9(spark, folder):
    d = b.dates(spark, folder)
    return d.select("Id", fc.least_of(fc.columns_like(d, r"^L1_S[0-9]+_D[0-9]+$")).alias("line1_start"))


def p12(spark, folder):
    n = b.numeric(spark, folder)
    return n.select("Id", fc.presence_pattern(b.numeric_columns())[0].alias("pattern"), fc.first_present(b.numeric_columns()).alias("first_column"))


def routes(spark, folder):
    return b.parts(spark, folder).join(b.route_table(spark, folder).hint("merge"), "Id")


def train_routes(spark, folder):
    return split_view(routes(spark, folder), b.split_table(spark, folder), "train")


def p15(spark, folder):
    train = measurements_long(b.train_numeric(spark, folder), "numeric")
    return st.out_of_range_by_station(b.numeric(spark, folder), materialized(normal_ranges(train, exact=True)))


def a5(spark, folder):
    train = split_view(b.categorical(spark, folder), b.split_table(spark, folder), "train")
    return en.select_categorical(train, en.count_of_share(train))


def a5_three(spark, folder):
    train = split_view(b.categorical(spark, folder), b.split_table(spark, folder), "train")
    return en.select_categorical(train, 100, min_distinct=4)


def j3(spark, folder):
    codes = en.fit_codes(train_routes(spark, folder), "route", 50)
    return en.apply_codes(routes(spark, folder), codes, "route").select("Id", "route", "route_code")


def g7(spark, folder):
    """A text column and a numeric one, codes fitted on train and applied to validation."""
    t = routes(spark, folder).join(b.dates(spark, folder).select("Id", F.col("L0_S1_D1").alias("when")), "Id").drop("Response")
    s = b.split_table(spark, folder)
    _, (valid,) = en.encode(split_view(t, s, "train"), [split_view(t, s, "validation")], 50)
    return valid.select("Id", F.col("route").cast("long").alias("route"), F.col("when").cast("double").alias("when"))


def j8(spark, folder):
    frame = b.dates(spark, folder).select("Id", "L0_S1_D1")
    return align_labels(frame, b.parts(spark, folder))


RANGES = "ranges AS (SELECT name, quantile_disc(value, CAST(0.01 AS DOUBLE)) AS low, quantile_disc(value, CAST(0.99 AS DOUBLE)) AS high FROM numlong WHERE Id IN (SELECT Id FROM splits WHERE split = 'train') GROUP BY name)"
CODES = ("freq AS (SELECT route, count(*) AS n FROM routes WHERE Id IN (SELECT Id FROM splits WHERE split = 'train') GROUP BY route), "
         "codes AS (SELECT route, n, row_number() OVER (ORDER BY n DESC, route) AS route_code FROM freq WHERE n >= 50)")
BOUND = " ".join("num dat cat".split())
STEP = "'L' || line || '_S' || station"

QUERIES = [
    Query("P1_station_numeric", lambda s, d: st.station_numeric(b.numeric(s, d)), b.with_ctes("num", f"SELECT Id, Response, {NUM_SQL} FROM num"),
          [f"{s}_num_range" for s in NUM]),
    Query("P1_station_numeric_long", p1_long,
          b.with_ctes("numlong", "SELECT Id, line, station, min(value) AS num_min, max(value) AS num_max, max(value) - min(value) AS num_range, "
                                 "(CASE WHEN station < 7 THEN 3 ELSE 1 END) - count(*) AS num_missing FROM numlong GROUP BY Id, line, station"), ["num_range"]),
    Query("P2_present_count", p2, b.with_ctes(BOUND, f"SELECT Id, {present(flat(NUM))} AS n_numeric, {present(flat(DAT))} AS n_date, {present(flat(CAT))} AS n_categorical "
                                                     "FROM num JOIN dat USING (Id) JOIN cat USING (Id)")),
    Query("P3_station_timing", lambda s, d: st.station_timing(b.dates(s, d)), b.with_ctes("dat", f"SELECT Id, {TIMING_SQL} FROM dat")),
    Query("P3_station_timing_long", lambda s, d: st.station_timing_long(date_visits(s, d)),
          b.with_ctes("visits", "SELECT Id, line, station, d2 - d1 AS dwell, d1 - min(d1) OVER (PARTITION BY Id) AS arrival FROM visits")),
    Query("P4_line_timing", lambda s, d: st.line_timing(b.dates(s, d)), b.with_ctes("dat", f"SELECT Id, {LINE_SQL} FROM dat")),
    Query("P4_line_timing_long", lambda s, d: st.line_timing_long(date_visits(s, d)),
          b.with_ctes("visits", "SELECT Id, line, max(d2) - min(d1) AS span, min(d1) - min(min(d1)) OVER (PARTITION BY Id) AS arrival FROM visits GROUP BY Id, line")),
    Query("P5_part_timing", lambda s, d: st.part_timing(b.dates(s, d)), b.with_ctes("dat", f"SELECT Id, {PART_SQL} FROM dat")),
    Query("P5_part_timing_long", lambda s, d: st.part_timing_long(date_visits(s, d)),
          b.with_ctes("visits", "SELECT Id, max(d2) - min(d1) AS elapsed, count(*) AS n_stations, min(d1) AS start_ts FROM visits GROUP BY Id")),
    Query("P6_category_codes", lambda s, d: st.category_codes(b.categorical(s, d), b.categorical_columns()), b.with_ctes("cat", f"SELECT Id, {CODE_SQL} FROM cat")),
    Query("P7_category_counts", lambda s, d: st.category_counts(b.categorical(s, d)), b.with_ctes("cat", f"SELECT Id, {COUNT_SQL} FROM cat")),
    Query("P8_route", lambda s, d: st.part_routes(b.numeric(s, d), b.dates(s, d)), b.with_ctes("num dat", f"SELECT Id, {ROUTE_SQL} AS route FROM num JOIN dat USING (Id)")),
    Query("P8_route_long", p8_long, b.with_ctes("routes", "SELECT * FROM routes")),
    Query("P9_columns_like", p9, b.with_ctes("dat", "SELECT Id, least(*COLUMNS('^L1_S[0-9]+_D[0-9]+$')) AS line1_start FROM dat")),
    Query("P10_drop_label_and_id", lambda s, d: fc.without(b.numeric(s, d), "Id", "Response"), b.with_ctes("num", "SELECT * EXCLUDE (Id, Response) FROM num")),
    Query("P11_transition_gap", lambda s, d: b.dates(s, d).select("Id", fc.transition_gap(DAT["L0_S1"], DAT["L0_S2"]).alias("gap")),
          b.with_ctes("dat", f"SELECT Id, {least(DAT['L0_S2'])} - {greatest(DAT['L0_S1'])} AS gap FROM dat")),
    Query("P11_transition_gap_long", lambda s, d: st.transition_gaps_long(date_visits(s, d)),
          b.with_ctes("visits", f"SELECT Id, from_station, to_station, gap FROM (SELECT Id, {STEP} AS from_station, lead({STEP}) OVER w AS to_station, "
                                "lead(d1) OVER w - d2 AS gap FROM visits WINDOW w AS (PARTITION BY Id ORDER BY station)) WHERE to_station IS NOT NULL")),
    Query("P12_presence_pattern", p12,
          b.with_ctes("num", "SELECT Id, " + " + ".join(f"CAST({c} IS NOT NULL AS BIGINT) * {1 << i}" for i, c in enumerate(flat(NUM))) + " AS pattern, CASE "
                      + " ".join(f"WHEN {c} IS NOT NULL THEN '{c}'" for c in flat(NUM)) + " END AS first_column FROM num")),
    Query("P13_normalised_spread", lambda s, d: b.numeric(s, d).select("Id", *[fc.normalised_spread(c).alias(f"{s_}_ns") for s_, c in NUM.items()]),
          b.with_ctes("num", "SELECT Id, " + ", ".join(f"({greatest(c)} - {least(c)}) / nullif({present(c)}, 0) AS {s_}_ns" for s_, c in NUM.items()) + " FROM num"),
          [f"{s_}_ns" for s_ in NUM]),
    Query("P14_measurements_long", number_long, b.with_ctes("numlong", "SELECT * FROM numlong")),
    Query("P15_out_of_range_count", p15,
          b.with_ctes("numlong splits", "SELECT Id, line, station, count(*) FILTER (value < low OR value > high) AS out_of_range FROM numlong JOIN ranges USING (name) "
                                        "GROUP BY Id, line, station", RANGES)),
    Query("P16_route_failure_rate_oof", lambda s, d: st.route_failure_rate_oof(routes(s, d)),
          b.with_ctes("routes", "SELECT Id, route, fold, CASE WHEN n > fn THEN CAST(bad - fbad AS DOUBLE) / (n - fn) END AS route_failure_rate FROM ("
                                "SELECT Id, route, fold, sum(Response) OVER (PARTITION BY route) AS bad, count(*) OVER (PARTITION BY route) AS n, "
                                "sum(Response) OVER (PARTITION BY route, fold) AS fbad, count(*) OVER (PARTITION BY route, fold) AS fn FROM f)",
                      f"f AS (SELECT r.Id, route, Response, CAST({hash_sql('r.Id', '17')} % 5 AS INTEGER) AS fold FROM routes r JOIN parts p ON p.Id = r.Id)"), ["route_failure_rate"]),
    Query("G1_build_features", b.features, b.with_ctes(BOUND, ALL_SQL), [f"{s}_num_range" for s in NUM]),
    Query("J2_join_features", lambda s, d: st.join_features(*b.dealt_wide(s, d).values()), b.with_ctes(BOUND, "SELECT * FROM num JOIN dat USING (Id) JOIN cat USING (Id)")),
    Query("A4_column_coverage", lambda s, d: en.column_coverage(b.numeric(s, d)),
          b.with_ctes("num", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS present, CAST(count({c}) AS DOUBLE) / count(*) AS share FROM num" for c in flat(NUM))), ["share"]),
    Query("A5_select_categorical", a5,
          b.with_ctes("catlong splits", "SELECT name, count(*) AS present FROM catlong WHERE Id IN (SELECT Id FROM splits WHERE split = 'train') GROUP BY name "
                                        "HAVING count(*) >= (SELECT greatest(1, CAST(floor(count(*) * CAST(0.0001 AS DOUBLE)) AS BIGINT)) FROM splits WHERE split = 'train') AND count(DISTINCT value) >= 2")),
    Query("A5_select_categorical_min_distinct", a5_three,
          b.with_ctes("catlong splits", "SELECT name, count(*) AS present FROM catlong WHERE Id IN (SELECT Id FROM splits WHERE split = 'train') GROUP BY name "
                                        "HAVING count(*) >= 100 AND count(DISTINCT value) >= 4")),
    Query("A6_route_frequency", lambda s, d: en.value_frequency(train_routes(s, d), "route"), b.with_ctes("routes splits", "SELECT route, n FROM freq", CODES)),
    Query("A7_fit_codes", lambda s, d: en.fit_codes(train_routes(s, d), "route", 50), b.with_ctes("routes splits", "SELECT * FROM codes", CODES)),
    Query("W1_rank_codes", lambda s, d: en.rank_codes(en.value_frequency(routes(s, d), "route"), "route", "code"),
          b.with_ctes("routes", "SELECT route, n, row_number() OVER (ORDER BY n DESC, route) AS code FROM (SELECT route, count(*) AS n FROM routes GROUP BY route)")),
    Query("J3_apply_codes", j3, b.with_ctes("routes splits", "SELECT Id, route, coalesce(route_code, 0) AS route_code FROM routes LEFT JOIN codes USING (route)", CODES)),
    Query("G7_encode", g7,
          b.with_ctes("routes splits dat", "SELECT r.Id, coalesce(route_code, 0) AS route, d.L0_S1_D1 AS \"when\" FROM routes r JOIN dat d ON d.Id = r.Id LEFT JOIN codes USING (route) "
                                           "WHERE r.Id IN (SELECT Id FROM splits WHERE split = 'validation')", CODES)),
    Query("J8_align_labels", j8, b.with_ctes("dat", "SELECT dat.Id, L0_S1_D1, Response FROM dat JOIN parts ON parts.Id = dat.Id")),
]
