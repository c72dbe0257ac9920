"""Review queue, evidence, neighbours and citation checks over all orders of the validation split."""

from __future__ import annotations

from pyspark.sql import functions as F

from partflow.operators import citations as ci, evidence as ev, neighbours as nb, stations as st
from partflow.operators.cost import build_policy
from partflow.operators.splits import split_view, start_times
from partflow.queries import bindings as b
from partflow.queries.registry import Query
from partflow.queries.sqlparts import policy_sql
from partflow.session import materialized, scratch_path
from partflow.sources.catalog import column_catalog, measurements_long

K = 20
NEAR = ["elapsed", "n_stations", "L0_span", "L0_S1_num_max", "L1_S5_num_max"]


def validation(spark, folder):
    return b.split_scores(spark, folder, "validation")


def policy(spark, folder):
    return materialized(build_policy(validation(spark, folder), b.COSTS))


def queue(spark, folder):
    return materialized(ev.band_parts(validation(spark, folder), policy(spark, folder)))


def ordered_queue(spark, folder):
    return ev.review_queue(validation(spark, folder), policy(spark, folder))


def train_long(spark, folder):
    """The train readings. Wide rows meet the split: a reading a row is many times as much to move."""
    return measurements_long(b.train_numeric(spark, folder), "numeric")


def written(spark, folder):
    """Parts with a write-up, as far as the queue page cares."""
    return b.scores(spark, folder).where("pmod(id, 3) = 0").select(F.col("id").alias("part_id"))


def evidence(spark, folder):
    f, band = b.route_table(spark, folder), policy(spark, folder)
    parts = materialized(ev.band_parts(validation(spark, folder), band))
    ids = parts.select(F.col("part_id").alias("Id")).hint("merge")
    queued = lambda kind, table: measurements_long(table.join(ids, "Id", "left_semi"), kind)  # noqa: E731 - wide rows move, not single readings
    return ev.part_evidence(parts, queued("numeric", b.numeric(spark, folder)), queued("date", b.dates(spark, folder)), f,
                            ev.normal_ranges(train_long(spark, folder), exact=True), band)


def e3(spark, folder):
    entry = lambda e: F.concat_ws(":", e["name"], e["value"].cast("string"), e["low"].cast("string"), e["high"].cast("string"))
    return evidence(spark, folder).select(
        "part_id", "score", "route", "measurements_present", F.array_join(F.transform("out_of_range", entry), ",").alias("out_of_range"),
        F.array_join("columns", ",").alias("columns"), F.col("policy_band")[0].alias("band_low"), F.col("policy_band")[1].alias("band_high"))


def dispositions(records):
    """Write-ups derived from the records, a fixed share of them with fabricated content."""
    n = F.col("part_id")
    first = F.coalesce(F.try_element_at("columns", F.lit(1)), F.lit("L0_S1_F1"))
    reason = (F.when(n % 17 == 0, F.lit(None).cast("string")).when(n % 7 == 0, F.concat(F.lit("see L9_S9_F9 and "), first))
              .when(n % 7 == 1, F.lit("late at L2_S7_D2")).otherwise(F.concat(F.lit("reading "), first)))
    wrong = lambda v: v + 1 + F.abs(v) / 100  # noqa: E731 - a quote may be off by one in ten thousand, so one more is no error in a large value
    shifted = F.transform("out_of_range", lambda e: F.struct(
        e["name"].alias("column"), F.when(n % 11 == 0, wrong(e["value"])).otherwise(e["value"]).alias("value"), e["low"].alias("low"), e["high"].alias("high")))
    kinds = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    base = F.array(kinds("column", first), kinds("part", n.cast("string")))
    extra = (F.when(n % 5 == 0, F.array(kinds("part", F.lit("999999999999")))).when(n % 5 == 1, F.array(kinds("web", F.lit("x"))))
             .otherwise(F.array().cast("array<struct<kind:string,value:string>>")))
    choice = F.when(n % 10 == 0, "rework").when(n % 2 == 0, "ship").otherwise("scrap")
    return records.where(n % 13 != 0).select(
        "part_id", F.struct(F.col("route").alias("route"), choice.alias("recommendation"), reason.alias("reason"), shifted.alias("out_of_range"),
                            F.lit("no neighbour failed").alias("neighbor_summary"), F.concat(base, extra).alias("citations")).alias("disposition"),
        F.col("columns").alias("allowed_columns"), F.array(n).alias("allowed_part_ids"))


def schema_columns(spark, folder):
    t = b.wide(spark, folder)
    out = None
    for kind, frame in t.items():
        one = column_catalog(frame, kind)
        out = one if out is None else out.unionByName(one)
    return out


def e6(spark, folder):
    records = materialized(evidence(spark, folder))
    checked = ci.validate_dispositions(records.select("part_id"), dispositions(records), records, schema_columns(spark, folder))
    return checked.select("part_id", "status", "recommendation", F.array_join("errors", "; ").alias("errors"))


def j11(spark, folder):
    records = materialized(evidence(spark, folder))
    return ci.unknown_columns(dispositions(records), schema_columns(spark, folder))


def near_features(spark, folder):
    """Only the columns that are compared, computed from the wide tables; no feature table is written for them."""
    return st.timed_features(b.numeric(spark, folder), b.dates(spark, folder)).select("Id", "Response", "route", *NEAR)


def matches(spark, folder):
    f, s = materialized(near_features(spark, folder)), b.split_table(spark, folder)
    train = split_view(f, s, "train").select(F.col("Id").alias("id"), F.col("Response").alias("y"), "route", *NEAR)
    parts = f.join(queue(spark, folder).select(F.col("part_id").alias("Id")), "Id", "left_semi").withColumnRenamed("Id", "part_id")
    return nb.knn_join(parts, train, NEAR, K)


def vector_matches(spark, folder):
    v = b.vectors(spark, folder)
    dims = [c for c in v.columns if c.startswith("x")]
    return nb.knn_join(v.select(F.col("id").alias("part_id"), "route", *dims), v, dims, 10)


def e4(spark, folder):
    text = F.transform("neighbours", lambda n: F.concat_ws(":", n["rank"].cast("string"), n["neighbour_id"].cast("string"), n["response"].cast("string")))
    return nb.neighbour_records(matches(spark, folder)).select("part_id", "same_route", F.array_join(text, ",").alias("neighbours"), "failed", "k")


def o5(spark, folder):
    """The ten orders of each customer closest to the customer's mean price, through the same top-k.

    The mean of two orders often lies half way between cents, and its rounding tells which of them is closer. It is rounded
    as in SQL, where the double times 100 is; Spark's own round to two digits takes the digits that the double prints. Three
    prices or more, in whole cents, are added as such, so that the order of addition decides nothing.
    """
    o, price = b.table(spark, folder, "orders"), F.col("o_totalprice")
    cents = F.round(price * 100)
    average = F.when((F.count(price) > 2) & F.every(price == cents / 100), F.sum(cents) / 100 / F.count(price)).otherwise(F.avg(price))
    mean = o.groupBy("o_custkey").agg((F.round(average * 100) / 100).alias("m"))
    pairs = o.join(mean, "o_custkey").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"),
                                             F.pow(F.round(F.abs(F.col("o_totalprice") - F.col("m")), 2), 2).alias("d2"))
    return nb.k_nearest(pairs, 10).select("qid", "id", "rank")


def a9(spark, folder):
    return nb.column_moments(split_view(near_features(spark, folder), b.split_table(spark, folder), "train"), NEAR)


def a8_approx(spark, folder):
    """The sketch per column; its rank error against the exact ranges is checked in the tests."""
    return ev.normal_ranges(train_long(spark, folder))


def a8_days(spark, folder):
    """Sketches a day and column, stored and merged; the ends of the ranges are within 0.5 % of their ranks."""
    long = train_long(spark, folder).join(start_times(b.dates(spark, folder)).select("Id", F.coalesce(F.floor(F.col("min_ts") / 100), F.lit(-1)).alias("day")), "Id")
    path = scratch_path(spark, "range-sketches")
    ev.append_sketches(ev.range_sketches(long), path)
    errors = ev.rank_errors(long, ev.sketched_ranges(spark.read.parquet(path)))
    return errors.select("name", (F.col("low_error") <= 0.005).alias("low_within"), (F.col("high_error") <= 0.005).alias("high_within"))


def f4(spark, folder):
    return ev.out_of_range(measurements_long(b.numeric(spark, folder), "numeric"), ev.normal_ranges(train_long(spark, folder), exact=True))


def e2(spark, folder):
    return ev.open_queue(queue(spark, folder), b.decisions(spark, folder), written(spark, folder), 100)


def j7(spark, folder):
    return ev.undecided(queue(spark, folder), b.decisions(spark, folder))


def e5(spark, folder):
    return ev.queue_membership(b.parts(spark, folder).select(F.col("Id").alias("part_id")), queue(spark, folder))


VAL = "val AS (SELECT c.* FROM scores c JOIN splits s ON s.Id = c.id WHERE split = 'validation')"
QUEUE = f"{VAL}, {policy_sql(b.COSTS, 'val')}, queue AS (SELECT id AS part_id, p AS score FROM val, policy WHERE p >= band_low AND p < band_high)"
RANGES = ("ranges AS (SELECT name, quantile_disc(value, CAST(0.01 AS DOUBLE)) AS low, quantile_disc(value, CAST(0.99 AS DOUBLE)) AS high FROM numlong "
          "WHERE Id IN (SELECT Id FROM splits WHERE split = 'train') GROUP BY name)")
EVIDENCE = ("ev AS (SELECT q.part_id, q.score, r.route, coalesce(n.present, 0) AS measurements_present, coalesce(n.oor, '') AS out_of_range, "
            "concat_ws(',', n.cols, d.cols) AS columns, band_low, band_high, coalesce(n.outside, []) AS outside FROM queue q JOIN routes r ON r.Id = q.part_id LEFT JOIN "
            "(SELECT Id, count(*) AS present, string_agg(name, ',' ORDER BY name) AS cols, string_agg(name || ':' || round(value, 6) || ':' || round(low, 6) || ':' || round(high, 6), ',' "
            "ORDER BY name) FILTER (value < low OR value > high) AS oor, list(name ORDER BY name) FILTER (value < low OR value > high) AS outside FROM numlong JOIN ranges USING (name) GROUP BY Id) n ON n.Id = q.part_id "
            "LEFT JOIN (SELECT Id, string_agg(name, ',' ORDER BY name) AS cols FROM datlong GROUP BY Id) d ON d.Id = q.part_id, policy)")
FIRST = "CASE WHEN columns = '' THEN 'L0_S1_F1' ELSE split_part(columns, ',', 1) END"
NOT_RETURNED = "|| ' is missing from the part record'"
ERRORS = (f"errs AS (SELECT *, {FIRST} AS first_column FROM ev), judged AS (SELECT part_id, part_id % 13 = 0 AS absent, "
          "CASE WHEN part_id % 17 = 0 THEN ['left out: reason'] ELSE list_filter(list_concat(["
          "CASE WHEN part_id % 10 = 0 THEN 'recommendation rework is none of the choices' END, "
          f"CASE WHEN columns = '' THEN 'citation: column ' || first_column {NOT_RETURNED} END, "
          "CASE WHEN part_id % 5 = 0 THEN 'citation: part 999999999999 came from no tool result' WHEN part_id % 5 = 1 THEN 'citation: no such kind web' END], "
          "CASE WHEN part_id % 11 = 0 THEN list_transform(outside, lambda x: 'out_of_range: ' || x || ' is quoted with other values') ELSE [] END, ["
          "CASE WHEN part_id % 7 = 0 AND columns = '' THEN 'reason: column ' || first_column || ' is missing from the part record' END, "
          "CASE WHEN part_id % 7 = 0 THEN 'reason: column L9_S9_F9 names no column of the tables' WHEN part_id % 7 = 1 THEN CASE WHEN NOT contains(columns, 'L2_S7_D2') "
          f"THEN 'reason: column L2_S7_D2' {NOT_RETURNED} END WHEN columns = '' THEN 'reason: column ' || first_column {NOT_RETURNED} END]), lambda x: x IS NOT NULL) END AS errors FROM errs)")


def knn_sql(source_train: str, source_queue: str, dims: list[str], k: int) -> str:
    """Brute force: every queued part against every train part it may be compared with."""
    moments = ", ".join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s{i}" for i, c in enumerate(dims))
    z = ", ".join(f"coalesce((CAST({c} AS DOUBLE) - m{i}) / s{i}, 0) AS z{i}" for i, c in enumerate(dims))
    d2 = " + ".join(f"(t.z{i} - q.z{i}) * (t.z{i} - q.z{i})" for i in range(len(dims)))
    return (f"mom AS (SELECT {moments} FROM {source_train}), tz AS (SELECT id, y, route, {z} FROM {source_train}, mom), "
            f"sizes AS (SELECT route, count(*) AS n FROM {source_train} GROUP BY route), "
            f"qz AS (SELECT part_id, q.route, coalesce(n, 0) AS n, {z} FROM {source_queue} q LEFT JOIN sizes ON sizes.route = q.route, mom), "
            f"ranked AS (SELECT q.part_id, t.id AS neighbour_id, CAST(t.y AS INTEGER) AS response, sqrt({d2}) AS distance, "
            f"q.n >= {k} AND q.n < (SELECT count(*) FROM tz) AS same_route, "
            f"CAST(row_number() OVER (PARTITION BY q.part_id ORDER BY round(sqrt({d2}), 9), t.id) AS INTEGER) AS rank "
            f"FROM qz q JOIN tz t ON q.route = t.route OR q.n < {k}), "
            f"knn AS (SELECT part_id, neighbour_id, response, round(distance, 4) AS distance, rank, same_route FROM ranked WHERE rank <= {k})")


NEAR_CTES = ("near AS (SELECT p.Id, p.Response, r.route, max(d2) - min(d1) AS elapsed, count(v.Id) AS n_stations, max(d2) FILTER (line = 0) - min(d1) FILTER (line = 0) AS L0_span, "
             "max(greatest(f1, f2, f3)) FILTER (station = 1) AS L0_S1_num_max, max(greatest(f1, f2, f3)) FILTER (station = 5) AS L1_S5_num_max "
             "FROM parts p JOIN routes r ON r.Id = p.Id LEFT JOIN visits v ON v.Id = p.Id GROUP BY p.Id, p.Response, r.route), "
             "ntrain AS (SELECT Id AS id, Response AS y, * EXCLUDE (Id, Response) FROM near WHERE Id IN (SELECT Id FROM splits WHERE split = 'train')), "
             "nqueue AS (SELECT Id AS part_id, * EXCLUDE (Id) FROM near WHERE Id IN (SELECT part_id FROM queue)), " + knn_sql("ntrain", "nqueue", NEAR, K))
VEC = ("vqueue AS (SELECT id AS part_id, * EXCLUDE (id, y) FROM vectors), " + knn_sql("vectors", "vqueue", [f"x{i}" for i in range(64)], 10))
NAMES = "scores splits visits routes parts"

QUERIES = [
    Query("A8_normal_ranges", lambda s, d: ev.normal_ranges(train_long(s, d), exact=True), b.with_ctes("numlong splits", "SELECT * FROM ranges", RANGES)),
    Query("A8_normal_ranges_sketch", a8_approx),
    Query("A8_normal_ranges_by_day", a8_days, b.with_ctes("numlong splits", "SELECT name, true AS low_within, true AS high_within FROM ranges", RANGES)),
    Query("A9_column_moments", a9, b.with_ctes(NAMES, " UNION ALL ".join(f"SELECT '{c}' AS name, avg({c}) AS mean, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS std FROM ntrain" for c in NEAR),
                                          QUEUE + ", " + NEAR_CTES), ["mean", "std"]),
    Query("E1_review_queue", ordered_queue, b.with_ctes("scores splits", "SELECT * FROM queue", QUEUE)),
    Query("O3_queue_order", lambda s, d: ev.queue_order(b.scores(s, d)), b.with_ctes("scores", "SELECT * FROM scores ORDER BY p DESC, id")),
    Query("E2_open_queue", e2,
          b.with_ctes("scores splits decisions", "SELECT part_id, score, part_id % 3 = 0 AS has_disposition, (SELECT count(*) FROM o) AS total, "
                      "(SELECT count(DISTINCT part_id) FROM decisions) AS decided FROM o ORDER BY score DESC, part_id LIMIT 100",
                      QUEUE + ", o AS (SELECT * FROM queue WHERE part_id NOT IN (SELECT part_id FROM decisions))")),
    Query("J7_undecided", j7, b.with_ctes("scores splits decisions", "SELECT * FROM queue WHERE part_id NOT IN (SELECT part_id FROM decisions)", QUEUE)),
    Query("E3_part_evidence", e3, b.with_ctes("numlong datlong routes scores splits", "SELECT * EXCLUDE (outside) FROM ev", f"{QUEUE}, {RANGES}, {EVIDENCE}")),
    Query("F4_out_of_range", f4, b.with_ctes("numlong splits", "SELECT Id, line, station, name, value, low, high FROM numlong JOIN ranges USING (name) WHERE value < low OR value > high", RANGES)),
    Query("E4_neighbours", e4,
          b.with_ctes(NAMES, "SELECT part_id, same_route, string_agg(rank || ':' || neighbour_id || ':' || response, ',' ORDER BY rank) AS neighbours, "
                             "CAST(sum(response) AS BIGINT) AS failed, count(*) AS k FROM knn GROUP BY part_id, same_route", f"{QUEUE}, {NEAR_CTES}")),
    Query("J6_knn_join", matches, b.with_ctes(NAMES, "SELECT * FROM knn", f"{QUEUE}, {NEAR_CTES}"), ["distance"]),
    Query("J6_knn_join_embeddings", vector_matches, b.with_ctes("vectors", "SELECT * FROM knn", VEC), ["distance"]),
    Query("A11_failed_neighbours", lambda s, d: nb.failed_neighbours(matches(s, d)),
          b.with_ctes(NAMES, "SELECT part_id, same_route, CAST(sum(response) AS BIGINT) AS failed, count(*) AS k FROM knn GROUP BY part_id, same_route", f"{QUEUE}, {NEAR_CTES}")),
    Query("W8_O5_k_nearest", o5,
          "SELECT qid, id, CAST(rank AS INTEGER) AS rank FROM (SELECT o.o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o.o_custkey ORDER BY "
          "round(sqrt(pow(round(abs(o_totalprice - m), 2), 2)), 9), o_orderkey) AS rank FROM orders o JOIN (SELECT o_custkey, round(avg(o_totalprice), 2) AS m FROM orders GROUP BY o_custkey) t "
          "ON t.o_custkey = o.o_custkey) WHERE rank <= 10"),
    Query("E5_queue_membership", e5, b.with_ctes("scores splits", "SELECT Id AS part_id, 'not in the review queue' AS error FROM parts WHERE Id NOT IN (SELECT part_id FROM queue)", QUEUE)),
    Query("E6_validate_dispositions", e6,
          b.with_ctes("numlong datlong routes scores splits", "SELECT part_id, CASE WHEN absent THEN 'missing' WHEN len(errors) > 0 THEN 'rejected' ELSE 'valid' END AS status, "
                      "CASE WHEN NOT absent AND len(errors) = 0 THEN CASE WHEN part_id % 2 = 0 THEN 'ship' ELSE 'scrap' END ELSE 'senior_review' END AS recommendation, "
                      "CASE WHEN absent THEN '' ELSE array_to_string(errors, '; ') END AS errors FROM judged", f"{QUEUE}, {RANGES}, {EVIDENCE}, {ERRORS}")),
    Query("J11_citation_anti_join", j11,
          b.with_ctes("numlong datlong routes scores splits", "SELECT part_id, 'reason' AS \"where\", 'L9_S9_F9' AS \"column\" FROM ev WHERE part_id % 7 = 0 AND part_id % 13 <> 0 AND part_id % 17 <> 0",
                      f"{QUEUE}, {RANGES}, {EVIDENCE}")),
]
