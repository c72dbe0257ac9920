"""Sources, sinks and audits: tables derived from the given ones are written, read back and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from partflow.operators.encoding import column_coverage
from partflow.queries import bindings as b
from partflow.queries.registry import Query
from partflow.session import scratch_path
from partflow.sources import catalog as cat, logs as lg, measurements as ms, tables as tb
from partflow.streaming.review import decision_source, drain, each_once, label_stream

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def csv_copy(spark, folder):
    path = scratch_path(spark, "numeric-csv")
    b.numeric(spark, folder).write.option("header", True).csv(path)
    return path


def s1(spark, folder):
    return ms.read_measurements(spark, csv_copy(spark, folder), "numeric")


def s2(spark, folder):
    path = scratch_path(spark, "categorical")
    ms.write_measurements(b.categorical(spark, folder), path, "categorical")
    return spark.read.parquet(path)


def s3(spark, folder):
    csv, parquet = csv_copy(spark, folder), scratch_path(spark, "numeric")
    ms.write_measurements(ms.read_measurements(spark, csv, "numeric"), parquet, "numeric")
    return ms.reconcile_rows(spark, csv, parquet)


def s4(spark, folder):
    """The given files against a manifest with one entry altered, one dropped and one added."""
    digests = ms.table_digests(spark, folder)
    kept = digests.where("name <> 'nation.parquet'").select(
        "name", F.when(F.col("name") == "region.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    manifest = kept.unionByName(spark.createDataFrame([("gone.parquet", "1" * 64)], ms.MANIFEST_SCHEMA))
    return ms.audit_files(digests, manifest).select("name", "verdict")


def s5(spark, folder):
    """Three of the given files changed since the log: a new file, a new digest, a new row count."""
    inventory = ms.table_digests(spark, folder).select("name", "sha256")
    counts = None
    for name in TABLES:
        one = b.table(spark, folder, name).agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(f"{name}.parquet"))
        counts = one if counts is None else counts.unionByName(one)
    log = inventory.join(counts, "name").where("name <> 'part.parquet'").select(
        "name", F.when(F.col("name") == "orders.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(F.col("name") == "events.parquet", F.col("rows") - 1).otherwise(F.col("rows")).alias("rows"))
    return ms.stale_inputs(inventory, log, counts).select("name")


def seen_catalog(spark, folder):
    numeric = b.numeric(spark, folder)
    present = column_coverage(numeric).where("present > 0").select("name", "present")
    return cat.column_catalog(numeric, "numeric").join(present, "name")


def s7(spark, folder):
    return cat.station_map(seen_catalog(spark, folder)).select("line", "station", F.array_join("columns", ",").alias("columns"))


def s8(spark, folder):
    """Train tables against test tables that lost a column, with a date table of orders that have line items."""
    train = b.wide(spark, folder)
    train["date"] = train["date"].where(F.col("L0_S1_D1").isNotNull() | F.coalesce(*b.date_columns()).isNotNull())
    test = {"numeric": train["numeric"], "categorical": train["categorical"].drop("L2_S7_F5")}
    expected = {"numeric": len(b.numeric_columns()), "date": 99, "categorical": len(b.categorical_columns())}
    return cat.check_contract(train, test, expected, b.table(spark, folder, "orders").count())


def s9(spark, folder):
    path = scratch_path(spark, "scores")
    tb.write_scores(b.scores(spark, folder), path)
    return tb.read_scores(spark, path)


def s10(spark, folder):
    path = scratch_path(spark, "traces")
    b.traces(spark, folder).drop("log", "block", "pos").write.json(path)
    return lg.read_jsonl_log(spark, path, lg.TRACE_SCHEMA).select("at", "event", "task", "tool", "spent_usd", "status", F.col("result.lift").alias("lift"))


def decision_files(spark, folder):
    path = scratch_path(spark, "decisions")
    d = b.decisions(spark, folder, numbered=True)
    lg.append_label(d.where("action = 'ship'"), path)
    lg.append_label(d.where("action <> 'ship'"), path)
    return path


def s11(spark, folder):
    return lg.read_jsonl_log(spark, decision_files(spark, folder), lg.DECISION_SCHEMA).drop("log", "block", "pos", "fields", "damaged")


def f9(spark, folder):
    return lg.labelled_only(lg.labelled(b.decisions(spark, folder)))


def k2(spark, folder):
    """Decision files, one of them delivered twice, through the stream."""
    path = decision_files(spark, folder)
    lg.append_label(b.decisions(spark, folder, numbered=True).where("action = 'scrap'"), path)
    out = each_once(drain(label_stream(decision_source(spark, path)), "labels"))
    return out.select("part_id", "action", "label", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def t3(spark, folder):
    left = cat.column_catalog(b.numeric(spark, folder), "numeric")
    right = cat.column_catalog(b.numeric(spark, folder).drop("L2_S7_F1"), "numeric")
    present = column_coverage(b.numeric(spark, folder)).select("name", "present")
    return cat.column_difference(left, right).select("name", "side").join(present, "name")


LABEL = "CASE action WHEN 'ship' THEN 0 WHEN 'scrap' THEN 1 END"
SEEN = ("cols AS (SELECT DISTINCT name, line, station, CAST(regexp_extract(name, 'F([0-9]+)$', 1) AS INTEGER) AS n FROM numlong)")

QUERIES = [
    Query("S1_read_measurements", s1, b.with_ctes("num", "SELECT * FROM num")),
    Query("S2_write_measurements", s2, b.with_ctes("cat", "SELECT * FROM cat")),
    Query("S3_reconcile_rows", s3, "SELECT count(*) AS csv_rows, count(*) AS parquet_rows, count(*) >= 0 AS matches FROM orders"),
    Query("S4_audit_files", s4, "SELECT name || '.parquet' AS name, CASE name WHEN 'nation' THEN 'unlisted' WHEN 'region' THEN 'mismatch' WHEN 'gone' THEN 'missing' ELSE 'ok' END AS verdict "
          f"FROM (VALUES {', '.join(f'({t!r})' for t in (*TABLES, 'gone'))}) v(name)"),
    Query("S5_stale_inputs", s5, "SELECT name FROM (VALUES ('part.parquet'), ('orders.parquet'), ('events.parquet')) v(name)"),
    Query("S6_column_catalog", lambda s, d: seen_catalog(s, d).select("kind", "name", "line", "station", "n", "present"),
          b.with_ctes("numlong", "SELECT 'numeric' AS kind, c.name, c.line, c.station, c.n, (SELECT count(*) FROM numlong x WHERE x.name = c.name) AS present FROM cols c", SEEN)),
    Query("S7_station_map", s7, b.with_ctes("numlong", "SELECT line, station, string_agg(name, ',' ORDER BY n) AS columns FROM cols GROUP BY line, station", SEEN)),
    Query("S8_check_contract", s8,
          b.with_ctes("visits", "SELECT * FROM (VALUES ('date', 'column_count', '14', '99'), ('categorical', 'test_columns', 'differ', 'train columns in order')) v(kind, rule, found, expected) "
                                "UNION ALL SELECT 'date', 'row_count', CAST((SELECT count(DISTINCT Id) FROM visits) AS VARCHAR), CAST((SELECT count(*) FROM orders) AS VARCHAR)")),
    Query("S9_scores_round_trip", s9, b.with_ctes("scores", "SELECT * FROM scores")),
    Query("S10_read_jsonl_log", s10, b.with_ctes("traces", "SELECT \"at\", event, task, CASE WHEN event = 'tool_result' THEN 'id_shuffle_test' END AS tool, spent_usd, status, "
                                                           "CASE WHEN event = 'tool_result' THEN lift END AS lift FROM traces"), ["lift"]),
    Query("S11_append_label", s11, b.with_ctes("decisions", f"SELECT part_id, action, {LABEL} AS label, \"at\" FROM decisions")),
    Query("F9_labelled_only", f9, b.with_ctes("decisions", f"SELECT part_id, action, {LABEL} AS label, \"at\" FROM decisions WHERE action <> 'senior_review'")),
    Query("K2_label_stream", k2, b.with_ctes("decisions", f"SELECT part_id, action, {LABEL} AS label, \"at\" FROM decisions")),
    Query("T3_column_difference", t3, b.with_ctes("numlong", "SELECT name, 'left' AS side, count(*) AS present FROM numlong WHERE name = 'L2_S7_F1' GROUP BY name")),
]
