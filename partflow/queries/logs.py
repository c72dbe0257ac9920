"""Trace, decision and search summaries over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from partflow.operators import scorecard as sc
from partflow.operators.sandbox import FeatureDef, feature_status, propose
from partflow.plans.ensemble import noise_reference
from partflow.plans.leaks import LeakConfig, final_status, leak_verdict
from partflow.plans.search import AcceptConfig, accept, accept_all
from partflow.queries import bindings as b
from partflow.queries.registry import Query

ACCEPT = AcceptConfig()
AGENT = "agent1"  # whose logs R3 and R4 read: names agent1-<stamp>


def status(spark, folder):
    return feature_status(b.review_log(spark, folder))


def r4(spark, folder):
    return sc.leak_lift(b.traces(spark, folder), "feature3", agent=AGENT)


def r5(spark, folder):
    e = b.table(spark, folder, "events")
    facts = e.groupBy("user_id").agg(F.sum("value").alias("spent_usd"), (F.min("event_id") % 10 / 1000.0).alias("reference_mcc"),
                                     (F.max("event_id") % 10 / 1000.0).alias("best_mcc"))
    return sc.spend_per_point(facts)


def refusals(spark, folder):
    return b.traces(spark, folder).where("event = 'budget_stop'")


def g10(spark, folder):
    return accept_all(b.evaluations(spark, folder), b.search_reference(spark, folder), ACCEPT)


def r7(spark, folder):
    traces = b.traces(spark, folder)
    by_agent = sc.spend_by_agent(traces)
    return sc.scorecard({"search": sc.survival(status(spark, folder)), "dispositions": sc.disposition_facts(traces),
                         "spend": sc.total_spend(by_agent), "merges": sc.refusal_count(refusals(spark, folder))})


def r9(spark, folder):
    evaluations = g10(spark, folder).withColumn("holdout_ids_referenced", F.lit(0).cast("long"))
    return sc.search_summary(status(spark, folder), evaluations)


def test_results(spark, folder):
    """Lifts per user of the event log, standing in for the numbers of the three leak tests."""
    e, kind = b.table(spark, folder, "events"), F.col("event_type")
    mean = lambda k: F.coalesce(F.avg(F.when(kind == k, F.col("value"))), F.lit(0.0)) / 100
    return e.groupBy(F.concat(F.lit("feature_"), F.col("user_id")).alias("name")).agg(
        mean("view").alias("lift"), (mean("click") / 2).alias("shuffled_lift"), (mean("purchase") / 2).alias("time_lift"), mean("signup").alias("random_lift"),
        F.count(F.lit(1)).alias("rows_compared"), F.count_if((kind == "error") & (F.col("event_id") % 53 == 0)).alias("mismatched"))


def l6(spark, folder):
    v = leak_verdict(test_results(spark, folder), LeakConfig())
    return v.select("name", "collapse", "retention", "decision", F.array_join("failed_tests", ", ").alias("failed_tests"))


def l7(spark, folder):
    reviewer = status(spark, folder).where("status <> 'proposed'").select("name", "status")
    return final_status(reviewer, leak_verdict(test_results(spark, folder)))


def u1(spark, folder):
    """Three proposals, one of them already in the log of the given events."""
    known = FeatureDef("known", "was proposed before", sql="SELECT Id, 1 AS one FROM parts_numeric")
    fresh = FeatureDef("fresh", "new idea", sql="SELECT Id, L0_S1_F1 AS reading FROM parts_numeric")
    log = b.review_log(spark, folder).select("feature_id").distinct().unionByName(spark.createDataFrame([(known.feature_id,)], "feature_id string"))
    return propose(log, [known, fresh, fresh], "search").select("feature_id", "name", "proposed_by", "status")


U1 = FeatureDef("fresh", "new idea", sql="SELECT Id, L0_S1_F1 AS reading FROM parts_numeric").feature_id
STATUS = ("st AS (SELECT feature_id, name, CASE WHEN coalesce(bool_or(status = 'quarantined') FILTER (ok), false) THEN 'quarantined' "
          "ELSE coalesce(arg_max(status, \"at\") FILTER (ok), 'proposed') END AS status, count(*) FILTER (ok) AS decisions FROM ("
          "SELECT *, actor = 'warden' AND length(trim(finding)) > 0 AND status IN ('approved', 'quarantined') AS ok FROM reviews) GROUP BY feature_id, name)")
RUNS = ("runs AS (SELECT *, sum(CASE WHEN event = 'agent_start' THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM traces)")
PEAKS = "peaks AS (SELECT log, r, greatest(coalesce(max(spent_usd) FILTER (event = 'model_turn'), 0), 0) AS peak FROM runs GROUP BY log, r)"
FOLD = (f"calls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY seq) AS call FROM evals) WHERE call <= {ACCEPT.max_evaluations}), "
        "fold AS (SELECT search, CAST(0 AS BIGINT) AS call, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS mcc, CAST(NULL AS DOUBLE) AS ap, CAST(NULL AS DOUBLE) AS mcc_bar, "
        "CAST(NULL AS DOUBLE) AS ap_bar, false AS improved, r.mcc AS best_mcc, r.ap AS best_ap, 0 AS consecutive_failures, sd_mcc, sd_ap FROM reference r UNION ALL "
        "SELECT search, call, seq, mcc, ap, mb, ab, ok, CASE WHEN ok THEN mcc ELSE best_mcc END, CASE WHEN ok THEN ap ELSE best_ap END, CASE WHEN ok THEN 0 ELSE consecutive_failures + 1 END, sd_mcc, sd_ap "
        "FROM (SELECT c.search, c.call, c.seq, c.mcc, c.ap, f.best_mcc, f.best_ap, f.consecutive_failures, f.sd_mcc, f.sd_ap, "
        f"f.best_mcc + greatest(CAST({ACCEPT.min_delta_mcc} AS DOUBLE), {ACCEPT.noise_multiplier}::DOUBLE * sd_mcc) AS mb, f.best_ap + {ACCEPT.noise_multiplier}::DOUBLE * sd_ap AS ab, "
        f"c.mcc >= f.best_mcc + greatest(CAST({ACCEPT.min_delta_mcc} AS DOUBLE), {ACCEPT.noise_multiplier}::DOUBLE * sd_mcc) AND c.ap >= f.best_ap + {ACCEPT.noise_multiplier}::DOUBLE * sd_ap AS ok "
        f"FROM fold f JOIN calls c ON c.search = f.search AND c.call = f.call + 1 WHERE f.consecutive_failures < {ACCEPT.stop_after})), "
        "accepted AS (SELECT search, CAST(call AS INTEGER) AS call, mcc_bar, ap_bar, improved, best_mcc, best_ap, consecutive_failures, seq, mcc, ap, CASE WHEN "
        f"consecutive_failures >= {ACCEPT.stop_after} THEN 'consecutive failures' WHEN call >= {ACCEPT.max_evaluations} THEN 'evaluation budget' END AS stop_reason FROM fold WHERE call > 0)")


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def mean_sql(kind: str) -> str:
    return f"(coalesce(avg(value) FILTER (event_type = '{kind}'), 0) / 100)"


RESULTS = ("res AS (SELECT 'feature_' || user_id AS name, " + f"{mean_sql('view')} AS lift, {mean_sql('click')} / 2 AS shuffled_lift, {mean_sql('purchase')} / 2 AS time_lift, "
           f"{mean_sql('signup')} AS random_lift, count(*) FILTER (event_type = 'error' AND event_id % 53 = 0) AS mismatched FROM events GROUP BY user_id), "
           "scored AS (SELECT *, CASE WHEN lift < 0.02 THEN 0 ELSE greatest(0, (lift - shuffled_lift) / lift) END AS collapse, "
           "CASE WHEN random_lift < 0.02 THEN 1 ELSE greatest(0, time_lift) / random_lift END AS retention FROM res), "
           "verdicts AS (SELECT name, collapse, retention, CASE WHEN mismatched > 0 OR collapse >= 0.6 OR retention < 0.5 THEN 'quarantine' ELSE 'approve' END AS decision, "
           "concat_ws(', ', CASE WHEN mismatched > 0 THEN 'row scope' END, CASE WHEN collapse >= 0.6 THEN 'id shuffle' END, CASE WHEN retention < 0.5 THEN 'strict time refit' END) AS failed_tests FROM scored)")

QUERIES = [
    Query("W7_run_groups", lambda s, d: sc.run_spend(b.traces(s, d)).groupBy("log").agg(F.count(F.lit(1)).alias("runs"), F.sum("peak_usd").alias("spent_usd")),
          b.with_ctes("traces", "SELECT log, count(*) AS runs, sum(peak) AS spent_usd FROM peaks GROUP BY log", f"{RUNS}, {PEAKS}"), ["spent_usd"]),
    Query("R1_spend_by_agent", lambda s, d: sc.spend_by_agent(b.traces(s, d)),
          b.with_ctes("traces", "SELECT regexp_replace(log, '-[0-9T]+Z?$', '') AS agent, sum(peak) AS spent_usd FROM peaks GROUP BY 1", f"{RUNS}, {PEAKS}"), ["spent_usd"]),
    Query("U3_feature_status", status, b.with_ctes("reviews", "SELECT * FROM st", STATUS)),
    Query("R2_survival", lambda s, d: sc.survival(status(s, d)),
          b.with_ctes("reviews", "SELECT count(*) FILTER (status = 'approved') AS approved, count(*) AS decided, count(*) FILTER (status = 'quarantined') AS quarantined, "
                                 "coalesce(CAST(count(*) FILTER (status = 'approved') AS DOUBLE) / nullif(count(*), 0), 0) AS rate FROM st WHERE status <> 'proposed'", STATUS), ["rate"]),
    Query("R2_quarantined_names", lambda s, d: sc.quarantined_names(status(s, d)), b.with_ctes("reviews", "SELECT name FROM st WHERE status = 'quarantined'", STATUS)),
    Query("R3_disposition_facts", lambda s, d: sc.disposition_facts(b.traces(s, d), AGENT),
          b.with_ctes("traces", "SELECT count(*) FILTER (event = 'disposition_outcome') AS dispositions, count(*) FILTER (event = 'disposition_outcome' AND status = 'rejected') "
                                f"AS fabricated_citations FROM traces WHERE log LIKE '{AGENT}-%'")),
    Query("R4_leak_lift", r4,
          b.with_ctes("traces", "SELECT log, lift, shuffled_lift FROM (SELECT t.*, row_number() OVER (ORDER BY regexp_extract(t.log, '-[0-9T]+Z?$') DESC, t.log DESC, t.pos) AS k FROM runs t JOIN runs n ON n.log = t.log AND n.r = t.r "
                                "AND n.event = 'agent_start' AND contains(n.task, '''feature3''') WHERE t.event = 'tool_result' AND t.log LIKE 'agent1-%') WHERE k = 1", RUNS), ["lift", "shuffled_lift"]),
    Query("R5_spend_per_point", r5,
          "SELECT *, CASE WHEN (best_mcc - reference_mcc) * 100 > 0 THEN spent_usd / ((best_mcc - reference_mcc) * 100) END AS usd_per_point FROM (SELECT user_id, sum(value) AS spent_usd, "
          "CAST(min(event_id) % 10 AS DOUBLE) / 1000 AS reference_mcc, CAST(max(event_id) % 10 AS DOUBLE) / 1000 AS best_mcc FROM events GROUP BY user_id)", ["spent_usd", "usd_per_point"]),
    Query("R6_refusal_count", lambda s, d: sc.refusal_count(refusals(s, d)), b.with_ctes("traces", "SELECT count(*) AS refusals FROM traces WHERE event = 'budget_stop'")),
    Query("R7_scorecard", r7,
          b.with_ctes("traces reviews", "SELECT 'search' AS section, measure, value FROM (UNPIVOT (SELECT CAST(count(*) FILTER (status = 'approved') AS DOUBLE) AS approved, CAST(count(*) AS DOUBLE) AS decided, "
                      "CAST(count(*) FILTER (status = 'quarantined') AS DOUBLE) AS quarantined, coalesce(CAST(count(*) FILTER (status = 'approved') AS DOUBLE) / nullif(count(*), 0), 0) AS rate "
                      "FROM st WHERE status <> 'proposed') ON approved, decided, quarantined, rate INTO NAME measure VALUE value) UNION ALL "
                      "SELECT 'dispositions', 'dispositions', CAST(count(*) AS DOUBLE) FROM traces WHERE event = 'disposition_outcome' UNION ALL "
                      "SELECT 'dispositions', 'fabricated_citations', CAST(count(*) AS DOUBLE) FROM traces WHERE event = 'disposition_outcome' AND status = 'rejected' UNION ALL "
                      "SELECT 'spend', 'total_usd', sum(peak) FROM peaks UNION ALL SELECT 'merges', 'refusals', CAST(count(*) AS DOUBLE) FROM traces WHERE event = 'budget_stop'",
                      f"{STATUS}, {RUNS}, {PEAKS}"), ["value"]),
    Query("R8_trace_completeness", lambda s, d: sc.trace_completeness(b.traces(s, d)),
          b.with_ctes("traces", "SELECT log, bool_or(event = 'agent_start') AND bool_or(event = 'search_summary') AND bool_or(event IN ('agent_end', 'budget_stop')) AS complete FROM traces GROUP BY log")),
    Query("R9_search_summary", r9,
          recursive(b.with_ctes("reviews evals reference", "SELECT s.*, e.* FROM (SELECT count(*) AS proposals, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'quarantined') AS quarantined, "
                                "coalesce(CAST(count(*) FILTER (status = 'approved') AS DOUBLE) / nullif(count(*), 0), 0) AS survival_rate FROM st) s, (SELECT (SELECT count(*) FROM evals) AS evaluations, max(best_mcc) AS best_mcc, "
                                "max(best_ap) AS best_ap, count(*) FILTER (improved) AS improved, CAST(0 AS BIGINT) AS holdout_ids_referenced FROM accepted) e", f"{STATUS}, {FOLD}")),
          ["survival_rate", "best_mcc", "best_ap"]),
    Query("G10_accept", g10, recursive(b.with_ctes("evals reference", "SELECT e.search, e.seq, e.mcc, e.ap, a.* EXCLUDE (search, seq, mcc, ap), a.search IS NOT NULL AS counted FROM evals e LEFT JOIN accepted a ON a.search = e.search AND a.seq = e.seq", FOLD)), ["mcc_bar", "ap_bar", "best_mcc", "best_ap", "mcc", "ap"]),
    Query("A10_noise_reference", lambda s, d: noise_reference(b.evaluations(s, d)),
          b.with_ctes("evals", "SELECT avg(mcc) AS mcc, avg(ap) AS ap, stddev_samp(mcc) AS sd_mcc, stddev_samp(ap) AS sd_ap FROM evals"), ["mcc", "ap", "sd_mcc", "sd_ap"]),
    Query("L6_leak_verdict", l6, b.with_ctes("parts", "SELECT * FROM verdicts", RESULTS), ["collapse", "retention"]),
    Query("L7_final_status", l7,
          b.with_ctes("reviews", "SELECT name, reviewer_status, rule_status, final_status, coalesce(reviewer_status <> final_status, false) AS overridden, "
                                 "coalesce(reviewer_status = final_status AND reviewer_status <> rule_status, false) AS disagreement FROM (SELECT v.name, s.status AS reviewer_status, "
                                 "CASE v.decision WHEN 'quarantine' THEN 'quarantined' ELSE 'approved' END AS rule_status, CASE WHEN v.decision = 'quarantine' OR s.status = 'quarantined' THEN 'quarantined' "
                                 "ELSE 'approved' END AS final_status FROM verdicts v LEFT JOIN (SELECT * FROM st WHERE status <> 'proposed') s USING (name))", f"{STATUS}, {RESULTS}")),
    Query("U1_propose", u1, f"SELECT '{U1}' AS feature_id, 'fresh' AS name, 'search' AS proposed_by, 'proposed' AS status WHERE (SELECT count(*) FROM events) > 0"),
]
