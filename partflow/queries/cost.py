"""Cost curve, policy and routing over the scores of all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from partflow.functions.scoring import in_band
from partflow.operators import cost as c
from partflow.plans.policy import decision_summary
from partflow.queries import bindings as b
from partflow.queries.registry import Query
from partflow.queries.sqlparts import curve_sql, dollars_sql, hash_sql, policy_sql
from partflow.session import materialized, scratch_path
from partflow.sources.tables import write_curve_csv, write_policy_json
from partflow.streaming.review import drain, route_stream

CURVE = b.with_ctes("scores", "SELECT threshold, tp, fp, tn, fn, mcc, dollars_per_shift FROM curve JOIN sweep USING (threshold, tp, fp, tn, fn)", curve_sql(b.COSTS))
ROUTE = "CASE WHEN p >= band_high THEN 'inspect' WHEN p >= band_low THEN 'review' ELSE 'ship' END"
DIGEST = (f"digest AS (SELECT sha256(count(*) || '|' || bit_xor(h) || '|' || CAST(sum(h % 2147483648) AS BIGINT)) AS d FROM (SELECT {hash_sql('id', 'y', 'p')} AS h FROM scores))")
COST_JSON = ('{"scrap_cost_usd":42.0,"field_failure_cost_usd":120.0,"inspection_cost_usd":6.5,"monthly_volume":240000,'
             '"shifts_per_month":90,"abstain_band_indifference_usd":500.0}')


def policy(spark, folder):
    return materialized(c.build_policy(b.scores(spark, folder), b.COSTS))


def c6(spark, folder):
    out = c.build_policy(b.scores(spark, folder), b.COSTS)
    return out.drop("costs")


def k1(spark, folder):
    """The stream takes parts as they arrive from the orders files; the policy was built before."""
    band = policy(spark, folder).select("band_low", "band_high").first()
    schema = spark.read.parquet(f"{folder}/orders.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(folder)
    bad = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    y = F.when(bad, 1).otherwise(0)
    milli = F.least(F.lit(999), F.expr("((o_orderkey * 7919 + o_custkey * 104729) % 1000) * 7 div 10") + F.lit(250) * y)
    scored = arriving.select(F.col("o_orderkey").alias("id"), (milli.cast("double") / 1000).alias("p"))
    return drain(route_stream(scored, band.band_low, band.band_high), "routed")


def s12_csv(spark, folder):
    path = scratch_path(spark, "curve")
    write_curve_csv(c.cost_curve(b.scores(spark, folder), b.COSTS), path)
    return spark.read.option("header", True).schema("threshold string, dollars_per_shift string, tp long, fp long, tn long, fn long").csv(path)


def s12_json(spark, folder):
    path = scratch_path(spark, "policy")
    write_policy_json(policy(spark, folder), path)
    return spark.read.schema("threshold double, band_low double, band_high double, dollars_per_shift double, version string, verdict string, "
                             "costs struct<scrap_cost_usd: double, field_failure_cost_usd: double>").json(path).select(
        "threshold", "band_low", "band_high", "dollars_per_shift", "verdict", F.col("costs.field_failure_cost_usd").alias("field_failure_cost_usd"))


def compare_sql() -> str:
    def side(prefix: str, costs) -> str:
        snapshot = " UNION ALL ".join(
            f"SELECT 'dollars_at_{t:.3f}', (SELECT round(dollars_per_shift, 2) FROM {prefix}curve ORDER BY abs(threshold - CAST({t} AS DOUBLE)), threshold LIMIT 1)"
            for t in c.SNAPSHOT_THRESHOLDS)
        return (f"{prefix}m AS (SELECT 'threshold' AS item, threshold AS value FROM {prefix}policy UNION ALL SELECT 'band_low', band_low FROM {prefix}policy UNION ALL "
                f"SELECT 'band_high', band_high FROM {prefix}policy UNION ALL SELECT 'dollars_per_shift', round(dollars_per_shift, 2) FROM {prefix}policy UNION ALL "
                f"SELECT 'abstain_share', (SELECT CAST(count(*) FILTER (p >= band_low AND p < band_high) AS DOUBLE) / count(*) FROM scores, {prefix}policy) UNION ALL {snapshot})")
    extra = ", ".join([policy_sql(b.COSTS, "scores", "a"), policy_sql(b.NEW_COSTS, "scores", "b"), side("a", b.COSTS), side("b", b.NEW_COSTS)])
    return b.with_ctes("scores", "SELECT 'curve' AS section, item, x.value AS old_value, y.value AS new_value, y.value - x.value AS delta FROM am x JOIN bm y USING (item) "
                                 "UNION ALL SELECT 'parameter', 'field_failure_cost_usd', 120.0::DOUBLE, 200.0::DOUBLE, 80.0::DOUBLE "
                                 "UNION ALL SELECT 'parameter', 'abstain_band_indifference_usd', 500.0::DOUBLE, 900.0::DOUBLE, 400.0::DOUBLE", extra)


QUERIES = [
    Query("decision_summary", lambda s, d: decision_summary(b.scores(s, d), b.COSTS),
          b.with_ctes("scores", f"SELECT {ROUTE} AS decision, count(*) AS parts, CAST(sum(y) AS BIGINT) AS failures, threshold, dollars_per_shift, "
                                f"CASE WHEN dollars_per_shift >= least({dollars_sql(b.COSTS, '0', '0', 'good', 'bad')}, {dollars_sql(b.COSTS, 'bad', 'good', '0', '0')}) "
                                "THEN 'rejected' ELSE 'accepted' END AS verdict FROM scores, policy, (SELECT count(*) FILTER (y = 0) AS good, count(*) FILTER (y = 1) AS bad FROM scores) t "
                                "GROUP BY ALL", policy_sql(b.COSTS)), ["dollars_per_shift"]),
    Query("C1_dollars_per_shift", lambda s, d: c.price(c.confusion_sweep(b.scores(s, d), (0.1, 0.2, 0.5)), b.COSTS),
          b.with_ctes("scores", "SELECT threshold, tp, fp, tn, fn, mcc, dollars_per_shift FROM curve JOIN sweep USING (threshold, tp, fp, tn, fn) "
                                "WHERE CAST(round(threshold * 1000) AS INTEGER) IN (100, 200, 500)", curve_sql(b.COSTS)), ["mcc", "dollars_per_shift"]),
    Query("C2_cost_curve", lambda s, d: c.cost_curve(b.scores(s, d), b.COSTS), CURVE, ["mcc", "dollars_per_shift"]),
    Query("C3_argmin_threshold", lambda s, d: c.argmin_threshold(c.cost_curve(b.scores(s, d), b.COSTS)),
          b.with_ctes("scores", "SELECT threshold, dollars_per_shift FROM curve ORDER BY dollars_per_shift, threshold LIMIT 1", curve_sql(b.COSTS)), ["dollars_per_shift"]),
    Query("C4_abstain_band", lambda s, d: c.abstain_band(c.cost_curve(b.scores(s, d), b.COSTS), b.COSTS.abstain_band_indifference_usd),
          b.with_ctes("scores", "SELECT band_low, band_high FROM policy", policy_sql(b.COSTS))),
    Query("C5_trivial_costs", lambda s, d: c.trivial_costs(b.scores(s, d), b.COSTS),
          b.with_ctes("scores", f"SELECT {dollars_sql(b.COSTS, '0', '0', 'good', 'bad')} AS ship_all_dollars_per_shift, {dollars_sql(b.COSTS, 'bad', 'good', '0', '0')} "
                                "AS inspect_all_dollars_per_shift FROM (SELECT count(*) FILTER (y = 0) AS good, count(*) FILTER (y = 1) AS bad FROM scores)"),
          ["ship_all_dollars_per_shift", "inspect_all_dollars_per_shift"]),
    Query("C6_build_policy", c6,
          b.with_ctes("scores", f"SELECT threshold, band_low, band_high, dollars_per_shift, {dollars_sql(b.COSTS, '0', '0', 'good', 'bad')} AS ship_all_dollars_per_shift, "
                                f"{dollars_sql(b.COSTS, 'bad', 'good', '0', '0')} AS inspect_all_dollars_per_shift, 1 - share AS committed_share, share AS abstain_share, "
                                f"d AS scores_digest, 'policy-' || substr(sha256('{{\"costs\":{COST_JSON},\"scores_digest\":\"' || d || '\"}}'), 1, 12) AS version, "
                                f"CASE WHEN dollars_per_shift >= least({dollars_sql(b.COSTS, '0', '0', 'good', 'bad')}, {dollars_sql(b.COSTS, 'bad', 'good', '0', '0')}) "
                                "THEN 'rejected' ELSE 'accepted' END AS verdict FROM policy, digest, (SELECT count(*) FILTER (y = 0) AS good, count(*) FILTER (y = 1) AS bad, "
                                "CAST(count(*) FILTER (p >= band_low AND p < band_high) AS DOUBLE) / count(*) AS share FROM scores, policy) t", policy_sql(b.COSTS) + ", " + DIGEST),
          ["dollars_per_shift", "ship_all_dollars_per_shift", "inspect_all_dollars_per_shift", "committed_share", "abstain_share"]),
    Query("C9_route_parts", lambda s, d: c.route_parts(b.scores(s, d), policy(s, d)),
          b.with_ctes("scores", f"SELECT id, y, p, {ROUTE} AS decision FROM scores, policy", policy_sql(b.COSTS))),
    Query("C10_compare_policies", lambda s, d: c.compare_policies(b.scores(s, d), b.COSTS, b.NEW_COSTS), compare_sql(), ["old_value", "new_value", "delta"]),
    Query("F2_in_band", lambda s, d: b.scores(s, d).where(in_band(F.col("p"), F.lit(0.1), F.lit(0.25))),
          b.with_ctes("scores", "SELECT * FROM scores WHERE p >= CAST(0.1 AS DOUBLE) AND p < 0.25")),
    Query("F3_route_decision", lambda s, d: b.scores(s, d).select("id", c.route_decision(F.col("p"), F.lit(0.1), F.lit(0.25)).alias("decision")),
          b.with_ctes("scores", "SELECT id, CASE WHEN p >= 0.25 THEN 'inspect' WHEN p >= CAST(0.1 AS DOUBLE) THEN 'review' ELSE 'ship' END AS decision FROM scores")),
    Query("K1_route_stream", k1, b.with_ctes("scores", f"SELECT id, p, {ROUTE} AS decision FROM scores, policy", policy_sql(b.COSTS))),
    Query("J10_scored_threshold_join", lambda s, d: c.confusion_sweep(b.scores(s, d)).select("threshold", (F.col("tp") + F.col("fp")).alias("flagged")),
          b.with_ctes("scores", "SELECT CAST(i AS DOUBLE) / 1000 AS threshold, count(p) AS flagged FROM range(1001) AS r(i) LEFT JOIN scores ON p >= CAST(i AS DOUBLE) / 1000 GROUP BY i")),
    Query("S12_write_curve_csv", s12_csv,
          b.with_ctes("scores", "SELECT printf('%.3f', threshold) AS threshold, printf('%.2f', dollars_per_shift) AS dollars_per_shift, tp, fp, tn, fn FROM curve", curve_sql(b.COSTS))),
    Query("S12_write_policy_json", s12_json,
          b.with_ctes("scores", f"SELECT threshold, band_low, band_high, dollars_per_shift, CASE WHEN dollars_per_shift >= least({dollars_sql(b.COSTS, '0', '0', 'good', 'bad')}, "
                                f"{dollars_sql(b.COSTS, 'bad', 'good', '0', '0')}) THEN 'rejected' ELSE 'accepted' END AS verdict, CAST(120 AS DOUBLE) AS field_failure_cost_usd "
                                "FROM policy, (SELECT count(*) FILTER (y = 0) AS good, count(*) FILTER (y = 1) AS bad FROM scores) t", policy_sql(b.COSTS)), ["dollars_per_shift"]),
]
