"""Scores to decisions: sweep, cost curve, policy, routing, and what it costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partflow.operators.cost import DEFAULT_COSTS, CostParameters, build_policy, route_parts
from partflow.session import materialized


def decision_summary(scores: DataFrame, costs: CostParameters = DEFAULT_COSTS) -> DataFrame:
    """How many parts ship, go to review or are inspected, how many of them fail, and the cost per shift.

    The policy is fixed first (one row), so routing reads the scores once with three constants.
    """
    policy = materialized(build_policy(scores, costs))
    routed = route_parts(scores, policy)
    return (routed.groupBy("decision").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.col("y").cast("long")).alias("failures"))
            .select("decision", "parts", "failures", policy.select("threshold").scalar().alias("threshold"),
                    policy.select("dollars_per_shift").scalar().alias("dollars_per_shift"),
                    policy.select("verdict").scalar().alias("verdict")))
