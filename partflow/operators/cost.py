"""Dollars per shift, cheapest threshold, review band, policy and routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partflow.functions.scoring import GRID, dollars_per_shift, in_band, route_decision
from partflow.operators.metrics import COUNTS, class_balance, confusion_sweep
from partflow.sources.tables import fingerprint


@dataclass(frozen=True)
class CostParameters:
    scrap_cost_usd: float
    field_failure_cost_usd: float
    inspection_cost_usd: float
    monthly_volume: int
    shifts_per_month: int
    abstain_band_indifference_usd: float

    def __post_init__(self) -> None:
        if self.abstain_band_indifference_usd < 0:
            raise ValueError("indifference must be non-negative")

    @property
    def parts_per_shift(self) -> float:
        return self.monthly_volume / self.shifts_per_month


# The published cost assumptions.
DEFAULT_COSTS = CostParameters(42.0, 1850.0, 6.5, 240_000, 90, 1500.0)
SNAPSHOT_THRESHOLDS = (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5)


def price(sweep: DataFrame, costs: CostParameters) -> DataFrame:
    """Add dollars per shift to any table of confusion counts."""
    return sweep.withColumn("dollars_per_shift", dollars_per_shift(*[F.col(c) for c in COUNTS], costs))


def cost_curve(scores: DataFrame, costs: CostParameters, thresholds: Sequence[float] = GRID) -> DataFrame:
    return price(confusion_sweep(scores, thresholds), costs)


def argmin_threshold(curve: DataFrame) -> DataFrame:
    """The lowest of the cheapest thresholds."""
    cheapest = F.min_by(F.struct("threshold", "dollars_per_shift"), F.struct("dollars_per_shift", "threshold"))
    return curve.agg(cheapest.alias("b")).select("b.*")


def abstain_band(curve: DataFrame, indifference: float) -> DataFrame:
    """Hull of every threshold whose cost is within `indifference` of the minimum. One row."""
    if indifference < 0:
        raise ValueError("indifference must be non-negative")
    # the curve has one row per threshold, so one small aggregate carries it whole
    point = F.struct("threshold", "dollars_per_shift")
    packed = curve.agg(F.collect_list(point).alias("points"), F.min("dollars_per_shift").alias("best"))
    near = F.transform(F.filter("points", lambda q: q["dollars_per_shift"] <= F.col("best") + indifference),
                       lambda q: q["threshold"])
    return packed.select(F.array_min(near).alias("band_low"), F.array_max(near).alias("band_high"))


def trivial_costs(scores: DataFrame, costs: CostParameters) -> DataFrame:
    """Cost of shipping everything and of inspecting everything."""
    zero, bad = F.lit(0), F.col("positives")
    good = F.col("parts") - F.col("positives")
    return class_balance(scores).select(
        dollars_per_shift(zero, zero, good, bad, costs).alias("ship_all_dollars_per_shift"),
        dollars_per_shift(bad, good, zero, zero, costs).alias("inspect_all_dollars_per_shift"))


def build_policy(scores: DataFrame, costs: CostParameters) -> DataFrame:
    """The decision policy as one row.

    One pass over the scores makes the sweep and the class totals, a second one the digest. The band share is
    read off the sweep: parts at or above a grid threshold are tp + fp there, so no third pass is needed.
    """
    curve = cost_curve(scores, costs)
    point = F.struct("threshold", "dollars_per_shift", (F.col("tp") + F.col("fp")).alias("flagged"))
    packed = curve.agg(F.collect_list(point).alias("points"), F.min("dollars_per_shift").alias("dollars_per_shift"),
                       F.max(F.col("tp") + F.col("fn")).alias("bad"), F.max(F.col("fp") + F.col("tn")).alias("good"))
    best = F.col("dollars_per_shift")
    limit = best + costs.abstain_band_indifference_usd

    def thresholds_where(keep) -> Column:
        return F.transform(F.filter("points", keep), lambda q: q["threshold"])

    def flagged_at(threshold: str) -> Column:
        return F.element_at(F.filter("points", lambda q: q["threshold"] == F.col(threshold)), 1)["flagged"]

    zero = F.lit(0)
    shaped = packed.select(
        "points", "dollars_per_shift", "bad", "good",
        F.array_min(thresholds_where(lambda q: q["dollars_per_shift"] == best)).alias("threshold"),
        F.array_min(thresholds_where(lambda q: q["dollars_per_shift"] <= limit)).alias("band_low"),
        F.array_max(thresholds_where(lambda q: q["dollars_per_shift"] <= limit)).alias("band_high"))
    share = F.try_divide((flagged_at("band_low") - flagged_at("band_high")).cast("double"), F.col("bad") + F.col("good"))
    digest = fingerprint(scores, ["id", "y", "p"]).select("digest").scalar()
    cost_struct = F.struct(*[F.lit(v).alias(k) for k, v in asdict(costs).items()])
    out = shaped.select(
        "threshold", "band_low", "band_high", "dollars_per_shift",
        dollars_per_shift(zero, zero, F.col("good"), F.col("bad"), costs).alias("ship_all_dollars_per_shift"),
        dollars_per_shift(F.col("bad"), F.col("good"), zero, zero, costs).alias("inspect_all_dollars_per_shift"),
        (1.0 - share).alias("committed_share"), share.alias("abstain_share"),
        cost_struct.alias("costs"), digest.alias("scores_digest"))
    version = F.concat(F.lit("policy-"), F.substring(
        F.sha2(F.to_json(F.struct("costs", "scores_digest")), 256), 1, 12))
    trivial = F.least("ship_all_dollars_per_shift", "inspect_all_dollars_per_shift")
    return (out.withColumn("version", version)
            .withColumn("verdict", F.when(F.col("dollars_per_shift") >= trivial, "rejected").otherwise("accepted")))


def route_parts(scores: DataFrame, policy: DataFrame) -> DataFrame:
    """Every part with its decision. The one-row policy enters as scalar subqueries, so nothing shuffles."""
    low, high = policy.select("band_low").scalar(), policy.select("band_high").scalar()
    return scores.select("id", "y", "p", route_decision(F.col("p"), low, high).alias("decision"))


def parts_in_band(scores: DataFrame, policy: DataFrame) -> DataFrame:
    low, high = policy.select("band_low").scalar(), policy.select("band_high").scalar()
    return scores.where(in_band(F.col("p"), low, high))


def parameter_changes(old: CostParameters, new: CostParameters) -> Mapping[str, tuple[float, float]]:
    before, after = asdict(old), asdict(new)
    return {k: (float(before[k]), float(after[k])) for k in before if before[k] != after[k]}


def compare_policies(scores: DataFrame, old: CostParameters, new: CostParameters) -> DataFrame:
    """Old and new cost parameters on one sweep: (section, item, old_value, new_value, delta).

    The scores are swept once; both price lists are expressions over the same 1,001 rows.
    """
    spark = scores.sparkSession
    sweep = confusion_sweep(scores)
    priced = (sweep.select("threshold", (F.col("tp") + F.col("fp")).alias("flagged"), (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("parts"),
                           dollars_per_shift(*[F.col(c) for c in COUNTS], old).alias("old"),
                           dollars_per_shift(*[F.col(c) for c in COUNTS], new).alias("new")))
    packed = priced.agg(F.collect_list(F.struct("threshold", "flagged", "old", "new")).alias("points"),
                        F.min("old").alias("min_old"), F.min("new").alias("min_new"), F.max("parts").alias("parts"))

    def nearest_point(side: str, target: float) -> Column:
        return F.array_min(F.transform("points", lambda q: F.struct(
            F.abs(q["threshold"] - target).alias("gap"), q["threshold"].alias("threshold"), q[side].alias("dollars"))))

    def measures(side: str, costs: CostParameters) -> Column:
        low_cost = F.col(f"min_{side}")
        at = lambda keep: F.transform(F.filter("points", keep), lambda q: q["threshold"])
        near = at(lambda q: q[side] <= low_cost + costs.abstain_band_indifference_usd)
        flagged = lambda t: F.element_at(F.filter("points", lambda q: q["threshold"] == t), 1)["flagged"]
        share = (flagged(F.array_min(near)) - flagged(F.array_max(near))).cast("double") / F.col("parts")
        cheapest = F.array_min(at(lambda q: q[side] == low_cost))
        values = {"threshold": cheapest, "band_low": F.array_min(near), "band_high": F.array_max(near),
                  "dollars_per_shift": F.round(low_cost, 2), "abstain_share": share}
        for t in SNAPSHOT_THRESHOLDS:
            values[f"dollars_at_{t:.3f}"] = F.round(nearest_point(side, t)["dollars"], 2)
        return F.array(*[F.struct(F.lit("curve").alias("section"), F.lit(k).alias("item"), v.alias("value"))
                         for k, v in values.items()])

    paired = packed.select(F.explode(F.arrays_zip(measures("old", old).alias("o"), measures("new", new).alias("n"))).alias("z"))
    curve_rows = paired.select("z.o.section", "z.o.item", F.col("z.o.value").alias("old_value"), F.col("z.n.value").alias("new_value"))
    changed = spark.createDataFrame([("parameter", k, a, b) for k, (a, b) in parameter_changes(old, new).items()],
                                    "section string, item string, old_value double, new_value double")
    return changed.unionByName(curve_rows).withColumn("delta", F.col("new_value") - F.col("old_value"))
