"""Reusable SQL fragments of the reference queries."""

from __future__ import annotations

from partflow.operators.cost import CostParameters


def mcc_sql(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn") -> str:
    a, b, c, d = (f"CAST({x} AS DOUBLE)" for x in (tp, fp, tn, fn))
    scale = f"sqrt(({a} + {b}) * ({a} + {d}) * ({c} + {b}) * ({c} + {d}))"
    return f"CASE WHEN {scale} > 0 THEN ({a} * {c} - {b} * {d}) / {scale} ELSE 0 END"


def dollars_sql(costs: CostParameters, tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn") -> str:
    return (f"(CAST({tp} AS DOUBLE) * {costs.inspection_cost_usd + costs.scrap_cost_usd} + CAST({fp} AS DOUBLE) * {costs.inspection_cost_usd} "
            f"+ CAST({fn} AS DOUBLE) * {costs.field_failure_cost_usd}) / ({tp} + {fp} + {tn} + {fn}) "
            f"* (CAST({costs.monthly_volume} AS DOUBLE) / {costs.shifts_per_month})")


def sweep_sql(source: str = "scores", prefix: str = "") -> str:
    """CTEs ending in {prefix}sweep(threshold, tp, fp, tn, fn, mcc) over a score table, by plain comparison."""
    return (f"{prefix}vals AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY p), "
            f"{prefix}cells AS (SELECT CAST(i AS DOUBLE) / 1000 AS threshold, "
            f"CAST(coalesce(sum(pos) FILTER (p >= CAST(i AS DOUBLE) / 1000), 0) AS BIGINT) AS tp, "
            f"CAST(coalesce(sum(neg) FILTER (p >= CAST(i AS DOUBLE) / 1000), 0) AS BIGINT) AS fp, "
            f"CAST(coalesce(sum(neg) FILTER (p < CAST(i AS DOUBLE) / 1000), 0) AS BIGINT) AS tn, "
            f"CAST(coalesce(sum(pos) FILTER (p < CAST(i AS DOUBLE) / 1000), 0) AS BIGINT) AS fn "
            f"FROM range(1001) AS r(i), {prefix}vals GROUP BY i), "
            f"{prefix}sweep AS (SELECT *, {mcc_sql()} AS mcc FROM {prefix}cells)")


def curve_sql(costs: CostParameters, source: str = "scores", prefix: str = "") -> str:
    return (sweep_sql(source, prefix) + f", {prefix}curve AS (SELECT threshold, tp, fp, tn, fn, {dollars_sql(costs)} AS dollars_per_shift "
            f"FROM {prefix}sweep)")


def policy_sql(costs: CostParameters, source: str = "scores", prefix: str = "") -> str:
    """CTEs ending in {prefix}policy(threshold, dollars_per_shift, band_low, band_high)."""
    return (curve_sql(costs, source, prefix) + f", {prefix}policy AS (SELECT "
            f"(SELECT min(threshold) FROM {prefix}curve WHERE dollars_per_shift = (SELECT min(dollars_per_shift) FROM {prefix}curve)) AS threshold, "
            f"(SELECT min(dollars_per_shift) FROM {prefix}curve) AS dollars_per_shift, min(threshold) AS band_low, max(threshold) AS band_high "
            f"FROM {prefix}curve WHERE dollars_per_shift <= (SELECT min(dollars_per_shift) FROM {prefix}curve) + {costs.abstain_band_indifference_usd})")


HASH60 = "CAST('0x' || substr(sha256({text}), 1, 15) AS BIGINT)"


def hash_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return HASH60.format(text=text)
