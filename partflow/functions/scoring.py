"""Expressions over scores, counts and costs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID_STEPS = 1000
GRID = tuple(k / GRID_STEPS for k in range(GRID_STEPS + 1))


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation in doubles (the product of four counts overflows 64 bits); 0 when undefined."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    scale = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(scale > 0, (tp * tn - fp * fn) / scale).otherwise(F.lit(0.0))


def threshold_bucket(p: Column, thresholds: Sequence[float] = GRID) -> Column:
    """Index of the highest threshold <= p, or -1. Pure arithmetic on the 0.001 grid, so it stays in codegen.

    NaN compares above every threshold, as it does for the >= of the row-by-row definition.
    """
    top = len(thresholds) - 1
    if tuple(thresholds) == GRID:
        near = F.round(p * GRID_STEPS).cast("int")
        exact = F.when(near.cast("double") / GRID_STEPS <= p, near).otherwise(near - 1)
        return F.when(F.isnan(p) | (p >= 1.0), F.lit(top)).when(p < 0.0, F.lit(-1)).otherwise(exact)
    if list(thresholds) != sorted(thresholds):
        raise ValueError("thresholds must be ascending")

    def search(low: int, high: int) -> Column:
        """Conditions as a balanced tree: a score passes as many as the logarithm of the thresholds."""
        if low > high:
            return F.lit(low - 1)
        middle = (low + high) // 2
        return F.when(p >= F.lit(float(thresholds[middle])), search(middle + 1, high)).otherwise(search(low, middle - 1))

    return F.when(p.isNotNull(), search(0, top)).otherwise(F.lit(-1))


def dollars_per_shift(tp: Column, fp: Column, tn: Column, fn: Column, costs) -> Column:
    """Expected dollars per shift for one confusion matrix under the given cost parameters."""
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    spent = (tp * (costs.inspection_cost_usd + costs.scrap_cost_usd)
             + fp * costs.inspection_cost_usd + fn * costs.field_failure_cost_usd)
    return F.try_divide(spent, tp + fp + tn + fn) * F.lit(costs.parts_per_shift)


def route_decision(score: Column, band_low: Column, band_high: Column) -> Column:
    return F.when(score >= band_high, "inspect").when(score >= band_low, "review").otherwise("ship")


def in_band(score: Column, band_low: Column, band_high: Column) -> Column:
    """Half-open band [low, high)."""
    return (score >= band_low) & (score < band_high)


def hash_number(*parts: Column) -> Column:
    """60-bit number from a digest of the parts: the same on every engine and every Spark version."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def seeded_below(ident: Column, seed: int, fraction: float) -> Column:
    """True for a stable pseudo-random fraction of ids; independent of partitioning and row order."""
    return hash_number(ident, F.lit(seed)) % 1000 < int(fraction * 1000)


def close_to(a: Column, b: Column, rel: float = 1e-4, absolute: float = 1e-4) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(absolute))


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = None
    for x, y in zip(a, b, strict=True):
        term = (x - y) * (x - y)
        total = term if total is None else total + term
    return total


def label_for(action: Column, labels: Mapping[str, int | None]) -> Column:
    """Training label of a review action; null for actions without one."""
    out = F.lit(None).cast("int")
    for name, value in labels.items():
        if value is not None:
            out = F.when(action == name, F.lit(value)).otherwise(out)
    return out
