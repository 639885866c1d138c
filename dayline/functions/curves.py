"""Shape features of one curve, as Column expressions over an array of values and a fixed scale grid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive ranges of log10 seconds, for coherence and for all other features.
COHERENCE_RANGE = (math.log10(10), math.log10(30))
FEATURE_RANGE = (math.log10(5), math.log10(100))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once and not again for each element of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def within(curve: Column, scales: list[float], bounds: tuple[float, float]) -> tuple[Column, list[float]]:
    """The part of a curve inside inclusive bounds, and its scales: contiguous, since scales increase."""
    inside = [i for i, s in enumerate(scales) if bounds[0] <= s <= bounds[1]]
    if not inside:
        return F.array().cast("array<double>"), []
    return F.slice(curve, inside[0] + 1, len(inside)), [scales[i] for i in inside]


def steps(v: Column) -> Column:
    """First differences."""
    n = F.size(v)
    return F.zip_with(F.slice(v, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def coherence(v: Column) -> Column:
    """-log10 of squared steps over squared deviations; null for a flat curve, infinite where only the deviations show."""
    around = bound(total(v) / F.size(v), lambda mean: total(F.transform(v, lambda x: (x - mean) * (x - mean))))
    ratio = total(F.transform(steps(v), lambda d: d * d)) / F.nullif(around, F.lit(0.0))
    return bound(ratio, lambda x: F.when(x == 0, F.lit(math.inf)).otherwise(-F.log10(x)))


def monotonicity(v: Column) -> Column:
    """1 less the share of rises in all movement; 1 for a flat curve."""
    moved = steps(v)
    rises = total(F.transform(moved, lambda d: F.greatest(d, F.lit(0.0))))
    return 1 - F.coalesce(rises / F.nullif(total(F.transform(moved, F.abs)), F.lit(0.0)), F.lit(0.0))


def curvature(v: Column) -> Column:
    """Mean absolute second difference."""
    bends = steps(steps(v))
    return total(F.transform(bends, F.abs)) / F.nullif(F.size(bends), F.lit(0))


def dynamic_range(v: Column) -> Column:
    return F.array_max(v) - F.array_min(v)


def quadrature_weights(scales: list[float]) -> list[float]:
    """Trapezoid weights: half the distance between neighbours, half the gap at the ends."""
    n = len(scales)
    return [(scales[min(j + 1, n - 1)] - scales[max(j - 1, 0)]) / 2 for j in range(n)]


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def auc(v: Column, scales: list[float]) -> Column:
    """Area under the curve by trapezoids, as a weighted sum."""
    return total(F.zip_with(v, literal(quadrature_weights(scales)), lambda x, w: x * w))


def _lifted(v: Column) -> Column:
    return bound(F.array_min(v), lambda low: F.transform(v, lambda x: x - low))


def centroid(v: Column, scales: list[float]) -> Column:
    """Mean scale weighted by height over the minimum; null for a flat curve."""
    return bound(_lifted(v), lambda mass: total(F.zip_with(mass, literal(scales), lambda m, s: m * s)) / F.nullif(total(mass), F.lit(0.0)))


def entropy(v: Column) -> Column:
    """Entropy of height over the minimum; 0 for a flat curve, whose shares are undefined."""

    def of(mass: Column) -> Column:
        return bound(F.nullif(total(mass), F.lit(0.0)), lambda whole: -total(F.transform(mass, lambda m: m / whole * F.ln(m / whole + 1e-12))))

    return F.coalesce(bound(_lifted(v), of), F.lit(0.0))


def mean_curvature(curve: Column, scales: list[float]) -> Column:
    """Mean absolute second difference over the range of the features."""
    return curvature(within(curve, scales, FEATURE_RANGE)[0])


def morphology(curve: Column, scales: list[float]) -> dict[str, Column]:
    """The six features by name, each over its range of scales."""
    near, _ = within(curve, scales, COHERENCE_RANGE)
    v, s = within(curve, scales, FEATURE_RANGE)
    return {"coherence": coherence(near), "monotonicity": monotonicity(v), "dynamic_range": dynamic_range(v), "auc": auc(v, s), "centroid": centroid(v, s), "entropy": entropy(v)}


def linear_axis(scales: list[float]) -> list[float]:
    """Powers of ten of the scales where all are at most 5, else the scales."""
    return [10**s for s in scales] if max(scales) <= 5 else list(scales)
