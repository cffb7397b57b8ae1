"""Statistics as Columns: the only versions of these in the engine, used by the audit, the detectors and the queries.

An audit's estimates are rows of a table, so correction, gate and least detectable effects are expressions
over it, whether the table has four rows or a million.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESTABLISHED = "established"
# What the gate answers where it refuses, in the order of its checks, and how a report says it.
REFUSALS = {
    "undefined": "a figure is undefined",
    "p": "the corrected p is above the level",
    "zero": "the interval holds zero",
    "small": "the effect is too small to count",
    "sign": "the effect is not positive",
}


def quantile(level: float) -> float:
    """Standard normal quantile."""
    return NormalDist().inv_cdf(level)


def wilson(hits: Column, n: Column, alpha: float) -> tuple[Column, Column]:
    """Score interval of a proportion, within [0, 1]; null for n = 0."""
    z2 = quantile(1 - alpha / 2) ** 2
    p = hits / F.when(n > 0, n)
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.sqrt(F.lit(z2)) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    known = p.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), middle - half)), F.when(known, F.least(F.lit(1.0), middle + half))


def mde_from_se(se: Column, alpha: float, power: float) -> Column:
    """Effect that a test of this level would find with this power."""
    return F.lit(quantile(1 - alpha / 2) + quantile(power)) * se


def mde_from_discordance(rate: Column, n: Column, alpha: float, power: float) -> Column:
    return mde_from_se(F.sqrt(rate / n), alpha, power)


def mde_from_interval(low: Column, high: Column, alpha: float, power: float) -> Column:
    return mde_from_se(F.greatest(F.lit(0.0), (high - low) / 2) / F.lit(quantile(1 - alpha / 2)), alpha, power)


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series eight steps further on."""
    z = n.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    steps = F.lit(0.0)
    for k in range(1, 9):
        steps = steps + F.log(n.cast("double") + k)
    return series - steps


def mcnemar_p(control_only: Column, treatment_only: Column) -> Column:
    """Two-sided exact p over the discordant pairs; 1 if there are none.

    The tail is summed downwards from its largest term, relative to it; beyond ten standard deviations no term counts.
    """
    d, m = (control_only + treatment_only).cast("double"), F.least(control_only, treatment_only)
    far = F.least(m, F.ceil(5 * F.sqrt(d)).cast("long") + 64)
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), far.cast("long")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, k: F.struct((s["term"] * (m - k) / (d - m + k + 1)).alias("term"), (s["total"] + s["term"]).alias("total")),
    )["total"]
    top = log_factorial(d) - log_factorial(m) - log_factorial(d - m) - d * math.log(2)
    return F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * tail))


def holm(rows: DataFrame, p: str, ties: list[str], family: list[str] | None = None) -> DataFrame:
    """Adds ``adjusted``: step-down p-values of each family of tests (one row per test; one family unless columns name it)."""
    whole = Window.partitionBy(*(family or [F.lit(0)]))
    order = whole.orderBy(p, *ties)
    ranked = rows.withColumns({"_i": F.row_number().over(order), "_m": F.count(F.lit(1)).over(whole)})
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))).over(running)
    # an undefined p stays undefined; the cut at 1 would hide it
    return ranked.withColumn("adjusted", F.when(_finite(F.col(p)), stepped)).drop("_i", "_m")


def _finite(x: Column) -> Column:
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # NaN is above everything


def gate(point: Column, low: Column, high: Column, adjusted: Column, alpha: float, min_effect: float, require_positive: bool = True) -> Column:
    """``established``, or the first of REFUSALS that holds. A null, NaN or infinite figure, a reversed interval and a p outside
    [0, 1] refuse; values equal to a limit pass."""
    sound = _finite(point) & _finite(low) & _finite(high) & _finite(adjusted)
    return (
        F.when(~sound | (adjusted < 0) | (adjusted > 1) | (low > high), "undefined")
        .when(adjusted > alpha, "p")
        .when(~((low > 0) | (high < 0)), "zero")
        .when(F.abs(point) < min_effect, "small")
        .when(F.lit(require_positive) & (point <= 0), "sign")
        .otherwise(ESTABLISHED)
    )


def covering(low: Column, high: Column, point: Column) -> tuple[Column, Column]:
    """The interval, widened where needed to hold the point."""
    return F.least(low, point), F.greatest(high, point)


def purity(reported: Column, attributed: Column) -> tuple[Column, Column]:
    """Assayed score, not below 0, and its share of the reported one; null where nothing was reported."""
    assayed = F.greatest(F.lit(0.0), reported - attributed)
    return assayed, F.when(reported > 0, assayed / reported)


def jackknife(rows: DataFrame, value: str) -> Column:
    """The mean of a column without the row at hand; null where one row is all there is. One aggregate is read, two numbers."""
    total = rows.agg(F.sum(value).alias("s"), F.count(value).alias("n")).first()
    return (F.lit(total["s"]) - F.col(value)) / F.lit(total["n"] - 1 if total["n"] > 1 else None)


def percentile_interval(value: Column, alpha: float) -> tuple[Column, Column]:
    """Aggregates: the quantiles that leave alpha outside, half on each side."""
    return F.percentile(value, alpha / 2), F.percentile(value, 1 - alpha / 2)
