"""Scoring applications as they arrive.

A card is a pair of column expressions, so a stream is scored by the same plan
as a table. Decisions are watched per window with the fair-lending ratio.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scorecard import Scorecard
from ..operators.stability import band_counts, psi, reading


def score_applications(apps: DataFrame, card: Scorecard, cut: float | None = None) -> DataFrame:
    """``apps`` (a stream or a table) with pd, score and, given a cut on pd, approved."""
    out = apps.withColumns({"pd": card.pd(), "score": card.score()})
    return out if cut is None else out.withColumn("approved", (F.col("pd") <= F.lit(cut)).cast("int"))


def windowed_impact(decisions: DataFrame, time: str, group: str, approved: str = "approved", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, n_1, n_0, rate_1, rate_0, air) per window of event time; rows
    later than the watermark are left out. State is five numbers a window."""
    one, zero = F.col(group) == 1, F.col(group) == 0
    share = lambda g: F.avg(F.when(g, F.col(approved).cast("double")))
    counted = decisions.withWatermark(time, late).groupBy(F.window(time, window)).agg(
        F.count(F.when(one, 1)).alias("n_1"), F.count(F.when(zero, 1)).alias("n_0"), share(one).alias("rate_1"), share(zero).alias("rate_0")
    )
    high = F.greatest("rate_1", "rate_0")
    both = F.col("rate_1").isNotNull() & F.col("rate_0").isNotNull()
    return counted.withColumn("air", F.when(both & (high > 0), F.least("rate_1", "rate_0") / high))


def windowed_stability(rows: DataFrame, time: str, value: str, edges: list[float], base: list[float], window: str = "30 days", late: str = "2 days") -> DataFrame:
    """(window, n, psi, reading) of each window of event time against the base
    period's bands (``edges``) and smoothed shares (``base``, the missing values'
    last). State is a count a band; in append mode a window comes out when the
    watermark has passed its end, and rows later than that are left out."""
    names = [f"n_{i}" for i in range(len(base))]
    counted = rows.withWatermark(time, late).groupBy(F.window(time, window)).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(n) for c, n in zip(band_counts(F.col(value).cast("double"), edges), names)]
    )
    index = psi([F.col(n) for n in names], base)
    return counted.select("window", "n", index.alias("psi"), reading(index).alias("reading"))
