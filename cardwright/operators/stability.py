"""Stability of scores and features over time: population stability index by
vintage, and how bad rates of bands move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import band_closed_open
from .quantiles import exact_quantiles, kept, small

SMOOTHING = 0.5
#: Upper ends of the index's usual readings.
READINGS = ((0.10, "stable"), (0.25, "moderate"))
READING_TOP = "shifted"


def reading(psi: Column) -> Column:
    """``stable`` below 0.10, ``moderate`` below 0.25, else ``shifted``; null stays null."""
    out = F.when(psi.isNotNull(), READING_TOP)
    for end, name in reversed(READINGS):
        out = F.when(psi < end, name).otherwise(out)
    return out


def psi(counts: list[Column], base: list[float]) -> Column:
    """The index of a row's band counts against the shares of the base period.

    Shares are (count + 0.5) / (rows + 0.5 x bands); the index sums
    (share - base) x ln(share / base).
    """
    total = sum(counts, F.lit(0.0)) + SMOOTHING * len(counts)
    out = F.lit(0.0)
    for n, b in zip(counts, base):
        share = (n + SMOOTHING) / total
        out = out + (share - F.lit(b)) * F.ln(share / F.lit(b))
    return out


def base_shares(counts: list[int]) -> list[float]:
    return [(n + SMOOTHING) / (sum(counts) + SMOOTHING * len(counts)) for n in counts]


def band_counts(x: Column, edges: list[float]) -> list[Column]:
    """Aggregates: rows in each ``[lo, hi)`` band between the edges, and at last those without a value (null, NaN)."""
    x = F.when(~F.isnan(x), x)
    band = band_closed_open(x, edges)
    return [F.count(F.when(band == i, 1)) for i in range(len(edges) + 1)] + [F.count(F.when(x.isNull(), 1))]


def stability(df: DataFrame, features: list[str], period: str, base: object = None, bands: int = 10) -> DataFrame:
    """(feature, period, n, psi, reading) of every period.

    Bands are quantiles of the base period (``base``; the first one if not
    given), missing values a band of their own. Two passes over kept columns,
    whatever the number of features; only periods x bands come together. A
    feature without values in the base period has one band beside the missing.
    """
    with kept(df.select(F.col(period).alias("period"), *[F.col(f).cast("double").alias(f) for f in features]).filter("period IS NOT NULL")) as rows:
        first = rows.agg(F.min("period")).first()[0] if base is None else base
        before = rows.filter(F.col("period") == F.lit(first))
        found = exact_quantiles(before, features, [i / bands for i in range(1, bands)], keep=False)
        edges = {f: sorted(set(q)) for f, q in found.items()}
        sums = {f: [c.alias(f"{i}_{k}") for k, c in enumerate(band_counts(F.col(f), edges[f]))] for i, f in enumerate(features)}
        table = small(rows.groupBy("period").agg(F.count(F.lit(1)).alias("n"), *[c for own in sums.values() for c in own]))
    start = table.filter(F.col("period") == F.lit(first)).first()
    parts = []
    for i, f in enumerate(features):
        names = [f"{i}_{k}" for k in range(len(edges[f]) + 2)]
        shares = base_shares([start[c] if start else 0 for c in names])
        parts.append(F.struct(F.lit(f).alias("feature"), psi([F.col(f"`{c}`") for c in names], shares).alias("psi")))
    out = table.select("period", "n", F.explode(F.array(*parts)).alias("x"))
    return out.select("x.feature", "period", "n", "x.psi", reading(F.col("x.psi")).alias("reading"))


def vintage_rates(df: DataFrame, score: str, target: str, period: str, bands: int = 4) -> DataFrame:
    """(period, band, n, bad_rate, shift): the bad rate of each score band by
    period, over bands of all periods together, and its change from the period
    before that has the band. Null scores and periods are left out."""
    from pyspark.sql import Window

    with kept(df.select(F.col(period).alias("period"), F.col(score).cast("double").alias("s"), F.col(target).alias("y")).dropna(subset=["period", "s"])) as rows:
        edges = exact_quantiles(rows, ["s"], [i / bands for i in range(1, bands)], keep=False)["s"]
        table = small(rows.groupBy("period", band_closed_open(F.col("s"), edges).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("bad_rate")))
    before = F.lag("bad_rate").over(Window.partitionBy("band").orderBy("period"))
    return table.withColumn("shift", F.col("bad_rate") - before)
