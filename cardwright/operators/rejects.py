"""Reject inference: parcelling, re-weighting, fuzzy augmentation, counterfactual scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.bands import band_closed_open, ratio
from .quantiles import exact_quantiles, kept, small

BANDS = 10
RATE_CAP = 0.999


def parcel_rates(funded: DataFrame, score: str, target: str, n_bands: int = BANDS) -> tuple[list[float], list[float]]:
    """(inner edges of the funded scores' quantile bands, bad rate of each band;
    a band without funded rows has the overall rate)."""
    with kept(funded.select(score, target)) as held:
        inner = exact_quantiles(held, [score], [i / n_bands for i in range(1, n_bands)], keep=False)[score]
        rows = _band_counts(held, score, target, inner)
    bad, n = sum(r["bad"] for r in rows), sum(r["n"] for r in rows)
    known = {r["b"]: r["bad"] / r["n"] for r in rows}
    return inner, [known.get(b, bad / n if n else 0.0) for b in range(len(inner) + 1)]


def _band_counts(funded: DataFrame, score: str, target: str, inner: list[float]) -> list[Row]:
    return funded.groupBy(band_closed_open(F.col(score), inner).alias("b")).agg(F.sum(F.col(target).cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).collect()


def inferred(score: Column, inner: list[float], rates: list[float], multiplier: Column | float) -> Column:
    """Default probability of a reject: its band's rate times the multiplier, at most 0.999."""
    rate = F.get(F.array(*map(F.lit, rates)), band_closed_open(score, inner))
    return F.least(rate * (multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))), F.lit(RATE_CAP))


def parcelling(funded: DataFrame, rejects: DataFrame, score: str, target: str, multiplier: float = 2.0, n_bands: int = BANDS) -> DataFrame:
    """``rejects`` with ``inferred``. Bands are ``[lo, hi)``; the rates of at most
    ``n_bands`` bands become literals, so rejects are neither joined nor shuffled."""
    inner, rates = parcel_rates(funded, score, target, n_bands)
    return rejects.withColumn("inferred", inferred(F.col(score), inner, rates, multiplier))


def multiplier_sweep(
    funded: DataFrame, rejects: DataFrame, score: str, target: str, multipliers: tuple[float, ...] = (1.0, 1.5, 2.0, 3.0, 4.0), n_bands: int = BANDS
) -> DataFrame:
    """(multiplier, inferred_rate, actual_rate, signed_error, best) for each multiplier; of equals the first is best."""
    inner, rates = parcel_rates(funded, score, target, n_bands)
    means = rejects.agg(
        F.avg(F.col(target).cast("double")).alias("actual_rate"),
        F.array(*[
            F.struct(F.lit(i).alias("place"), F.lit(float(k)).alias("multiplier"), F.avg(inferred(F.col(score), inner, rates, k)).alias("inferred_rate"))
            for i, k in enumerate(multipliers)
        ]).alias("each"),
    )
    rows = means.select("actual_rate", F.inline("each")).withColumn("signed_error", F.col("inferred_rate") - F.col("actual_rate"))
    best = rows.agg(F.min(F.struct(F.abs("signed_error").alias("e"), "place"))["place"].alias("best_place"))
    return rows.crossJoin(F.broadcast(best)).select(
        "multiplier", "inferred_rate", "actual_rate", "signed_error", (F.col("place") == F.col("best_place")).alias("best")
    )


def augmentation_weights(df: DataFrame, score: str, approved: str, n_bands: int = BANDS) -> DataFrame:
    """(band, n_all, n_funded, weight): how much a funded row of a band of all
    scores must count to stand for the band; 1 without funded rows."""
    with kept(df.select(score, approved)) as held:
        inner = exact_quantiles(held, [score], [i / n_bands for i in range(1, n_bands)], keep=False)[score]
        counts = small(held.groupBy(band_closed_open(F.col(score), inner).alias("band")).agg(
            F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col(approved) == 1, 1)).alias("n_funded")
        ))
    total = counts.agg(F.sum("n_all").alias("all"), F.sum("n_funded").alias("f"))
    weight = ratio(F.col("n_all") / F.col("all"), F.col("n_funded").cast("double") / F.col("f"))
    return counts.crossJoin(F.broadcast(total)).select("band", "n_all", "n_funded", F.coalesce(weight, F.lit(1.0)).alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, score: str, inner: list[float]) -> DataFrame:
    """Rows with their band's weight; the weights are at most one row a band."""
    return df.withColumn("band", band_closed_open(F.col(score), inner)).join(F.broadcast(weights.select("band", "weight")), "band", "left").fillna(1.0, ["weight"])


def fuzzy_augmentation(rejects: DataFrame, probability: str) -> DataFrame:
    """Every reject twice: as bad (y 1) with its probability as weight w, and as good (y 0) with the rest."""
    p = F.col(probability)
    copies = F.array(F.struct(F.lit(1).alias("y"), p.alias("w")), F.struct(F.lit(0).alias("y"), (1 - p).alias("w")))
    return rejects.select("*", F.explode(copies).alias("_c")).select(*rejects.columns, "_c.y", "_c.w")


def counterfactual(df: DataFrame, inferred_col: str, actual: str) -> DataFrame:
    """(inferred_rate, actual_rate, absolute_error, relative_error, direction); the error keeps
    its sign, and exact equality counts as an under-estimate."""
    m = df.agg(F.avg(inferred_col).alias("inferred_rate"), F.avg(F.col(actual).cast("double")).alias("actual_rate"))
    error = F.col("inferred_rate") - F.col("actual_rate")
    return m.select(
        "inferred_rate", "actual_rate", error.alias("absolute_error"), ratio(error, F.col("actual_rate")).alias("relative_error"),
        F.when(error > 0, "over-estimates").otherwise("under-estimates").alias("direction"),
    )


def hard_labels(df: DataFrame, probability: str, key: str, seed: int = 7) -> DataFrame:
    """Adds ``label``: 1 with the row's probability. The draw hangs on the key and
    the seed, not on partitions, so a retried task draws the same."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    uniform = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    return df.withColumn("label", (uniform < F.col(probability)).cast("int"))


def stack_inferred(funded: DataFrame, rejects: DataFrame, target: str, label: str = "label") -> DataFrame:
    """Funded rows with their outcome and rejects with their drawn label, as one frame."""
    columns = [c for c in funded.columns if c != target]
    return funded.select(*columns, F.col(target).cast("int").alias(target)).unionByName(
        rejects.select(*columns, F.col(label).cast("int").alias(target))
    )
