"""Weight of evidence of categorical features.

Levels are counted where they lie. The most frequent ones, a bounded number,
come to the driver with exact counts; the others are counted together as the
rest. Kept levels stand in the order of their smoothed bad rate, and the best
contiguous partition of that order is found by dynamic programming over counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .binning import weight_of_evidence

#: Rows that the overall bad rate counts for in a level's smoothed rate.
PRIOR_ROWS = 20


@dataclass(frozen=True)
class Level:
    """A level with its counts; ``name`` None stands for null."""

    name: str | None
    n: int
    n_bad: int
    rate: float


@dataclass(frozen=True)
class Group:
    """Levels with one weight of evidence; ``rest`` holds all levels that are in no other group."""

    levels: tuple[str | None, ...]
    n: int
    n_bad: int
    woe: float
    iv: float
    rest: bool = False

    @property
    def label(self) -> str:
        return "(rest)" if self.rest else "{" + ", ".join("(null)" if x is None else x for x in self.levels) + "}"


@dataclass(frozen=True)
class CategoricalBinning:
    """Groups in the order of their bad rate, the rest last."""

    feature: str
    groups: tuple[Group, ...]
    iv: float

    def index(self, x: Column) -> Column:
        """Number of the group of ``x``; of a level that was not seen the rest's, or null without a rest."""
        x = x.cast("string")
        out = F.lit(len(self.groups) - 1 if self.groups and self.groups[-1].rest else None).cast("int")
        for i, g in enumerate(self.groups):
            named = [v for v in g.levels if v is not None]
            if named:
                out = F.when(x.isin(named), F.lit(i)).otherwise(out)
            if None in g.levels:
                out = F.when(x.isNull(), F.lit(i)).otherwise(out)
        return out

    def woe(self, x: Column) -> Column:
        """Weight of evidence of ``x``; 0 for a level of no group."""
        if not self.groups:
            return F.lit(0.0)
        return F.coalesce(F.get(F.array(*[F.lit(g.woe) for g in self.groups]), self.index(x)), F.lit(0.0))


def level_counts(df: DataFrame, features: list[str], target: str, keep: int = 1000) -> DataFrame:
    """(feature, level, rest, n, bad): the ``keep`` most frequent levels of each
    feature (ties: null first, then by name) and one row for all others, if any.
    All features are counted in one grouped pass."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features])
    counts = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("long").alias("y"), F.explode(each).alias("x")).groupBy("x.feature", "x.level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")
    )
    # The window's limit is applied before the exchange too, so no task sees all levels of a feature.
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), F.asc_nulls_first("level")))
    top = counts.withColumn("place", place).filter(F.col("place") <= keep).select("feature", "level", F.lit(False).alias("rest"), "n", "bad")
    sums = lambda d: d.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rest = sums(counts).join(sums(top).select("feature", F.col("n").alias("kept_n"), F.col("bad").alias("kept_bad")), "feature")
    return top.unionByName(rest.filter("n > kept_n").select(
        "feature", F.lit(None).cast("string").alias("level"), F.lit(True).alias("rest"), (F.col("n") - F.col("kept_n")).alias("n"), (F.col("bad") - F.col("kept_bad")).alias("bad"),
    ))


def ordered_levels(rows: list, prior: float | None = None) -> list[Level]:
    """Kept levels by smoothed bad rate, (bad + PRIOR_ROWS x overall rate) / (n + PRIOR_ROWS); ties by name, null first."""
    total = sum(r["n"] for r in rows)
    prior = sum(r["bad"] for r in rows) / total if prior is None and total else prior
    out = [Level(r["level"], r["n"], r["bad"], (r["bad"] + PRIOR_ROWS * prior) / (r["n"] + PRIOR_ROWS)) for r in rows if not r["rest"]]
    return sorted(out, key=lambda x: (x.rate, x.name is not None, x.name or ""))


def best_partition(levels: list[Level], all_bad: int, all_good: int, max_bins: int, least: float) -> list[tuple[int, int]]:
    """The contiguous partition (first, behind the last) of ordered levels with
    the largest information value, of at most ``max_bins`` groups with ``least``
    rows each; equal values take fewer groups. Where no group can be large
    enough, all levels are one."""
    m = len(levels)
    if not m:
        return []
    n = np.concatenate([[0], np.cumsum([x.n for x in levels])])
    bad = np.concatenate([[0], np.cumsum([x.n_bad for x in levels])])
    b, g = bad[None, :] - bad[:, None], (n - bad)[None, :] - (n - bad)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        p_bad, p_good = (b + 0.5) / (all_bad + 0.5), (g + 0.5) / (all_good + 0.5)
        iv = (p_good - p_bad) * np.log(p_good / p_bad)
    allowed = (np.arange(m + 1)[None, :] > np.arange(m + 1)[:, None]) & (n[None, :] - n[:, None] >= least)
    iv = np.where(allowed, iv, -np.inf)
    # best[k, j]: the value of the first j levels in k + 1 groups.
    best, come = [iv[0]], [np.zeros(m + 1, dtype=int)]
    for _ in range(1, min(max_bins, m)):
        through = best[-1][:, None] + iv
        come.append(through.argmax(axis=0))
        best.append(through.max(axis=0))
    values = [x[m] for x in best]
    k = max(range(len(values)), key=lambda i: (round(values[i], 12), -i))
    if not math.isfinite(values[k]):
        return [(0, m)]
    cuts = [m]
    for i in range(k, 0, -1):
        cuts.append(int(come[i][cuts[-1]]))
    cuts.append(0)
    cuts.reverse()
    return list(zip(cuts, cuts[1:]))


def fit_categorical(
    df: DataFrame, features: list[str], target: str, max_bins: int = 6, min_share: float = 0.05, keep: int = 1000,
) -> dict[str, CategoricalBinning]:
    """Groups of each feature's levels. Null is a level; levels beyond the
    ``keep`` most frequent ones are the rest, a group of its own that the
    partition does not touch. Rows without a target are left out; a feature
    without rows has no groups."""
    found: dict[str, list] = {f: [] for f in features}
    for row in level_counts(df, features, target, keep).collect():
        found[row["feature"]].append(row)
    return {f: to_categorical(f, rows, max_bins, min_share) for f, rows in found.items()}


def to_categorical(feature: str, rows: list, max_bins: int, min_share: float) -> CategoricalBinning:
    total, all_bad = sum(r["n"] for r in rows), sum(r["bad"] for r in rows)
    levels = ordered_levels(rows)
    groups = []
    for a, b in best_partition(levels, all_bad, total - all_bad, max_bins, min_share * total):
        own = levels[a:b]
        groups.append(_group(tuple(x.name for x in own), sum(x.n for x in own), sum(x.n_bad for x in own), all_bad, total - all_bad))
    groups += [_group((), r["n"], r["bad"], all_bad, total - all_bad, True) for r in rows if r["rest"]]
    return CategoricalBinning(feature, tuple(groups), sum(g.iv for g in groups))


def _group(levels: tuple, n: int, n_bad: int, all_bad: int, all_good: int, rest: bool = False) -> Group:
    return Group(levels, n, n_bad, *weight_of_evidence(n_bad, n - n_bad, all_bad, all_good), rest)


def level_table(spark: SparkSession, rows: list) -> DataFrame:
    """(feature, position, level, n, n_bad, rate) of rows of :func:`level_counts`: kept levels in order, the rest last without a rate."""
    out = []
    for f in dict.fromkeys(r["feature"] for r in rows):
        own = [r for r in rows if r["feature"] == f]
        levels = ordered_levels(own)
        out += [(f, i, x.name, False, x.n, x.n_bad, x.rate) for i, x in enumerate(levels)]
        out += [(f, len(levels), None, True, r["n"], r["bad"], None) for r in own if r["rest"]]
    return spark.createDataFrame(out, "feature string, position int, level string, rest boolean, n long, n_bad long, rate double")


def group_table(spark: SparkSession, binnings: dict[str, CategoricalBinning]) -> DataFrame:
    """(feature, bin, levels, rest, n, n_bad, woe, iv), levels sorted, null first."""
    named = lambda g: sorted(g.levels, key=lambda x: (x is not None, x or ""))
    rows = [(f, i, named(g), g.rest, g.n, g.n_bad, g.woe, g.iv) for f, b in binnings.items() for i, g in enumerate(b.groups)]
    return spark.createDataFrame(rows, "feature string, bin int, levels array<string>, rest boolean, n long, n_bad long, woe double, iv double")
