"""Weight-of-evidence binning.

The source is read once, whatever the number of features: the features and the
target are kept while two or three jobs find all quantile edges and one counts
(feature, interval, n, bad). Merging bins only adds intervals up, so it is a
fold over a handful of integers; the fitted binning is plain numbers that
become column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import band_open_closed
from .quantiles import exact_quantiles, kept

SMOOTHING = 0.5


@dataclass(frozen=True)
class Bin:
    label: str
    lo: float
    hi: float
    n: int
    n_bad: int
    bad_rate: float
    woe: float
    iv: float


@dataclass(frozen=True)
class Reserved(Bin):
    """A cell beside the intervals, for one special value or, with ``value`` None, for missing ones (null and NaN)."""

    value: float | None = None

    def holds(self, x: Column) -> Column:
        return x.isNull() | F.isnan(x) if self.value is None else F.coalesce(x == F.lit(self.value), F.lit(False))


@dataclass(frozen=True)
class Binning:
    """A feature's bins in order; ``(lo, hi]``, the outer ends infinite. Reserved
    cells come after them and go before them when a value is looked up."""

    feature: str
    bins: tuple[Bin, ...]
    iv: float
    monotonic: bool
    reserved: tuple[Reserved, ...] = ()

    @property
    def cells(self) -> tuple[Bin, ...]:
        return (*self.bins, *self.reserved)

    def woe(self, x: Column, unmatched: str = "zero") -> Column:
        """Weight of evidence of ``x``. A value in no bin (null, NaN, minus
        infinity, a gap) gets 0, or with ``unmatched="last"`` the last bin's."""
        if unmatched == "last" and not self.bins:
            raise ValueError(f"{self.feature} has no bins to look a value up in")
        out = F.lit(self.bins[-1].woe if unmatched == "last" else 0.0)
        for b in reversed(self.bins):
            out = F.when((x > F.lit(b.lo)) & (x <= F.lit(b.hi)), F.lit(b.woe)).otherwise(out)
        for r in self.reserved:
            out = F.when(r.holds(x), F.lit(r.woe)).otherwise(out)
        return out

    def index(self, x: Column) -> Column:
        """Number of the cell of ``x``; the last bin's where none holds it."""
        if not self.bins:
            raise ValueError(f"{self.feature} has no bins to look a value up in")
        out = F.lit(len(self.bins) - 1)
        for i, b in reversed(list(enumerate(self.bins))):
            out = F.when((x > F.lit(b.lo)) & (x <= F.lit(b.hi)), F.lit(i)).otherwise(out)
        for i, r in enumerate(self.reserved, len(self.bins)):
            out = F.when(r.holds(x), F.lit(i)).otherwise(out)
        return out


@dataclass
class Intervals:
    """Inner edges and what each interval between them holds, empty ones too."""

    inner: list[float]
    n: list[int]
    bad: list[int]

    def filled(self) -> list[int]:
        return [i for i, n in enumerate(self.n) if n]

    def pop(self, edge: int) -> None:
        """Remove edge number ``edge`` (1 is the first inner one): two intervals become one."""
        del self.inner[edge - 1]
        for counts in (self.n, self.bad):
            counts[edge - 1: edge + 1] = [counts[edge - 1] + counts[edge]]

    def rates(self) -> list[float]:
        return [self.bad[i] / self.n[i] for i in self.filled()]


def is_monotonic(rates: list[float]) -> bool:
    pairs = list(zip(rates, rates[1:]))
    return all(a <= b for a, b in pairs) or all(a >= b for a, b in pairs)


def merge_thin(cells: Intervals, least: float, policy: str = "reference") -> None:
    """Merge bins with fewer than ``least`` rows while more than two are left.

    ``reference``: for the bin at place i (of the filled ones) edge max(i-1, 1)
    goes, which from the third bin on joins the two bins before it. ``adjacent``:
    the thin bin itself joins its neighbour.
    """
    while len(filled := cells.filled()) > 2:
        thin = next((i for i, at in enumerate(filled) if cells.n[at] < least), None)
        if thin is None:
            return
        if policy == "reference":
            cells.pop(max(thin - 1, 1))
        else:
            cells.pop(max(filled[thin], 1))


def merge_monotonic(cells: Intervals) -> None:
    """Merge the worst offender against the overall direction until rates are monotonic or two bins are left."""
    while len(rates := cells.rates()) > 2 and not is_monotonic(rates):
        sign = 1 if rates[0] <= rates[-1] else -1
        drops = [(a - b) * sign for a, b in zip(rates, rates[1:])]
        cells.pop(drops.index(max(drops)) + 1)


def weight_of_evidence(bad: int, good: int, all_bad: int, all_good: int) -> tuple[float, float]:
    """(woe, contribution to the information value), each share smoothed by 0.5."""
    p_bad, p_good = (bad + SMOOTHING) / (all_bad + SMOOTHING), (good + SMOOTHING) / (all_good + SMOOTHING)
    woe = math.log(p_good / p_bad)
    return woe, (p_good - p_bad) * woe


def to_binning(feature: str, cells: Intervals, reserved: dict[float | None, tuple[int, int]] | None = None) -> Binning:
    """``reserved``: rows and bad rows of each special value (None: missing); they
    count towards the totals. One without rows has a weight of 0."""
    ends = [-math.inf, *cells.inner, math.inf]
    reserved = reserved or {}
    all_bad = sum(cells.bad) + sum(bad for _, bad in reserved.values())
    all_good = sum(cells.n) + sum(n for n, _ in reserved.values()) - all_bad
    bins = []
    for i in cells.filled():
        woe, iv = weight_of_evidence(cells.bad[i], cells.n[i] - cells.bad[i], all_bad, all_good)
        label = f"({ends[i]:.4g}, {ends[i + 1]:.4g}]"
        bins.append(Bin(label, ends[i], ends[i + 1], cells.n[i], cells.bad[i], cells.bad[i] / cells.n[i], woe, iv))
    own = []
    for value, (n, bad) in reserved.items():
        woe, iv = weight_of_evidence(bad, n - bad, all_bad, all_good) if n else (0.0, 0.0)
        at = math.nan if value is None else value
        own.append(Reserved("missing" if value is None else f"= {value:.4g}", at, at, n, bad, bad / n if n else math.nan, woe, iv, value))
    return Binning(feature, tuple(bins), sum(b.iv for b in (*bins, *own)), is_monotonic(cells.rates()), tuple(own))


def quantile_edges(df: DataFrame, features: list[str], max_bins: int = 6, keep: bool = True) -> dict[str, list[float] | None]:
    """Inner edges of each feature: its distinct quantiles without the outermost
    two; None for a feature with fewer than two (it gets no bin)."""
    quantiles = exact_quantiles(df, features, [i / max_bins for i in range(max_bins + 1)], keep)
    out: dict[str, list[float] | None] = {}
    for f in features:
        distinct = sorted(set(quantiles[f]))
        out[f] = distinct[1:-1] if len(distinct) > 1 else None
    return out


def interval_counts(df: DataFrame, target: str, edges: dict[str, list[float] | None]) -> DataFrame:
    """(feature, interval, n, bad) for all features in one grouped pass."""
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), band_open_closed(F.col(f).cast("double"), e).alias("interval"))
        for f, e in edges.items() if e is not None
    ])
    return (
        df.select(F.col(target).cast("long").alias("y"), F.explode(cells).alias("c"))
        .groupBy("c.feature", "c.interval").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))
    )


def fit_binnings(
    df: DataFrame, features: list[str], target: str, max_bins: int = 6, min_share: float = 0.05,
    enforce_monotonic: bool = True, merge_policy: str = "reference", merge: bool = True,
    special: dict[str, list[float]] | None = None, missing: bool = False,
) -> dict[str, Binning]:
    """Binnings of all features: quantile intervals, thin ones merged, then
    merged to a monotonic bad rate. ``merge=False`` leaves the intervals.

    ``special`` names values of a feature that mean something of their own, and
    ``missing`` asks the same for null and NaN: each gets a cell beside the
    intervals, which neither quantiles nor merging see.
    """
    held_apart = {f: [*map(float, (special or {}).get(f, [])), *([None] if missing else [])] for f in features}
    x = {f: F.col(f).cast("double") for f in features}
    columns = [F.col(target).cast("long").alias(target)]
    for f, values in held_apart.items():
        cell, plain_value = F.lit(None).cast("int"), x[f]
        for k, v in enumerate(values):
            hit = Reserved("", 0, 0, 0, 0, 0, 0, 0, v).holds(x[f])
            cell, plain_value = F.when(hit, F.lit(k)).otherwise(cell), F.when(~hit, plain_value)
        columns += [plain_value.alias(f)] + ([cell.alias(f"{f} cell")] if values else [])
    with kept(df.select(*columns)) as plain:
        edges = quantile_edges(plain, features, max_bins, keep=False)
        cells = {f: Intervals(list(e), [0] * (len(e) + 1), [0] * (len(e) + 1)) if e is not None else Intervals([], [], []) for f, e in edges.items()}
        if any(e is not None for e in edges.values()):
            for row in interval_counts(plain, target, edges).filter("interval IS NOT NULL").collect():
                cells[row["feature"]].n[row["interval"]] = row["n"]
                cells[row["feature"]].bad[row["interval"]] = row["bad"]
        reserved = _reserved_counts(plain, target, held_apart)
    out = {}
    for f, c in cells.items():
        if merge:
            merge_thin(c, min_share * sum(c.n), merge_policy)
            if enforce_monotonic:
                merge_monotonic(c)
        out[f] = to_binning(f, c, reserved[f])
    return out


def _reserved_counts(plain: DataFrame, target: str, held_apart: dict[str, list[float | None]]) -> dict[str, dict[float | None, tuple[int, int]]]:
    """Rows and bad rows of each reserved cell, from one aggregate."""
    asked = [(f, k) for f, values in held_apart.items() for k in range(len(values))]
    if not asked:
        return {f: {} for f in held_apart}
    hit = lambda f, k: F.col(f"`{f} cell`") == k
    row = plain.agg(*[
        e for i, (f, k) in enumerate(asked)
        for e in (F.count(F.when(hit(f, k), 1)).alias(f"n{i}"), F.sum(F.when(hit(f, k), F.col(target))).alias(f"b{i}"))
    ]).first()
    out: dict[str, dict[float | None, tuple[int, int]]] = {f: {} for f in held_apart}
    for i, (f, k) in enumerate(asked):
        out[f][held_apart[f][k]] = (row[f"n{i}"], row[f"b{i}"] or 0)
    return out


def bin_table(spark: SparkSession, binnings: dict[str, Binning], digits: int = 6) -> DataFrame:
    """(feature, bin, label, lo, hi, n, n_bad, bad_rate, woe, iv), reserved cells after
    the bins, with their value at both ends; infinite and missing ends are null."""
    finite = lambda v: v if math.isfinite(v) else None
    rows = [
        (f, i, b.label, finite(b.lo), finite(b.hi), b.n, b.n_bad, finite(b.bad_rate), b.woe, b.iv)
        for f, binning in binnings.items() for i, b in enumerate(binning.cells)
    ]
    df = spark.createDataFrame(rows, "feature string, bin int, label string, lo double, hi double, n long, n_bad long, bad_rate double, woe double, iv double")
    return df.withColumns({c: F.round(c, digits) for c in ("bad_rate", "woe", "iv")})


def iv_table(spark: SparkSession, binnings: dict[str, Binning]) -> DataFrame:
    """(feature, position, iv, n_bins, monotonic, band), in the order of features."""
    from ..functions.bands import iv_band

    rows = [(f, i, b.iv, len(b.cells), b.monotonic) for i, (f, b) in enumerate(binnings.items())]
    df = spark.createDataFrame(rows, "feature string, position int, iv double, n_bins int, monotonic boolean")
    return df.withColumn("band", iv_band(F.col("iv"))).withColumn("iv", F.round("iv", 6))


def transform(df: DataFrame, binnings: dict[str, Binning], suffix: str = "_woe") -> DataFrame:
    """Adds each feature's weight of evidence as ``<feature><suffix>``."""
    return df.withColumns({f + suffix: b.woe(F.col(f).cast("double")) for f, b in binnings.items()})
