"""Model evaluation on grouped scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.bands import band_closed_open
from ..sources.work import FILE, ROW, release, sorted_table
from .quantiles import exact_quantiles, kept, small


def ranked(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """(by, s, pos, neg) per distinct score, written in their order; null scores are left out."""
    by = by or []
    grouped = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(
        F.count(F.when(F.col(target) == 1, 1)).alias("pos"), F.count(F.when(F.col(target) == 0, 1)).alias("neg")
    )
    return sorted_table(grouped, *by, "s")


@dataclass
class Stretch:
    """Sums over consecutive scores in ascending order. ``a`` is the number of
    negatives below a score and half of those at it, ``c`` the same of
    positives; ``gap`` the largest (negatives below) / N - (positives below) / P.
    """

    pos: float = 0.0
    neg: float = 0.0
    a: float = 0.0
    a2: float = 0.0
    c: float = 0.0
    c2: float = 0.0
    gap: float = -np.inf

    @classmethod
    def of(cls, pos: np.ndarray, neg: np.ndarray, all_pos: float, all_neg: float) -> Stretch:
        pos, neg = pos.astype(np.float64), neg.astype(np.float64)
        below_pos, below_neg = np.cumsum(pos) - pos, np.cumsum(neg) - neg
        a, c = below_neg + neg / 2, below_pos + pos / 2
        gap = float((below_neg / all_neg - below_pos / all_pos).max()) if all_pos and all_neg else -np.inf
        return cls(*map(float, (pos.sum(), neg.sum(), pos @ a, pos @ (a * a), neg @ c, neg @ (c * c))), gap)

    def followed_by(self, x: Stretch, all_pos: float, all_neg: float) -> Stretch:
        n, p = self.neg, self.pos
        lift = n / all_neg - p / all_pos if all_pos and all_neg else 0.0
        return Stretch(
            p + x.pos, n + x.neg, self.a + x.a + n * x.pos, self.a2 + x.a2 + 2 * n * x.a + n * n * x.pos,
            self.c + x.c + p * x.neg, self.c2 + x.c2 + 2 * p * x.c + p * p * x.neg, max(self.gap, x.gap + lift),
        )


_SUMS = ("pos", "neg", "a", "a2", "c", "c2", "gap")


def _stretches(totals: dict[tuple, tuple[float, float]], by: list[str], kinds: list[str], scores: DataFrame) -> dict[tuple, Stretch]:
    """The whole stretch of each group. Tasks give the sums of the stretches they
    read, one for each group, file and task; these are joined here in order."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (group, file, first row, stretch), the last one still growing
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).dictionary_encode() for i in range(len(by) + 1)]
            codes = np.stack([k.indices.to_numpy(zero_copy_only=False) if k.null_count == 0 else k.indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys])
            starts = np.concatenate([[0], np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1])
            pos, neg = (batch.column(i).to_numpy(zero_copy_only=False) for i in (-2, -1))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                *group, file, row = (batch.column(i)[start].as_py() for i in range(len(by) + 2))
                one = Stretch.of(pos[start:stop], neg[start:stop], *totals[tuple(group)])
                if held and held[-1][:2] == (tuple(group), file):
                    own = held.pop()
                    held.append((*own[:3], own[3].followed_by(one, *totals[tuple(group)])))
                else:
                    held.append((tuple(group), file, row, one))
        columns = [[g[i] for g, *_ in held] for i in range(len(by))] + [[f for _, f, _, _ in held], [r for _, _, r, _ in held]]
        columns += [[getattr(x, name) for *_, x in held] for name in _SUMS]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=[*by, FILE, ROW, *_SUMS])

    types = [to_arrow_type(scores.schema[b].dataType) for b in by] + [pa.int32(), pa.int64()] + [pa.float64()] * len(_SUMS)
    schema = ", ".join([f"`{b}` {k}" for b, k in zip(by, kinds)] + [f"{FILE} int", f"{ROW} long"] + [f"{x} double" for x in _SUMS])
    out: dict[tuple, Stretch] = {}
    for r in sorted(scores.select(*by, FILE, ROW, "pos", "neg").mapInArrow(sums, schema).collect(), key=lambda r: (r[FILE], r[ROW])):
        group = tuple(r[b] for b in by)
        out[group] = out.get(group, Stretch()).followed_by(Stretch(*(r[x] for x in _SUMS)), *totals[group])
    return out


def _metrics(df: DataFrame, score: str, target: str, by: list[str], level: float | None = None) -> DataFrame:
    """(by, auc, gini, ks, brier, and with ``level`` se, low, high) as a small frame."""
    scores = ranked(df, score, target, by)
    error = F.col("pos") * F.pow(1 - F.col("s"), 2) + F.col("neg") * F.pow("s", 2)
    found = scores.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(error).alias("e")).collect()
    found = [r for r in found if r["P"] is not None]
    totals = {tuple(r[b] for b in by): (float(r["P"]), float(r["N"])) for r in found}
    kinds = [k for c in by for n, k in scores.dtypes if n == c]
    whole = _stretches(totals, by, kinds, scores) if totals else {}
    release(scores)
    rows = []
    for r in found:
        group = tuple(r[b] for b in by)
        x, (p, n) = whole[group], totals[group]
        both = p > 0 and n > 0
        auc = x.a / (p * n) if both else None
        own = [auc, 2 * auc - 1 if both else None, max(x.gap, 0.0) if both else None, r["e"] / (p + n) if p + n else None]
        if level is not None:
            own += _interval(x, auc, level)
        rows.append((*group, *own))
    names = ["auc", "gini", "ks", "brier", *(["se", "low", "high"] if level is not None else [])]
    return df.sparkSession.createDataFrame(rows, ", ".join([f"`{b}` {k}" for b, k in zip(by, kinds)] + [f"{c} double" for c in names]))


def _interval(x: Stretch, auc: float | None, level: float) -> list[float | None]:
    """[standard error, low, high] from the placement values of both classes; null with fewer than two rows in one."""
    if auc is None or x.pos < 2 or x.neg < 2:
        return [None] * 3
    spread = lambda total, squares, count, scale: (squares - total * total / count) / (count - 1) / (scale * scale)
    se = float(np.sqrt(max(0.0, spread(x.a, x.a2, x.pos, x.neg) / x.pos + spread(x.c, x.c2, x.neg, x.pos) / x.neg)))
    z = NormalDist().inv_cdf(0.5 + level / 2)
    return [se, auc - z * se, auc + z * se]


def ranking_metrics(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """(by, auc, gini, ks): ties count half; null where a class is missing. ``by`` names few groups, as models."""
    return _metrics(df, score, target, by or []).drop("brier")


def auc_intervals(df: DataFrame, models: dict[str, str], target: str, level: float = 0.95) -> DataFrame:
    """(model, auc, se, low, high, gini, gini_low, gini_high) of several score columns of one frame.

    The variance of the area comes from the placement values of the two classes
    (a positive's is the share of negatives below it, ties by half), which are
    sums over distinct scores; null where a class has fewer than two rows.
    """
    m = _metrics(_long(df, models, target), "p", "y", ["model"], level)
    twice = lambda c: (2 * F.col(c) - 1)
    return m.select("model", "auc", "se", "low", "high", "gini", twice("low").alias("gini_low"), twice("high").alias("gini_high"))


#: Scores of one window in :func:`placements`.
CHUNK = 65_536


def placements(df: DataFrame, score: str, target: str) -> DataFrame:
    """(s, v_pos, v_neg) per distinct score: the share of negatives below it and
    of positives above it, ties by half; null where a class is missing.

    Scores are written in their order and cut into chunks of CHUNK, whose sums
    are added up on the driver; a window sees one chunk.
    """
    table = ranked(df, score, target)
    chunk = F.floor(F.col(ROW) / CHUNK).alias("chunk")
    sums = table.groupBy(FILE, chunk).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).orderBy(FILE, "chunk").collect()
    rows, p, n = [], 0, 0
    for r in sums:
        rows.append((r[FILE], r["chunk"], p, n))
        p, n = p + r["p"], n + r["n"]
    before = df.sparkSession.createDataFrame(rows, f"{FILE} int, chunk long, p_before long, n_before long")
    inside = Window.partitionBy(FILE, "chunk").orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c, b: F.col(b) + F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(c) / 2.0
    return table.withColumn("chunk", chunk).join(before, [FILE, "chunk"]).select(
        "s", (below("neg", "n_before") / F.lit(n or None)).alias("v_pos"), (1 - below("pos", "p_before") / F.lit(p or None)).alias("v_neg"),
    )


def auc_difference(df: DataFrame, first: str, second: str, target: str, level: float = 0.95) -> DataFrame:
    """(auc_first, auc_second, difference, se, low, high) of two score columns on
    the same rows: the paired interval, from the covariances of placement values
    over rows. Rows where a score is null are left out; null where a class has fewer than two rows."""
    rows = df.select(F.col(first).alias("_a"), F.col(second).alias("_b"), F.col(target).cast("int").alias("_y")).dropna()
    for c, k in (("_a", 1), ("_b", 2)):
        own = placements(rows, c, "_y").select(F.col("s").alias(c), F.col("v_pos").alias(f"p{k}"), F.col("v_neg").alias(f"n{k}"))
        rows = rows.join(own, c)
    own = lambda y, k: F.when(F.col("_y") == y, F.col(f"{'p' if y else 'n'}{k}"))
    sums = []
    for y in (1, 0):
        sums += [F.count(F.when(F.col("_y") == y, 1)).alias(f"count{y}"), F.var_samp(own(y, 1)).alias(f"v{y}1"), F.var_samp(own(y, 2)).alias(f"v{y}2")]
        sums.append(F.covar_samp(own(y, 1), own(y, 2)).alias(f"c{y}"))
    m = rows.agg(F.avg(own(1, 1)).alias("auc_first"), F.avg(own(1, 2)).alias("auc_second"), *sums)
    part = lambda y: F.when(F.col(f"count{y}") > 1, (F.col(f"v{y}1") + F.col(f"v{y}2") - 2 * F.col(f"c{y}")) / F.col(f"count{y}"))
    z = NormalDist().inv_cdf(0.5 + level / 2)
    m = m.withColumn("difference", F.col("auc_first") - F.col("auc_second")).withColumn("se", F.sqrt(F.greatest(part(1) + part(0), F.when(part(1).isNotNull() & part(0).isNotNull(), F.lit(0.0)))))
    return m.select("auc_first", "auc_second", "difference", "se", (F.col("difference") - z * F.col("se")).alias("low"), (F.col("difference") + z * F.col("se")).alias("high"))


def brier(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(score) - F.col(target), 2)).alias("brier"))


def _long(df: DataFrame, models: dict[str, str], target: str) -> DataFrame:
    """(y, model, p): a row for each row and model."""
    return df.select(
        F.col(target).alias("y"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in models.items()])).alias("x"),
    ).select("y", "x.model", "x.p")


def model_summary(scores: DataFrame, models: dict[str, str], target: str) -> DataFrame:
    """(model, auc, gini, ks, brier) of several score columns of one frame, which is read once."""
    return _metrics(_long(scores, models, target), "p", "y", ["model"])


def calibration(df: DataFrame, score: str, target: str, bins: int = 8) -> DataFrame:
    """(bin, n, mean_score, observed) over ``[lo, hi)`` bands of the score's own quantiles; empty bands are left out."""
    return calibrations(df, {"": score}, target, bins).drop("model")


def calibrations(df: DataFrame, models: dict[str, str], target: str, bins: int = 8) -> DataFrame:
    """(model, bin, n, mean_score, observed) of several score columns of one frame, each over its own bands."""
    with kept(df.select(*set(models.values()), target)) as scores:
        inner = exact_quantiles(scores, sorted(set(models.values())), [i / bins for i in range(1, bins)], keep=False)
        band = F.lit(None).cast("int")
        for m, c in models.items():
            band = F.when(F.col("model") == m, band_closed_open(F.col("p"), inner[c])).otherwise(band)
        return small(_long(scores, models, target).groupBy("model", band.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_score"), F.avg("y").alias("observed")
        ))


def approval_threshold(df: DataFrame, score: str, share: float = 0.80) -> float | None:
    """The score up to which ``share`` of the rows would be approved (ties may approve more)."""
    cut = exact_quantiles(df, [score], [share])[score]
    return cut[0] if cut else None


def swap_set(df: DataFrame, champion: str, challenger: str, target: str, share: float = 0.80) -> DataFrame:
    """(cell, n, bad_rate) of approved by both, swap-in (challenger only) and swap-out (champion only); always three rows."""
    with kept(df.select(champion, challenger, F.col(target).alias("_y"))) as scores:
        return small(_swap_cells(scores, champion, challenger, share))


def _swap_cells(df: DataFrame, champion: str, challenger: str, share: float) -> DataFrame:
    cuts = exact_quantiles(df, [champion, challenger], [share], keep=False)
    old = F.col(champion) <= F.lit(cuts[champion][0] if cuts[champion] else None)
    new = F.col(challenger) <= F.lit(cuts[challenger][0] if cuts[challenger] else None)
    cell = F.when(old & new, "both").when(~old & new, "swap_in").when(old & ~new, "swap_out")
    cells = df.sparkSession.createDataFrame([("both",), ("swap_in",), ("swap_out",)], "cell string")
    counted = df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("bad_rate"))
    return F.broadcast(cells).join(counted, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"), "bad_rate")


def swap_verdict(cells: DataFrame) -> DataFrame:
    """(delta, verdict): swapped-in less swapped-out bad rate; null where either is empty."""
    rate = lambda c: F.max(F.when(F.col("cell") == c, F.col("bad_rate")))
    delta = cells.agg((rate("swap_in") - rate("swap_out")).alias("delta"))
    return delta.withColumn("verdict", F.when(F.col("delta") < 0, "BETTER").when(F.col("delta").isNotNull(), "WORSE"))


def swap_intervals(cells: DataFrame, level: float = 0.95) -> DataFrame:
    """``cells`` of :func:`swap_set` with low and high: the score interval of each bad rate, null for an empty cell."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    n, p = F.col("n"), F.col("bad_rate")
    middle, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    return cells.select("cell", "n", "bad_rate", F.when(n > 0, middle - spread).alias("low"), F.when(n > 0, middle + spread).alias("high"))


def swap_delta_interval(cells: DataFrame, draws: int = 2000, seed: int = 5, level: float = 0.95) -> tuple[float, float] | None:
    """Bootstrap interval of the swapped-in less the swapped-out bad rate.

    With a Poisson weight for each row, the rows of a cell and outcome weigh a
    Poisson number with their count as mean; so four draws stand for a pass over
    the table. Draws with an empty cell are left out; None without any.
    """
    count = {r["cell"]: (r["n"], round(r["n"] * (r["bad_rate"] or 0.0))) for r in cells.collect()}
    means = [x for c in ("swap_in", "swap_out") for n, bad in [count.get(c, (0, 0))] for x in (bad, n - bad)]
    bad_in, good_in, bad_out, good_out = np.random.default_rng(seed).poisson(means, (draws, 4)).T
    fit = (bad_in + good_in > 0) & (bad_out + good_out > 0)
    if not fit.any():
        return None
    delta = bad_in[fit] / (bad_in + good_in)[fit] - bad_out[fit] / (bad_out + good_out)[fit]
    return tuple(float(x) for x in np.quantile(delta, [0.5 - level / 2, 0.5 + level / 2]))


def riskiest(df: DataFrame, score: str, key: str, k: int = 2) -> DataFrame:
    """The ``k`` rows with the highest score; ties by key."""
    return df.orderBy(F.desc(score), key).limit(k)
