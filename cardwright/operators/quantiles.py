"""Exact quantiles in few reads.

One job takes an approximate sketch of every column; around each wanted rank it
leaves two edges that surely hold the answer between them. One more counts what
lies at the edges and between them, with the value counts of the gaps in
question, which come to the driver and give the exact order statistics: about
SMALL of them over all columns and ranks together. Where these gaps hold more
rows, a job in between takes finer sketches inside them; a trillion rows need
two of these. The columns are kept for the time of the search, so the source is
read once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 20_000
ACCURACY = 10_000
GRID = 1_000

Interval = tuple[float, float]


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` in the executors' memory and disks while it is worked on."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def small(df: DataFrame) -> DataFrame:
    """A frame of few rows (bins, models, cells, groups), worked out now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@dataclass
class Search:
    """A column's open ranks and its sorted edges. Cell 2 i + 1 is the i-th edge's
    value itself, cell 2 i the open gap below it; values are wanted from some gaps only."""

    ranks: set[int]
    edges: list[float]
    wanted: set[int]

    @classmethod
    def between(cls, ranks: set[int], intervals: list[Interval]) -> Search:
        edges = sorted({e for i in intervals for e in i})
        place = {e: k for k, e in enumerate(edges)}
        return cls(ranks, edges, {2 * k for low, high in intervals for k in range(place[low] + 1, place[high] + 1)})

    def gap(self, cell: int) -> Interval:
        ends = [-math.inf, *self.edges, math.inf]
        return ends[cell // 2], ends[cell // 2 + 1]


def _counted(df: DataFrame, searches: dict[str, Search], apart: bool) -> DataFrame:
    """(column's place, cell, value, n): a row for each task and cell where no
    values are wanted, with a null; else one for each batch and value, or with ``apart`` for each row.

    Arrow batches are dealt to cells by binary search, so rows are not multiplied by columns."""
    asked = [(np.array(s.edges, dtype=np.float64), np.isin(np.arange(2 * len(s.edges) + 1), sorted(s.wanted))) for s in searches.values()]
    names = ["column", "cell", "value", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(wanted), dtype=np.int64) for _, wanted in asked]
        for batch in batches:
            for i, (edges, wanted) in enumerate(asked):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                cell = np.searchsorted(edges, x, "left") + np.searchsorted(edges, x, "right")
                found = np.bincount(cell, minlength=len(wanted))
                totals[i] += np.where(wanted, 0, found)
                if found[wanted].any():
                    inside = x[wanted[cell]]
                    value, n = (inside, np.ones(len(inside), dtype=np.int64)) if apart else np.unique(inside, return_counts=True)
                    at = 2 * np.searchsorted(edges, value, "left")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i), pa.int32()), pa.array(at, pa.int32()), pa.array(value), pa.array(n)], names=names)
        for i, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.nulls(len(at), pa.float64()), pa.array(total[at])], names=names)

    return df.select(*searches).mapInArrow(count, "column int, cell int, value double, n long")


def order_statistics(df: DataFrame, searches: dict[str, Search], inside: float) -> dict[tuple[str, int], float]:
    """The value at each open rank (from 0) of each column's non-null values in
    ascending order; ``inside`` bounds the rows in the wanted gaps."""
    found: dict[tuple[str, int], float] = {}
    while searches:
        fine = inside > SMALL
        cells = _counted(df, searches, apart=fine)
        if fine:
            rows = cells.groupBy("column", "cell").agg(
                F.sum("n").alias("n"), F.percentile_approx("value", [j / GRID for j in range(GRID + 1)], ACCURACY).alias("grid")
            ).collect()
        else:
            rows = cells.groupBy("column", "cell", "value").agg(F.sum("n").alias("n")).collect()
        inside, following = 0.0, {}
        for i, (c, s) in enumerate(searches.items()):
            upto, narrower, left = 0, [], set()
            for r in sorted((r for r in rows if r["column"] == i), key=lambda r: (r["cell"], 0 if fine or r["value"] is None else r["value"])):
                below, upto = upto, upto + r["n"]
                for k in [k for k in s.ranks if below <= k < upto]:
                    if r["cell"] % 2:
                        found[c, k] = s.edges[r["cell"] // 2]
                        continue
                    if r["cell"] in s.wanted and not fine:
                        found[c, k] = r["value"]
                        continue
                    if r["cell"] in s.wanted:
                        at, grid = (k - below) / r["n"] * GRID, r["grid"]
                        low, high, share = grid[max(0, math.floor(at) - 1)], grid[min(GRID, math.ceil(at) + 1)], 5 / GRID
                    else:  # the sketch was farther off than it should be
                        low, high, share = *s.gap(r["cell"]), 1
                    if low == high:
                        found[c, k] = low
                        continue
                    narrower.append((low, high))
                    left.add(k)
                    inside += r["n"] * share
            if left:
                following[c] = Search.between(left, narrower)
        searches = following
    return found


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], keep: bool = True) -> dict[str, list[float]]:
    """Quantiles with linear interpolation between order statistics.

    Null and NaN values are left out. A column without values has no quantiles
    (an empty list). ``keep=False`` where ``df`` is kept already.
    """
    plain = df.select(*[
        F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns
    ])
    if keep:
        with kept(plain) as held:
            return exact_quantiles(held, columns, probs, keep=False)
    step = 2 / ACCURACY
    marks = [min(1.0, max(0.0, p + d)) for p in probs for d in (-step, step)]
    first = plain.agg(*[
        e for i, c in enumerate(columns) for e in (
            F.count(c).alias(f"n{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"), F.percentile_approx(c, marks, ACCURACY).alias(f"q{i}"),
        )
    ]).first()
    rows = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    places = {c: [p * (rows[c] - 1) for p in probs] for c in columns if rows[c]}
    ranks = {c: {f(p) for p in ps for f in (math.floor, math.ceil)} for c, ps in places.items()}
    searches, inside = {}, 0.0
    for i, c in enumerate(columns):
        if not rows[c]:
            continue
        brackets = []
        for j, place in enumerate(places[c]):
            low, high = first[f"q{i}"][2 * j: 2 * j + 2]
            # At the ends the sketch may stop short of the least and the greatest value.
            low = first[f"l{i}"] if place <= 3 * step * rows[c] else low
            high = first[f"h{i}"] if place >= (1 - 3 * step) * (rows[c] - 1) else high
            brackets.append((low, high))
            inside += 4 * step * rows[c] if low < high else 0
        searches[c] = Search.between(ranks[c], brackets)
    at = order_statistics(plain, searches, inside)
    out: dict[str, list[float]] = {c: [] for c in columns}
    for c, ps in places.items():
        for p in ps:
            low, high = at[c, math.floor(p)], at[c, math.ceil(p)]
            out[c].append(low + (high - low) * (p - math.floor(p)))
    return out
