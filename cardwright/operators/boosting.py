"""Boosted trees: a histogram booster with and without monotone constraints.

Rows are cut to bin numbers once and stay in the executors as NumPy blocks.
Trees grow best leaf first. A job reads the blocks once and gives gradient and
hessian sums by (node, feature, bin); the driver sees those sums only and picks
the splits. One job serves all leaves that the rest of the tree may still split,
of each only the child with fewer rows; the other child's sums are what is left
of its parent's. Which leaf is split next stays exact, so a tree of 15 leaves
takes about as many jobs as it is deep, not 14. Trees become column
expressions, or score Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoosterParams:
    """With ``patience``, tables of more than 10,000 rows hold every tenth row
    back, and growth ends when that many rounds have not lowered the loss on them."""

    rounds: int = 40
    learning_rate: float = 0.06
    leaves: int = 15
    min_rows: int = 100
    l2: float = 1.0
    bins: int = 32
    monotone: dict[str, int] = field(default_factory=dict)
    patience: int = 0


@dataclass
class Split:
    feature: str
    edge: float
    left: "Split | float"
    right: "Split | float"

    def column(self) -> Column:
        side = lambda x: x.column() if isinstance(x, Split) else F.lit(float(x))
        return F.when(F.col(self.feature).cast("double") <= F.lit(self.edge), side(self.left)).otherwise(side(self.right))


@dataclass(frozen=True)
class Booster:
    base: float
    trees: list

    def raw(self) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + (tree.column() if isinstance(tree, Split) else F.lit(float(tree)))
        return out

    def pd(self) -> Column:
        return 1 / (1 + F.exp(-self.raw()))

    def batch_pd(self, features: list[str]) -> Column:
        """:meth:`pd` for many trees, whose expression would be too large to compile: worked out on Arrow batches."""
        base, flat = self.base, [_flat(t, features) for t in self.trees]

        @F.pandas_udf("double")
        def score(columns: pd.DataFrame) -> pd.Series:
            x = columns.to_numpy(dtype=np.float64).T
            raw = np.full(x.shape[1], base)
            for tree in flat:
                raw += tree[3][_walk(tree, x)]
            return pd.Series(1 / (1 + np.exp(-raw)))

        return score(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))


# A flat tree: by node the feature's place, the cut, the left child (the right one follows; -1 in a leaf), the value.

def _flat(tree: Split | float, features: list[str]) -> tuple[np.ndarray, ...]:
    rows, todo = [[0, 0.0, -1, 0.0]], [(0, tree)]
    while todo:
        at, node = todo.pop()
        if isinstance(node, Split):
            rows[at] = [features.index(node.feature), node.edge, len(rows), 0.0]
            todo += [(len(rows), node.left), (len(rows) + 1, node.right)]
            rows += [[0, 0.0, -1, 0.0], [0, 0.0, -1, 0.0]]
        else:
            rows[at][3] = float(node)
    return _arrays(rows)


def _arrays(rows: list[list]) -> tuple[np.ndarray, ...]:
    f, c, left, v = zip(*rows)
    return np.array(f, np.intp), np.array(c, float), np.array(left, np.intp), np.array(v, float)


def _walk(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node at which each column of ``x`` (features by rows) ends; what is not <= the cut goes right, NaN too."""
    feature, cut, left, _ = tree
    kind = np.uint8 if len(left) <= 256 else np.intp
    cuts = (cut.astype(np.intp) if x.dtype.kind in "iu" else cut).tolist()
    node = np.zeros(x.shape[1], kind)
    # Split by split, parents first: a few passes over bytes cost less than one lookup of each row's own cut.
    for k in np.flatnonzero(left >= 0).tolist():
        at = node == k
        node += at.astype(kind) * kind(left[k] - k)
        at &= ~(x[feature[k]] <= cuts[k])
        node += at
    return node


BLOCK_ROWS, TASK_ROWS = 200_000, 25_000
#: A task holds more rows than TASK_ROWS where there are tasks enough for all cores, as each costs time of its own in every job.
MOST_TASK_ROWS = 1_000_000
HELD_FROM, TOLERANCE = 10_000, 1e-7
#: Rounds after which the blocks are rewritten with their scores so far.
ADVANCE = 5
#: Cells of features with few bins that are counted together.
JOINT_CELLS = 256


def _blocks(df: DataFrame, features: list[str], edges: list[np.ndarray], target: str, n: int, held: bool) -> RDD:
    """((bins by feature and row, label, raw score) of rows to learn from, the same of rows held back) of about BLOCK_ROWS rows."""
    kind = np.uint8 if max(map(len, edges)) < 256 else np.uint16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.stack([np.searchsorted(e, b.column(k + 2).to_numpy(zero_copy_only=False), "left") for k, e in enumerate(edges)]).astype(kind)
            y = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint8)
            back = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, y, back)], names=["bins", "y", "held"])

    def block(own: list[tuple]) -> tuple:
        bins, y, back = (np.concatenate(x, axis=-1) for x in zip(*own))
        return tuple((np.ascontiguousarray(bins[:, at]), y[at], np.zeros(len(at))) for at in (np.flatnonzero(~back), np.flatnonzero(back)))

    def join(rows: Iterator) -> Iterator[tuple]:
        own, size = [], 0
        for r in rows:
            own.append((np.frombuffer(r["bins"], kind).reshape(len(edges), -1), np.frombuffer(r["y"], np.uint8), np.frombuffer(r["held"], np.uint8) == 1))
            size += len(own[-1][1])
            if size >= BLOCK_ROWS:
                yield block(own)
                own, size = [], 0
        if size:
            yield block(own)

    columns = [F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)]
    back = F.pmod(F.xxhash64(target, *[F.col(f).cast("double") for f in features]), F.lit(10)) == 0 if held else F.lit(False)
    packed = df.select(F.col(target).cast("int").alias("y"), back.alias("held"), *columns).mapInArrow(pack, "bins binary, y binary, held binary").rdd
    enough = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // MOST_TASK_ROWS))
    return packed.coalesce(min(packed.getNumPartitions(), max(1, -(-n // TASK_ROWS)), enough)).mapPartitions(join)


def _joint(sizes: list[int]) -> list[list[int]]:
    """Places of features in groups: those with few bins share one of up to JOINT_CELLS cells, others are alone."""
    groups, cells = [], JOINT_CELLS + 1
    for f in sorted(range(len(sizes)), key=lambda f: sizes[f]):
        if cells * sizes[f] <= JOINT_CELLS:
            groups[-1].append(f)
            cells *= sizes[f]
        else:
            groups.append([f])
            cells = sizes[f]
    return groups


def _histograms(bins: np.ndarray, own: np.ndarray | None, slots: int, weights: tuple, sizes: list[int]) -> np.ndarray:
    """Sums of each of ``weights`` (None counts rows) by (weight, feature, slot, bin); ``own`` is each row's slot."""
    out = np.zeros((len(weights), len(sizes), slots, max(sizes)))
    for group in _joint(sizes):
        shape = [sizes[f] for f in group]
        cells, at = math.prod(shape), bins[group[0]].astype(np.intp)
        for f in group[1:]:
            at *= sizes[f]
            at += bins[f]
        if own is not None:
            at += own * cells
        for k, w in enumerate(weights):
            found = np.bincount(at, w, slots * cells).reshape(slots, *shape)
            for i, f in enumerate(group):
                others = tuple(j + 1 for j in range(len(group)) if j != i)
                out[k, f, :, : sizes[f]] = found.sum(axis=others)
    return out


def _raw(rows: tuple, base: float, trees: list) -> np.ndarray:
    return base + rows[2] + sum((t[3][_walk(t, rows[0])] for t in trees), 0.0)


def _gather(blocks: RDD, base: float, trees: list, grown: tuple, active: list[int], sizes: list[int]) -> tuple[np.ndarray, float, int]:
    """Sums (gradient, hessian, rows) by active node, feature and bin; with the root alone, the loss and number of rows held back, too."""
    slot = np.full(len(grown[0]), -1)
    slot[active] = np.arange(len(active))
    root = len(grown[0]) == 1

    def sums(part: Iterator[tuple]) -> Iterator[tuple]:
        out, loss, n = None, 0.0, 0
        for rows, back in part:
            own = None
            if root:
                if len(back[1]):
                    raw = _raw(back, base, trees)
                    loss, n = loss + float((np.logaddexp(0, raw) - back[1] * raw).sum()), n + len(raw)
            else:
                own = slot[_walk(grown, rows[0])]
                keep = np.flatnonzero(own >= 0)
                own, rows = own[keep], (rows[0].take(keep, axis=1), *(x[keep] for x in rows[1:]))
            p = 1 / (1 + np.exp(-_raw(rows, base, trees)))
            each = _histograms(rows[0], own, len(active), (p - rows[1], p * (1 - p), None), sizes)
            out = each if out is None else out + each
        if out is not None:
            yield out, loss, n

    plus = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
    parts = blocks.mapPartitions(sums)
    out, loss, n = parts.treeReduce(plus) if blocks.getNumPartitions() > 64 else parts.reduce(plus)
    return out.transpose(2, 0, 1, 3), loss, n


def _leaf(g, h, p: BoosterParams, low: float, high: float):
    return np.minimum(np.maximum(-g / (h + p.l2 + 1e-12), low), high)


class _Node:
    """A node of a growing tree: its sums (gradient, hessian, rows by feature and
    bin), the bounds of its value, its best split and, once asked for, its
    children; ``split`` says that they count."""

    __slots__ = ("sums", "low", "high", "value", "best", "left", "right", "split")

    def __init__(self, low: float, high: float, value: float):
        self.low, self.high, self.value = low, high, value
        self.sums = self.best = self.left = self.right = None
        self.split = False

    def rows(self, every: bool) -> tuple[list[list], list[_Node]]:
        """The flat tree below, and its nodes in the same order; ``every``: with children that do not count yet."""
        rows, nodes = [[0, 0.0, -1, self.value]], [self]
        for at, node in enumerate(nodes):  # grows while it is read
            if node.split or every and node.left is not None:
                rows[at][:3] = [node.best[1], float(node.best[2]), len(nodes)]
                for child in (node.left, node.right):
                    rows.append([0, 0.0, -1, child.value])
                    nodes.append(child)
        return rows, nodes


class _Growth:
    """Grows trees on what ``gather(flat tree, active rows)`` sums up."""

    def __init__(self, features: list[str], edges: list[np.ndarray], params: BoosterParams, gather: Callable):
        self.p, self.gather = params, gather
        self.way = np.array([params.monotone.get(f, 0) for f in features])
        self.last = np.array([len(e) for e in edges])[:, None]

    def root(self, sums: np.ndarray) -> _Node:
        node = _Node(-math.inf, math.inf, self.p.learning_rate * float(_leaf(sums[0, 0].sum(), sums[1, 0].sum(), self.p, -math.inf, math.inf)))
        return self._judged(node, sums)

    def _judged(self, node: _Node, sums: np.ndarray) -> _Node:
        """The node with its sums and its best allowed split: (gain, place of the
        feature, bin, middle value); bins up to the one named go left."""
        node.sums, p = sums, self.p
        g, h, n = sums.cumsum(axis=2)
        g_all, h_all, n_all = (x[:, -1:] for x in (g, h, n))
        left, right = _leaf(g, h, p, node.low, node.high), _leaf(g_all - g, h_all - h, p, node.low, node.high)
        whole = _leaf(g_all, h_all, p, node.low, node.high)
        fit = (n >= p.min_rows) & (n_all - n >= p.min_rows) & ((right - left) * self.way[:, None] >= 0) & (np.arange(g.shape[1]) < self.last)
        gain = np.where(fit, g_all * whole - g * left - (g_all - g) * right, 0.0)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > 1e-9:
            node.best = (float(gain[f, b]), int(f), int(b), float(left[f, b] + right[f, b]) / 2)
        return node

    def _open(self, node: _Node) -> None:
        """Children of the best split, without sums; they stay on their side of its middle where the feature has a direction."""
        _, f, b, middle = node.best
        way = self.way[f]
        for is_left in (True, False):
            rising = (way > 0) == is_left
            low = node.low if way == 0 or rising else max(node.low, middle)
            high = node.high if way == 0 or not rising else min(node.high, middle)
            side = node.sums[:, f, : b + 1] if is_left else node.sums[:, f, b + 1:]
            child = _Node(low, high, self.p.learning_rate * float(_leaf(side[0].sum(), side[1].sum(), self.p, low, high)))
            if is_left:
                node.left = child
            else:
                node.right = child

    def _fill(self, root: _Node, wanted: list[_Node]) -> None:
        """Sums of both children of some leaves, from one job that reads each one's smaller child."""
        smaller = []
        for node in wanted:
            self._open(node)
            _, f, b, _ = node.best
            n_left = node.sums[2, f, : b + 1].sum()
            smaller.append(node.left if 2 * n_left <= node.sums[2, f].sum() else node.right)
        rows, nodes = root.rows(every=True)
        place = {id(x): k for k, x in enumerate(nodes)}
        for node, small, sums in zip(wanted, smaller, self.gather(_arrays(rows), [place[id(x)] for x in smaller])):
            other = node.right if small is node.left else node.left
            self._judged(other, node.sums - sums)
            self._judged(small, sums)
            node.sums = None

    def tree(self, root: _Node) -> tuple:
        leaves = [root] if root.best else []
        count = 1
        while leaves and count < self.p.leaves:
            leaves.sort(key=lambda x: x.best[0])
            node = leaves.pop()
            left = self.p.leaves - count
            if left > 1 and node.left is None:
                # Of the leaves still to come, no more than these can be split and have children that matter.
                self._fill(root, [node, *[x for x in leaves[::-1][: left - 2] if x.left is None]])
            elif node.left is None:
                self._open(node)
            node.split = True
            leaves += [x for x in (node.left, node.right) if x.best]
            count += 1
        return _arrays(root.rows(every=False)[0])


def fit_monotone_booster(df: DataFrame, features: list[str], target: str, params: BoosterParams = BoosterParams()) -> Booster:
    """Gradient boosting on the logistic loss with at most ``bins`` quantile bins
    per feature and ``leaves`` leaves a tree, the leaf with the largest gain
    split first. A feature with direction +1 (-1) can only raise (lower) the
    prediction: splits that go the other way are rejected and children stay on
    their side of the split's middle. Rows without a label are left out."""
    p = params
    df = df.filter(F.col(target).isNotNull())
    plain = df.select(*[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)])
    found = plain.approxQuantile(plain.columns, [i / p.bins for i in range(1, p.bins)], 1 / (8 * p.bins))
    edges = [np.array(sorted(set(x))) for x in found]
    sizes = [len(e) + 1 for e in edges]
    rate, n = df.agg(F.avg(F.col(target).cast("double")), F.count(F.lit(1))).first()
    base = math.log(rate / (1 - rate))
    blocks = _blocks(df, features, edges, target, n, p.patience > 0 and n > HELD_FROM).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[tuple] = []
    recent: list[tuple] = []
    losses: list[float] = []
    growth = _Growth(features, edges, p, lambda tree, active: _gather(blocks, base, recent, tree, active, sizes)[0])
    stump = _arrays([[0, 0.0, -1, 0.0]])
    while len(trees) < p.rounds or p.patience:
        # The first job of a round also sees what the last tree did for the rows held back.
        sums, loss, held = _gather(blocks, base, recent, stump, [0], sizes)
        if held:
            losses.append(loss / held)
        # As often as the last rounds have not helped, or all rounds are done.
        if losses and len(losses) > p.patience and min(losses[-p.patience:]) > losses[-p.patience - 1] - TOLERANCE or len(trees) == p.rounds:
            break
        trees.append(growth.tree(growth.root(sums[0])))
        recent.append(trees[-1])
        if len(recent) == ADVANCE:
            def advance(block: tuple, recent: list = recent) -> tuple:
                return tuple((*rows[:2], _raw(rows, 0.0, recent)) for rows in block)

            old, blocks, recent = blocks, blocks.map(advance).persist(StorageLevel.MEMORY_AND_DISK), []
            blocks.count()
            old.unpersist()
    blocks.unpersist()

    def grown(tree: tuple, i: int = 0):
        f, cut, left, value = (x[i] for x in tree)
        return Split(features[f], float(edges[f][int(cut)]), grown(tree, left), grown(tree, left + 1)) if left >= 0 else float(value)

    return Booster(base, [grown(t) for t in trees])


def fit_gbt_candidate(train: DataFrame, test: DataFrame, features: list[str], target: str, rounds: int = 250) -> DataFrame:
    """Test rows with ``pd`` from boosted trees without constraints or penalty."""
    model = fit_monotone_booster(train, features, target, BoosterParams(rounds=rounds, l2=0.0, bins=255, patience=10))
    return test.withColumn("pd", model.batch_pd(features))
