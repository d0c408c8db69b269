"""Components of sets of word shingles that meet in signatures.

A join signs every distinct set; sets with a common signature are candidates.
Candidates are not multiplied out. Within a signature group the members'
parity sketches (the shingles' hashes modulo a power of two, counted modulo 2)
differ in no more bits than the sets differ in elements, so a larger distance
proves that two sets do not link. A sketch has four bits or more per shingle,
within bounds, and folds to half its length to meet a shorter one. Of the
remaining pairs a group reports a minimum spanning forest; these are verified
on the texts' own shingles, every set's nearest pair first, and then those
whose ends are not in one component by that.

Groups above BLOCK members are dealt as pairs of blocks over several tasks:
first every block with itself and with block 0, which is linear in the group
and enough where its members are copies of each other; then, only for groups
whose members are still in several components, the other pairs of blocks.

A forest edge that is no link, and whose ends no other links join, leaves its
two components in doubt: other pairs of theirs may be links. Components that
such edges connect make a cluster, and every pair still possible lies inside
one. Clusters are settled in rounds. In each, every component but a cluster's
largest reports its nearest possible pairs with other components, NEAREST at
first and sixteen times as many each round; these are verified and components
merge. A cluster is settled when no component had more pairs than it reported.
Rows are one per set and NEAREST per component, never all pairs, and no link is
lost. Clusters of more than two blocks are compared by signature group instead.

Sets are told apart by 128 bits. The signatures carry 64 of them: sets that
agree in these only bring more candidates, and are candidates themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashable, materialise, release, shuffle_partitions, tidy
from .components import connected_components
from .shingles import mix, shingle_sets, shingles

SKETCH_BITS = (512, 16_384)
BLOCK = 2048
NEAREST = 16
#: Sets that a task remembers to have signed; forgetting some only costs a repeated row.
SEEN = 1 << 20

#: Sorted distinct 64-bit shingle hashes of one set -> its signatures (int64).
Signer = Callable[[np.ndarray], np.ndarray]


def sketch(elements: np.ndarray) -> bytes:
    """Parity of the number of elements in each cell, a bit each."""
    bits = SKETCH_BITS[0]
    while bits < min(4 * len(elements), SKETCH_BITS[1]):
        bits *= 2
    at = (mix(elements, seed=11) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all folded to the shortest one's length."""
    words = [np.frombuffer(x, dtype=np.uint64) for x in sketches]
    least = min(map(len, words))
    for i, w in enumerate(words):
        while len(w) > least:
            w = w[: len(w) // 2] ^ w[len(w) // 2:]
        words[i] = w
    return np.stack(words)


def _describe(words: int):
    """Appends n_shingles, high, low and sketch to rows with ``text`` as the last column, which goes."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_described(batch.column(batch.num_columns - 1).to_pylist(), words))
            n, high, low, sketches = zip(*sets) if sets else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sketches, pa.binary())],
                names=[*batch.schema.names[:-1], "n_shingles", "high", "low", "sketch"],
            )

    return describe


def _described(texts: list[str | None], words: int) -> Iterator[tuple]:
    for s, key in shingle_sets(texts, words):
        yield len(s), *(key or (None, None)), sketch(s) if key else None


def _sign(words: int, signer: Signer):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # copies within the task sign once
        for pdf in batches:
            ids, signed, held = [], [], 0
            for s, key in shingle_sets(pdf["text"].tolist(), words):
                if key is None or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                signed.append(signer(s))
                ids.append(key[1])
                held += len(signed[-1])
                if held > 500_000:
                    yield _rows(ids, signed)
                    ids, signed, held = [], [], 0
            if ids:
                yield _rows(ids, signed)

    def _rows(ids: list[int], signed: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"sig": np.concatenate(signed), "low": np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in signed])})

    return sign


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by (sig, low): the distinct ones whose signature has
    two sets or more, numbered within the signature. Only the last rows of a
    batch are held."""
    none = np.zeros(0, dtype=np.int64)
    sig, ids, rank0, emitted = none, none, 0, False
    for pdf in batches:
        sig = np.concatenate([sig, pdf["sig"].to_numpy()])
        ids = np.concatenate([ids, pdf["low"].to_numpy()])
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        sig, ids = sig[fresh], ids[fresh]
        first = np.flatnonzero(np.diff(sig, prepend=sig[0] - 1 if sig[0] > -(2**63) else sig[0] + 1))
        sizes = np.diff(np.append(first, len(sig)))
        rank = np.arange(len(sig)) - np.repeat(first, sizes)
        rank[: sizes[0]] += rank0
        keep = np.repeat(sizes > 1, sizes)
        keep[: sizes[0]] |= rank0 > 0
        # The last row waits: the next batch may continue its signature.
        last_single = sizes[-1] == 1 and not (len(sizes) == 1 and rank0 > 0)
        out = keep.copy()
        if len(sizes) == 1 and emitted:
            out[0] = False  # the row carried over was given out before
        elif emitted:
            out[0] = False
        if out.any():
            yield pd.DataFrame({"sig": sig[out], "rank": rank[out], "low": ids[out]})
        rank0, emitted = int(rank[-1]), not last_single
        sig, ids = sig[-1:], ids[-1:]


def _distance_limit(n_a: np.ndarray, n_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most elements by which linked sets of these sizes differ; -1 where the sizes rule a link out."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return np.where(small * den >= large * num, (n_a + n_b) * (den - num) // (den + num), -1)


def _forest(bits: np.ndarray, n: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Minimum spanning forest over the pairs that the sketches leave possible."""
    m = len(n)
    best, parent = np.full(m, np.inf), np.full(m, -1)
    left = np.arange(m)
    edges = []
    while len(left):
        at = int(np.argmin(best[left]))
        node = left[at]
        if np.isfinite(best[node]):
            edges.append((int(parent[node]), int(node)))
        left = np.delete(left, at)
        apart = np.bitwise_count(bits[left] ^ bits[node]).sum(axis=1, dtype=np.int64)
        limit = _distance_limit(n[left], n[node], num, den)
        cost = np.where(apart <= limit, apart / (n[left] + n[node]), np.inf)
        nearer = cost < best[left]
        best[left[nearer]], parent[left[nearer]] = cost[nearer], node
    return edges


def _nearest(bits: np.ndarray, n: np.ndarray, component: np.ndarray, num: int, den: int, most: int) -> tuple[list[tuple[int, int]], bool]:
    """The ``most`` nearest possible pairs of every component but the largest with others,
    and whether some component has more. Every pair across components has an end in one of these."""
    names, of, sizes = np.unique(component, return_inverse=True, return_counts=True)
    pairs, more = [], False
    for c in np.delete(np.arange(len(names)), np.argmax(sizes)):
        others = np.flatnonzero(of != c)
        cost, ends = np.zeros(0), np.zeros((0, 2), dtype=np.int64)
        for i in np.flatnonzero(of == c):
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            hit = apart <= _distance_limit(n[others], n[i], num, den)
            found = others[hit]
            cost = np.concatenate([cost, apart[hit] / (n[found] + n[i])])
            ends = np.concatenate([ends, np.stack([np.full(len(found), i), found], axis=1)])
            if len(cost) > most:
                more = True
                best = np.argpartition(cost, most)[:most]
                cost, ends = cost[best], ends[best]
        pairs += map(tuple, ends.tolist())
    return pairs, more


def _cost(one: bytes, two: bytes) -> int:
    """Bits in which two sketches differ."""
    a, b = folded([one, two])
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _candidates(num: int, den: int, most: int = 0):
    """Rows sorted by group (sig, left, right) -> candidate pairs of each group
    with their cost, the share of elements that seem to differ: a forest of the
    possible pairs, or with ``most`` the nearest ones of each component; ``more``
    says that the group has others."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf.reset_index(drop=True)
            key = pdf[["sig", "left", "right"]].to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            yield solve(pdf.iloc[: edge[-1]], edge)
            held = [pdf.iloc[edge[-1]:]]
        if held:
            yield solve(held[0].reset_index(drop=True), np.array([0, len(held[0])]))

    def solve(pdf: pd.DataFrame, edge: np.ndarray) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["sig", "left", "right", "a", "b", "cost", "more"])
        sketches = pdf["sketch"].tolist()
        n = pdf["n_shingles"].to_numpy().astype(np.int64)
        component = pdf["component"].to_numpy()
        starts = edge[:-1] if edge[-1] == len(pdf) else edge[edge < len(pdf)]
        sizes = np.diff(np.append(starts, len(pdf)))
        found: list[np.ndarray] = []
        for start, size in zip(starts, sizes):
            part, more = slice(start, start + size), False
            if size < 2 or (component[part] == component[start]).all():
                continue
            bits = folded(sketches[part])
            if size == 2:
                apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum(dtype=np.int64))
                one = [(0, 1)] if apart <= _distance_limit(n[start], n[start + 1], num, den) else []
            elif most:
                one, more = _nearest(bits, n[part], component[part], num, den, most)
            else:
                one = _forest(bits, n[part], num, den)
            if one:
                found.append(np.array([(a + start, b + start, more) for a, b in one], dtype=np.int64))
        pairs_found = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
        pairs_found = pairs_found[component[pairs_found[:, 0]] != component[pairs_found[:, 1]]]
        a, b = pairs_found[:, 0], pairs_found[:, 1]
        ids = pdf["set_id"].to_numpy()
        out = pdf[["sig", "left", "right"]].iloc[a].reset_index(drop=True)
        out["a"], out["b"], out["cost"] = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), [_cost(sketches[i], sketches[j]) / (n[i] + n[j]) for i, j in zip(a, b)]
        out["more"] = pairs_found[:, 2] > 0
        return out

    return pairs


def _packed(words: int):
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            keys = [key for _, key in shingle_sets(texts, words)]
            high, low = zip(*keys) if keys else ((), ())
            yield pd.DataFrame({"high": high, "low": low, "packed": [zlib.compress(t.encode(), 1) for t in texts]})

    return packed


def _verify(words: int, num: int, den: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = np.zeros(len(pdf), dtype=bool)
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start: start + 256]
                sets = {x: shingles(zlib.decompress(x), words) for x in {*part["packed_a"], *part["packed_b"]}}
                for i, (x, y) in enumerate(zip(part["packed_a"], part["packed_b"])):
                    both = len(sets[x] & sets[y])
                    ok[start + i] = den * both >= num * (len(sets[x]) + len(sets[y]) - both)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "linked": ok})

    return verify


def row_key(docs: DataFrame) -> list:
    """k1 and k2, 96 hash bits of all columns of ``docs``: rows that differ have other keys."""
    parts = hashable(docs)
    return [F.xxhash64(*parts).alias("k1"), F.hash(*parts).alias("k2")]


def _of(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) with the components of both ends, of_a and of_b."""
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    return pairs.withColumns({"of_a": F.coalesce("of_a", "a"), "of_b": F.coalesce("of_b", "b")})


def linked_sets(docs: DataFrame, words: int, num: int, den: int, signer: Signer) -> tuple[DataFrame, DataFrame]:
    """Sets of ``words``-word shingles that share a signature of ``signer`` link where
    intersection / union >= num / den; equal sets always do. Gives (doc_id, k1, k2, n_shingles,
    high, low of every row) and (high, low, component, component_id of every set)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", *row_key(docs), "text")
    sets = materialise(
        plain.mapInArrow(tidy(_describe(words)), f"doc_id {kind}, k1 long, k2 int, n_shingles long, high long, low long, sketch binary"), "sets"
    )
    classes = materialise(
        sets.filter("low IS NOT NULL").groupBy("high", "low").agg(
            F.min("doc_id").alias("least_id"), F.min(F.struct("k1", "k2")).alias("row"),
            F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        ).withColumn("set_id", F.monotonically_increasing_id()),
        "classes",
    )

    shared = materialise(
        docs.select("text").mapInPandas(tidy(_sign(words, signer)), "sig long, low long")
        .repartition(parts, "sig").sortWithinPartitions("sig", "low")
        .mapInPandas(tidy(_shared), "sig long, rank long, low long"),
        "shared",
    )
    numbered = materialise(shared.join(classes.select("low", "set_id"), "low").select("sig", "rank", "set_id"), "numbered")
    # Groups with the same members count once.
    groups = materialise(
        numbered.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), F.max("rank").alias("last"), F.bit_xor(F.xxhash64("set_id")).alias("f"), F.bit_xor(F.hash("set_id")).alias("g"))
        .groupBy("members", "f", "g").agg(F.min_by(F.struct("sig", "last"), "sig").alias("s")).select("s.*"),
        "groups",
    )
    own = F.floor(F.col("rank") / BLOCK).cast("int")
    blocks = F.floor(F.col("last") / BLOCK).cast("int")
    placed = materialise(numbered.join(groups, "sig").select("sig", "set_id", own.alias("own"), blocks.alias("last")), "placed")
    release(shared, numbered, groups)

    checks: list[DataFrame] = []
    found: DataFrame | None = None

    def dealt(rows: DataFrame, others) -> DataFrame:
        return rows.select("*", F.explode(others).alias("other")).select(
            *[c for c in rows.columns if c not in ("own", "last")], F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
        )

    def candidates(rows: DataFrame, most: int = 0) -> DataFrame:
        return materialise(
            rows.join(classes.select("set_id", "n_shingles", "sketch"), "set_id")
            .repartition(parts, *group).sortWithinPartitions(*group)
            .mapInPandas(tidy(_candidates(num, den, most)), "sig long, left int, right int, a long, b long, cost double, more boolean"),
            "candidates",
        )

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("a", "b").distinct()
        if checks:
            pairs = materialise(pairs.join(reduce(DataFrame.unionByName, [c.select("a", "b") for c in checks]), ["a", "b"], "left_anti"), "pairs")
        wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        chosen = classes.join(wanted, "set_id", "left_semi")
        texts = materialise(
            plain.select("k1", "k2", "text").join(chosen.select("row.k1", "row.k2"), ["k1", "k2"], "left_semi")
            .select("text").mapInPandas(tidy(_packed(words)), "high long, low long, packed binary")
            .dropDuplicates(["high", "low"]).join(chosen.select("high", "low", "set_id"), ["high", "low"]).select("set_id", "packed"),
            "texts",
        )
        side = lambda s: texts.select(F.col("set_id").alias(s), F.col("packed").alias(f"packed_{s}"))
        out = materialise(
            pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "packed_a", "packed_b")
            .mapInPandas(tidy(_verify(words, num, den)), "a long, b long, linked boolean"),
            "verified",
        )
        release(texts, pairs)
        return out

    def nearest_of_each(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("v"), F.struct("cost", "a", "b").alias("p"))
        return ends.groupBy("v").agg(F.min("p").alias("p")).select("p.a", "p.b")

    def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))

    def merged() -> DataFrame:
        """Components with the links of the last check: these connect components, or sets where there are none yet."""
        links = checks[-1].filter("linked").select("a", "b")
        if found is None:
            return connected_components(links)
        ends = _of(links, found).select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b")
        joined = connected_components(ends)
        if joined.isEmpty():
            return found
        old = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
        own = joined.join(found.select("node"), "node", "left_anti")
        return materialise(old.select("node", F.coalesce("new", "component").alias("component")).unionByName(own.select("node", "component")), "found")

    def apart() -> DataFrame:
        """Verified pairs that are no links and whose ends lie in two components: a, b, of_a, of_b."""
        failed = reduce(DataFrame.unionByName, [c.filter("NOT linked").select("a", "b") for c in checks])
        return _of(failed, found).filter("of_a <> of_b")

    # Sets that agree in the half of the key that signatures carry are candidates of their own.
    twins = (
        classes.groupBy("low").agg(F.array_sort(F.collect_set("set_id")).alias("ids")).filter("size(ids) > 1")
        .select(F.explode(F.expr("flatten(transform(ids, x -> transform(filter(ids, y -> y > x), y -> struct(x AS a, y AS b))))")).alias("p"))
        .select("p.a", "p.b")
    )
    group = ["sig", "left", "right"]
    # Every block with itself and with block 0.
    near = materialise(
        dealt(placed, F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("last"))).otherwise(F.array(F.lit(0), F.col("own")))), "near"
    )
    first = candidates(near.withColumn("component", F.col("set_id")))
    pairs = first.select("a", "b", "cost").unionByName(twins.withColumn("cost", F.lit(0.0)))
    # Every set's nearest pair first; of the others only those whose ends are not in one component by then.
    checks.append(verified(nearest_of_each(pairs)))
    found = merged()
    checks.append(verified(_of(pairs.select("a", "b").distinct(), found).filter("of_a <> of_b")))
    found = merged()
    seconds = [(near, first)]
    if not placed.filter("last > 1").isEmpty():
        # All other pairs of blocks, where the members of a group are not all in one component by now.
        wide = with_component(placed.filter("last > 1"), found)
        split = materialise(wide.groupBy("sig").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c < d").select("sig"), "split")
        far = materialise(dealt(
            wide.filter("own > 0").join(split, "sig", "left_semi"),
            F.filter(F.sequence(F.lit(1), F.col("last")), lambda x: x != F.col("own")),
        ), "far")
        second = candidates(far)
        checks.append(verified(second))
        found = merged()
        seconds.append((far.drop("component"), second))
        release(split)
    open_ = materialise(apart(), "open")
    if not open_.isEmpty():
        # Components that failed pairs connect, and the sets in them: one row each.
        clusters = connected_components(open_.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        clusters = clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster"))
        held = materialise(with_component(classes.select("set_id"), found).join(clusters, "component").select("set_id", "cluster"), "held")
        large = materialise(held.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 2 * BLOCK).select("cluster"), "large")
        unsettled = [held.join(large, "cluster", "left_anti").select(F.col("cluster").alias("sig"), F.lit(-1).alias("left"), F.lit(-1).alias("right"), "set_id")]
        if not large.isEmpty():
            loose = open_.join(held.join(large, "cluster", "left_semi").select(F.col("set_id").alias("a")), "a", "left_semi").select("a", "b")
            unsettled += [
                rows.join(pairs.join(loose, ["a", "b"], "left_semi").select(*group).distinct(), group, "left_semi").select(*group, "set_id")
                for rows, pairs in seconds
            ]
        rows, most = materialise(reduce(DataFrame.unionByName, unsettled), "unsettled"), NEAREST
        while True:
            again = candidates(with_component(rows, found), most)
            checks.append(verified(again))
            found = merged()
            more = again.filter("more").select(*group).distinct()
            if more.isEmpty():
                break
            left = materialise(rows.join(more, group, "left_semi"), "unsettled")
            release(rows, again)
            rows, most = left, 16 * most
        release(held, large, rows, again)
    release(open_, placed, *[x for pair in seconds for x in pair], *checks)

    named = with_component(classes.select("set_id", "high", "low", "least_id"), found)
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_set = materialise(named.join(smallest, "component").select("high", "low", "component", "component_id"), "by-set")
    return sets.drop("sketch"), by_set




def component_rows(sets: DataFrame, by_set: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, from :func:`linked_sets`; a row without words is its own component."""
    return sets.join(by_set, ["high", "low"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("low").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
