"""Mixing sources to target weights by Pfair scheduling, native.

A source's documents, in hash order, form blocks of ``block_docs``. Block i
(from 0) of a source with integer weight a out of A is released at slot
floor(i A / a) and due at ceil((i + 1) A / a). Earliest deadline first over the
released blocks meets every deadline, so at each slot a source has less than
one block more or less than its share. The pattern repeats after A slots; it is
computed once for a period, and documents find their slot by arithmetic.

When a source runs out, a new phase starts with the weights of the sources
left, so every document gets a place and none is repeated. Only the block
counts of the declared sources come to the driver.

The plan is a table in the shared folder, written phase by phase: a row for
each phase and source says which blocks fall in it, cut into stretches of
STRETCH blocks, and holds the slots of one period, or of the phase where that
is shorter. Its size, which follows the declared weights and not the documents,
is known when it is written; up to PLAN_BYTES it is broadcast, else the join is
by source and stretch, whose rows are bounded, so that no key of it is hot.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashable, materialise, release, work_path, write_lines

OTHER = "*"
MAX_PERIOD = 1_000_000
BLOCK_DOCS = 8
#: Blocks in a stretch, and the largest plan that is broadcast.
STRETCH, PLAN_BYTES = 1 << 20, 32 << 20
#: Rows that a hash bucket of a source holds on average, at most.
BUCKET_ROWS = 100_000
_ENTRY = "g string, phase int, stretch long, from_block long, to_block long, base long, period long, weight long, slots array<int>, deficit long"


def edf_period(weights: dict[str, int], limit: int | None = None) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period (or its first ``limit``
    slots), earliest deadline first (ties: by name)."""
    period = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, str]] = []
    for now in range(period if limit is None else min(period, limit)):
        while waiting and waiting[0][0] <= now:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(now)
        if (done := len(slots[s])) < weights[s]:
            heapq.heappush(waiting, (done * period // weights[s], s))
    return slots


def mix_plan(rows: dict[str, int], weights: dict[str, int], block_docs: int) -> Iterator[dict]:
    """For each phase and each source with blocks in it, where these go."""
    left = {s: -(-n // block_docs) for s, n in rows.items() if n}
    done = dict.fromkeys(left, 0)
    base, phase, deficit = 0, 0, 0
    while left:
        common = math.gcd(*(weights[s] for s in left))
        live = {s: weights[s] // common for s in left}
        period = sum(live.values())
        # The first source to run out is out by its last block's deadline.
        slots = edf_period(live, min(-(-n * period // live[s]) for s, n in left.items()))

        def end(s: str) -> float:
            """Slots until the last block of s is out; infinite where that is past the slots looked at."""
            turns, k = divmod(left[s] - 1, live[s])
            return turns * period + slots[s][k] + 1 if k < len(slots[s]) else math.inf

        length = min(map(end, left))
        turns, part = divmod(length, period)
        for s in live:
            n = turns * live[s] + sum(x < part for x in slots[s])
            if n:
                yield {
                    "g": s, "phase": phase, "from_block": done[s], "to_block": done[s] + n, "base": base,
                    "period": period, "weight": live[s], "slots": slots[s] if turns else slots[s][:n], "deficit": deficit,
                }
            done[s] += n
            left[s] -= n
        gone = [s for s in live if not left[s]]
        deficit += sum(-rows[s] % block_docs for s in gone)
        left = {s: n for s, n in left.items() if n}
        base, phase = base + length, phase + 1


def write_plan(spark: SparkSession, plan: Iterator[dict]) -> tuple[DataFrame, int]:
    """The plan's entries by stretch as a table in the shared folder, and the bytes they take in memory."""
    size = 0

    def lines() -> Iterator[str]:
        nonlocal size
        for entry in plan:
            for stretch in range(entry["from_block"] // STRETCH, (entry["to_block"] - 1) // STRETCH + 1):
                size += 120 + len(entry["g"]) + 4 * len(entry["slots"])
                yield json.dumps(entry | {"stretch": stretch})

    path = work_path(spark, "mix-plan")
    write_lines(spark, path + "/plan.json", lines())
    text = spark.read.schema(_ENTRY).json(path)
    text._work_path = path
    table = materialise(text, "mix-plan")
    release(text)
    return table, size


def bucket_digits(rows: int) -> int:
    """Hexadecimal digits of the hash that make up a bucket: at least 3, at most 7."""
    return min(7, max(3, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16))))


def _bucket(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def mix_sources(docs: DataFrame, weights: dict[str, int], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of ``docs`` with mix_group, mix_block, mix_phase, mix_release,
    mix_deadline, mix_slot and mix_position (0, 1, 2, ... over all rows).

    ``weights`` are positive integers by source and count documents, whatever
    their length; their sum over their greatest common divisor (the period) is
    at most MAX_PERIOD. Sources without a weight, and null, share the entry "*"
    (weight 1 if not given). Within a source rows follow the MD5 of doc_id, or
    of a hash of the row where doc_id is null; ties go by doc_id and then by
    that hash, and rows alike in all columns may swap. Rows of one source and
    doc_id are put in order by one task. Columns of ``docs`` named like an
    added one are replaced. An empty table gives an empty result. ``docs`` is
    counted first, so it should be a table.
    """
    spark = docs.sparkSession
    weights = {OTHER: 1} | dict(weights)
    if min(weights.values()) < 1 or sum(weights.values()) // math.gcd(*weights.values()) > MAX_PERIOD:
        raise ValueError(f"weights must be positive integers with a sum of at most {MAX_PERIOD}")
    tie = F.xxhash64(*hashable(docs))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), tie.cast("string")))
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.when(F.col("source").isin(*[s for s in weights if s != OTHER]), F.col("source")).otherwise(OTHER).alias("g"),
        digest.alias("h"), tie.alias("tie"), _bucket(digest, bucket_digits(docs.count())).alias("bucket"),
    )
    # Ranks within a source: counts by bucket, then a window per bucket. Both are dealt by source and bucket.
    counts = materialise(keyed.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    before = counts.select(
        "g", "bucket",
        (F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    totals = {r["g"]: r["n"] for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("g", "bucket").orderBy("h", F.col("row.doc_id"), "tie")) - 1
    ranked = (
        keyed.withColumn("rank", rank).join(before, ["g", "bucket"])
        .withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
        .withColumn("block", F.expr(f"rank div {block_docs}")).withColumn("stretch", F.expr(f"block div {STRETCH}"))
    )
    plan, size = write_plan(spark, mix_plan(totals, weights, block_docs))
    p = (F.broadcast(plan) if size <= PLAN_BYTES else plan.hint("merge")).alias("p")
    placed = ranked.alias("r").join(
        p,
        (F.col("r.g") == F.col("p.g")) & (F.col("r.stretch") == F.col("p.stretch"))
        & (F.col("block") >= F.col("from_block")) & (F.col("block") < F.col("to_block")),
    ).withColumn("i", F.col("block") - F.col("from_block"))
    slot = F.expr("base + (i div weight) * period + slots[cast(i % weight as int)]")
    added = {
        "mix_group": F.col("r.g"),
        "mix_block": F.col("block"),
        "mix_phase": F.col("phase"),
        "mix_release": F.expr("base + (i * period) div weight"),
        "mix_deadline": F.expr("base + ((i + 1) * period + weight - 1) div weight"),
        "mix_slot": slot,
        "mix_position": slot * block_docs - F.col("deficit") + F.col("rank") % block_docs,
    }
    return placed.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in added],
        *[e.alias(name) for name, e in added.items()],
    )
