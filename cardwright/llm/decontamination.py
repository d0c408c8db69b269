"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased, with every run of other characters than
letters and digits as one space. An item of m characters may be matched with up
to k = m // ERROR_EVERY edits; cut into k + 1 pieces, at least one piece of it
stands unchanged in any such match. One pass of an automaton over a text finds
all piece hits, and around each hit Myers' bit-parallel algorithm finds the
least edit distance of the item to any part of the window. An item shorter
than WHOLE_WORDS characters is matched without edits and at word boundaries
only, as it would else be found inside other words.

The benchmark is the query set: its items, normalised once, travel as broadcast
blocks of at most BLOCK_CHARS characters, PASS_BLOCKS of them in one pass over
the documents; a larger benchmark takes another pass for each so many. A task
normalises a text once and runs it through the blocks one after another, a
batch of texts at a time, and keeps as many automata as KEPT_CHARS allows.
Documents are never shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import tidy

ERROR_EVERY = 15
WHOLE_WORDS = 24
BLOCK_CHARS = 500_000
PASS_BLOCKS = 64
KEPT_CHARS = 2_000_000
BATCH_CHARS = 8_000_000
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def normalised_offsets(text: str) -> list[int]:
    """For each character of ``normalise(text)`` where it comes from in ``text``."""
    out: list[int] = []
    for at, c in enumerate(text):
        for low in c.lower():
            if not _GAP.fullmatch(low):
                out.append(at)
            elif out and out[-1] >= 0:
                out.append(-1 - at)
    if out and out[-1] < 0:
        out.pop()
    return [x if x >= 0 else -1 - x for x in out]


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any part of ``text``, where that
    part ends), by Myers' bit-parallel algorithm."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(h | up))
        mh = up & h
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = mh | (full & ~(v | ph)), ph & v
        if score < best:
            best, at = score, j + 1
    return best, at


def error_budget(item: str) -> int:
    """Edits that a normalised item may be matched with."""
    return 0 if len(item) < WHOLE_WORDS else len(item) // ERROR_EVERY


class PieceIndex:
    """The pieces of a block of items, and matching a text against them."""

    def __init__(self, items: list[tuple]):
        import ahocorasick

        self.items = items
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(items):
            pieces = error_budget(text) + 1
            cuts = [len(text) * i // pieces for i in range(pieces + 1)]
            for start, stop in zip(cuts, cuts[1:]):
                where.setdefault(text[start:stop], []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, budget, start, stop) of the best match of each item in a normalised text."""
        if not self.items:
            return []
        seen: set[tuple[int, int]] = set()
        found: dict[int, tuple[int, int, int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                item = self.items[n][1]
                budget = error_budget(item)
                start = end - size + 1 - offset
                if len(item) < WHOLE_WORDS:
                    if n not in found and text[max(0, start - 1): start] in ("", " ") and text[end + 1: end + 2] in ("", " "):
                        found[n] = (0, start, end + 1)
                    continue
                # Hits that put the item's start in the same cell share a window wide enough for all of them.
                cell = start // (budget + 1)
                if (n, cell) in seen or found.get(n, (1,))[0] == 0:
                    continue
                seen.add((n, cell))
                low = max(0, cell * (budget + 1) - budget)
                window = text[low: (cell + 1) * (budget + 1) + len(item) + budget]
                exact = window.find(item)
                if exact >= 0:
                    distance, stop = 0, exact + len(item)
                else:
                    distance, stop = best_match(item, window)
                if distance <= budget and distance < found.get(n, (budget + 1,))[0]:
                    found[n] = (distance, max(0, low + stop - len(item)), low + stop)
        return [(self.items[n][0], d, error_budget(self.items[n][1]), a, b) for n, (d, a, b) in sorted(found.items())]


#: The indexes that a worker keeps, the one used last at the end: block name -> (characters, index).
_KEPT: dict[str, tuple[int, PieceIndex]] = {}

Blocks = list[tuple[str, Broadcast]]


def _index(name: str, block: Broadcast) -> PieceIndex:
    size, index = _KEPT.pop(name, (0, None))
    if index is None:
        items = block.value
        size, index = sum(len(t) for _, t in items), PieceIndex(items)
        while _KEPT and size + sum(n for n, _ in _KEPT.values()) > KEPT_CHARS:
            del _KEPT[next(iter(_KEPT))]
    _KEPT[name] = (size, index)
    return index


def benchmark_passes(benchmark: DataFrame) -> Iterator[Blocks]:
    """The normalised items with a letter or digit, in broadcast blocks, for as many passes as they need (one at least)."""
    sc = benchmark.sparkSession.sparkContext
    blocks: Blocks = []
    items: list[tuple] = []
    size = 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        if not (text := normalise(row["text"])):
            continue
        if size and size + len(text) > BLOCK_CHARS:
            blocks.append((uuid.uuid4().hex, sc.broadcast(items)))
            items, size = [], 0
            if len(blocks) == PASS_BLOCKS:
                yield blocks
                blocks = []
        items.append((row["item_id"], text))
        size += len(text)
    yield [*blocks, (uuid.uuid4().hex, sc.broadcast(items))]


def _gathered(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.RecordBatch]:
    """With several blocks, batches together until they hold BATCH_CHARS, so that each block's turn is worth its index."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if not several or size >= BATCH_CHARS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, error_budget, start, stop: a row for each
    item that a document holds within the item's error budget.

    start and stop are places in the text itself (up to the edits at its ends)
    of the best match, the first of equals. Items that are null or without a
    letter or digit match nothing; short ones (WHOLE_WORDS) are matched as they
    are, as whole words. Null and empty texts match nothing. Equal items match
    alike under their own ids. Repeated rows give repeated results; an empty
    table gives none. Only doc_id and text are read.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType),
        *[T.StructField(c, T.LongType()) for c in ("distance", "error_budget", "start", "stop")],
    ])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def finder(blocks: Blocks):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(batches, len(blocks) > 1):
                texts = batch.column("text").to_pylist()
                plain = [normalise(t) for t in texts]
                hits: list[list[tuple]] = [[] for _ in texts]
                for name, block in blocks:
                    index = _index(name, block)
                    for own, text in zip(hits, plain):
                        own += index.matches(text)
                rows = []
                for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), texts, hits):
                    places = normalised_offsets(text) if own else []
                    rows += [(doc_id, i, d, k, places[min(a, len(places) - 1)], places[b - 1] + 1) for i, d, k, a, b in own]
                columns = list(zip(*rows)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        return find

    rows = docs.select("doc_id", "text")
    return reduce(DataFrame.unionByName, [rows.mapInArrow(tidy(finder(blocks)), schema) for blocks in benchmark_passes(benchmark)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""

    def cleaner(blocks: Blocks):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(batches, len(blocks) > 1):
                plain = [normalise(t) for t in batch.column("text").to_pylist()]
                clear = [True] * len(plain)
                for name, block in blocks:
                    index = _index(name, block)
                    clear = [ok and not index.matches(text) for ok, text in zip(clear, plain)]
                yield batch.filter(pa.array(clear, pa.bool_()))

        return clean

    for blocks in benchmark_passes(benchmark):
        docs = docs.mapInArrow(tidy(cleaner(blocks)), docs.schema)
    return docs
