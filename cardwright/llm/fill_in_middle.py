"""Fill-in-the-middle by ropes.

A text becomes a rope: a balanced tree whose leaves hold some code points each
and know how many units end in them (a unit is a line with its line feed; what
stands behind the last one is a unit too). Inner nodes add these counts up, so
a cut behind the k-th unit is one walk down, and the pieces on either side are
joined up again on the way back without copying any text. Two cuts make
prefix, middle and suffix; the subtrees are joined in the order of the form,
with sentinels between them, and read off once. The inverse builds a rope of
the output, cuts it at the code points where the sentinels stand, and joins the
subtrees in their first order.

No sentinel can stand across a border of text and sentinel, as ``<`` and ``>``
occur at its ends only, so an output has each sentinel once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a leaf.
LEAF = 2048
#: Characters of output in one batch, unless a single text has more.
BATCH = 4_000_000


@dataclass(frozen=True)
class Sentinels:
    """Marks before prefix, suffix and middle; each begins with ``<``, ends with ``>`` and has neither inside."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        own = (self.prefix, self.suffix, self.middle)
        if len(set(own)) < 3 or any(m[:1] + m[-1:] != "<>" or m.count("<") + m.count(">") > 2 for m in own):
            raise ValueError("sentinels must differ and have < and > at their ends only")

    def inside(self, text: str) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text

    def order(self, form: str) -> tuple[str, str, str]:
        """The marks in the order of the form ``psm`` or ``spm``."""
        return (self.prefix, self.suffix, self.middle) if form == "psm" else (self.suffix, self.prefix, self.middle)


class Leaf:
    """Some code points; ``open_end``: its last unit ends with the text, without a line feed."""

    __slots__ = ("text", "open_end", "units", "chars")
    height = 0

    def __init__(self, text: str, open_end: bool = False, units: int | None = None):
        self.text, self.open_end, self.chars = text, open_end, len(text)
        self.units = text.count("\n") + open_end if units is None else units

    def at_unit(self, k: int) -> int:
        """Code points up to the end of the ``k``-th unit."""
        if k == self.units and self.open_end:
            return self.chars
        at = 0
        for _ in range(k):
            at = self.text.index("\n", at) + 1
        return at


class Node:
    __slots__ = ("left", "right", "units", "chars", "height")

    def __init__(self, left: Rope, right: Rope):
        self.left, self.right = left, right
        self.units, self.chars = left.units + right.units, left.chars + right.chars
        self.height = max(left.height, right.height) + 1


Rope = Leaf | Node


def build(text: str) -> Rope | None:
    """The rope of a text; None if it is empty."""
    leaves: list[Rope] = [Leaf(text[i: i + LEAF]) for i in range(0, len(text), LEAF)]
    if leaves and not text.endswith("\n"):
        leaves[-1] = Leaf(leaves[-1].text, open_end=True)
    while len(leaves) > 1:
        leaves = [Node(*leaves[i: i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def concat(a: Rope | None, b: Rope | None) -> Rope | None:
    """Both in one balanced rope; only nodes along one side are made anew."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        return _balanced(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _balanced(concat(a, b.left), b.right)
    return Node(a, b)


def _balanced(a: Rope, b: Rope) -> Node:
    """A node over two ropes whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(a.left, Node(a.right, b))
        return Node(Node(a.left, a.right.left), Node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(Node(a, b.left), b.right)
        return Node(Node(a, b.left.left), Node(b.left.right, b.right))
    return Node(a, b)


def split(rope: Rope | None, k: int, by: str) -> tuple[Rope | None, Rope | None]:
    """What lies before and behind the end of the ``k``-th of ``by`` ("units" or "chars")."""
    if rope is None:
        return None, None
    if isinstance(rope, Leaf):
        at = rope.at_unit(k) if by == "units" else k
        if at == 0 or at == rope.chars:
            return (None, rope) if at == 0 else (rope, None)
        before = k if by == "units" else rope.text.count("\n", 0, at)
        return Leaf(rope.text[:at], units=before), Leaf(rope.text[at:], rope.open_end, rope.units - before)
    own = getattr(rope.left, by)
    if k <= own:
        a, b = split(rope.left, k, by)
        return a, concat(b, rope.right)
    a, b = split(rope.right, k - own, by)
    return concat(rope.left, a), b


def read(rope: Rope | None) -> str:
    """The rope's text."""
    out, open_ = [], [rope] if rope else []
    while open_:
        x = open_.pop()
        if isinstance(x, Leaf):
            out.append(x.text)
        else:
            open_ += (x.right, x.left)
    return "".join(out)


def transform(rope: Rope, low: int, high: int, form: str, marks: Sentinels) -> tuple[Rope, int, int]:
    """(rope of the output, code points of the prefix, of the middle); cuts behind units ``low`` and ``high``."""
    prefix, rest = split(rope, low, "units")
    middle, suffix = split(rest, high - low, "units")
    parts = (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle)
    out = None
    for mark, part in zip(marks.order(form), parts):
        out = concat(concat(out, Leaf(mark)), part)
    return out, prefix.chars if prefix else 0, middle.chars if middle else 0


def restore(output: str, form: str, marks: Sentinels) -> str:
    """The text of an output of the given form."""
    if form == "plain":
        return output
    at = [output.index(m) for m in marks.order(form)]
    rest, parts = build(output), []
    for mark, start in reversed(list(zip(marks.order(form), at))):
        rest, part = split(rest, start, "chars")
        parts.append(split(part, len(mark), "chars")[1])
    middle, second, first = parts
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return read(concat(concat(prefix, middle), suffix))


def _draw(key: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


_OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: str = "7", percent: int = 100, spm_percent: int = 50, marks: Sentinels = Sentinels()) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output of every row.

    The four numbers h1 to h4 of a row come from the SHA-256 of ``seed:doc_id``
    (a null doc_id counts as nothing), so rows that repeat an id are cut by the
    same numbers. Cuts lie behind unit h1 % (n + 1) and h2 % (n + 1), the smaller
    one first. A row is ``plain``, its output its text, where h3 % 100 reaches
    ``percent``, and where the text is null, empty or holds a sentinel; else the
    form is ``spm`` where h4 % 100 is below ``spm_percent``, or ``psm``. Only
    doc_id and text are read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *h, texts = batch.columns
            done, held, size = 0, [], 0
            for *own, text in zip(*(x.to_pylist() for x in h), texts):
                row = _one(text.as_py() or "", *own, percent, spm_percent, marks)
                held.append(row)
                size += len(row[-1])
                if size >= BATCH:
                    yield _batch(ids.slice(done, len(held)), held)
                    done, held, size = done + len(held), [], 0
            if held:
                yield _batch(ids.slice(done), held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *_draw(F.col("doc_id"), seed), "text").mapInArrow(run, f"doc_id {kind}, {_OUT}")


def _one(text: str, h1: int, h2: int, h3: int, h4: int, percent: int, spm_percent: int, marks: Sentinels) -> tuple:
    rope = build(text)
    n = rope.units if rope else 0
    if not rope or h3 % 100 >= percent or marks.inside(text):
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm_percent else "psm"
    out, prefix, middle = transform(rope, *sorted((h1 % (n + 1), h2 % (n + 1))), form, marks)
    return n, form, prefix, middle, read(out)


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def restore_text(made: DataFrame, marks: Sentinels = Sentinels()) -> DataFrame:
    """The rows of :func:`fill_in_middle` with ``restored`` in place of
    ``output``, the text rebuilt from output and form alone. A null output gives
    null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, form, output = batch.columns
            done, held, size = 0, [], 0
            for f, o in zip(form.to_pylist(), output):
                held.append(None if o.as_py() is None else restore(o.as_py(), f, marks))
                size += len(held[-1] or "")
                if size >= BATCH:
                    yield _restored(batch, others, done, held)
                    done, held, size = done + len(held), [], 0
            if held:
                yield _restored(batch, others, done, held)

    def _restored(batch: pa.RecordBatch, others: list[pa.Array], done: int, held: list) -> pa.RecordBatch:
        some = [x.slice(done, len(held)) for x in [*others, batch.column("form")]]
        return pa.RecordBatch.from_arrays([*some, pa.array(held, pa.string())], names=[*batch.schema.names[:-1], "restored"])

    others = [c for c in made.columns if c not in ("form", "output", "restored")]
    kinds = dict(made.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["form string, restored string"])
    return made.select(*others, "form", "output").mapInArrow(run, schema)
