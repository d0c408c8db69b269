"""Phrase collocations by contiguous pattern growth.

In the manner of PrefixSpan a phrase grows to the right from its first word.
Every occurrence of a word is a pointer into the corpus; projected on that word
it is what follows it within its piece, up to the longest phrase. The scan
writes projections: a row for each word (head) of some megabytes of text, with
its distinct tails and how often each occurs. The rows of one head then meet in
one task, where sorted tails are a tree of prefixes: growth walks down a branch
for as long as it is frequent, depth first, and leaves a prefix that is not
frequent with all that could follow it.

A head with more than 1 / partitions of all words would fill its task alone;
there are at most as many such hot words as partitions, by arithmetic. A prefix
can be hot only if all its words are, so the tails of hot heads are dealt by
their words up to the first that is not hot: phrases with such a word are still
counted in one task, and those of hot words alone add up from all tasks. All
counts are exact.

Scores compare a phrase with its parts: for the cut behind word k,
floor(1000000 a a / (l r)) with the counts of the phrase, of its first k words
and of the others; the lowest cut counts. Products are decimals of 38 digits,
which hold counts up to 10^16.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, shuffle_partitions, tidy

#: Bytes of text whose pointers are gathered before they are written.
GATHER_BYTES = 8_000_000
#: Ends a piece. It parts pieces itself, so it is no word.
_STOP = "."


def contexts(texts: pa.Array, langs: pa.Array, longest: int) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """(lang, head, tail, count) of the distinct contexts in some texts: a word
    and, joined by spaces, up to ``longest`` - 1 words that follow it in its piece."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), r"[.,;:!?\n-\r]", f" {_STOP} ")
    tokens = pc.ascii_split_whitespace(pc.binary_join_element_wise(marked, pa.scalar(_STOP), " "))
    counts = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Stops, and the empty words before and behind outer blanks, become -1.
    none = np.flatnonzero(pc.is_in(words, pa.array([_STOP, ""])).to_numpy(zero_copy_only=False))
    lang = langs.dictionary_encode()
    of = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
    empty = np.isin(codes, np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False)))
    codes, of = codes[~empty], of[~empty]
    codes[np.isin(codes, none)] = -1
    heads = np.flatnonzero(codes >= 0)
    padded = np.concatenate([codes, np.full(longest, -1)])
    width, key, ended = len(words) + 1, of[heads] * len(words) + codes[heads], np.zeros(len(heads), dtype=bool)
    columns = [codes[heads]]
    for j in range(1, longest):
        after = padded[heads + j]
        ended |= after < 0
        columns.append(np.where(ended, -1, after))
        # The context so far as one number below the number of heads, then the next word.
        key = np.unique(key, return_inverse=True)[1] * width + columns[-1] + 1
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    columns = [c[first] for c in columns]
    tail = None
    for c in columns[1:]:
        own = pc.fill_null(words.take(pa.array(c, mask=c < 0)), "")
        tail = own if tail is None else pc.if_else(pa.array(c >= 0), pc.binary_join_element_wise(tail, own, " "), tail)
    return lang.dictionary.take(pa.array(of[heads][first])), words.take(pa.array(columns[0])), tail, count


def _scan(longest: int):
    """Rows (lang, text) -> rows (lang, head, tail, n) of distinct contexts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for start, stop in _parts(batch.column(1)):
                held.append(batch.slice(start, stop - start))
                size += pc.sum(pc.binary_length(held[-1].column(1))).as_py() or 0
                if size >= GATHER_BYTES:
                    yield gathered(held)
                    held, size = [], 0
        if held:
            yield gathered(held)

    def gathered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        langs, texts = (c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in whole.columns)
        lang, head, tail, count = contexts(texts, langs, longest)
        fresh = np.flatnonzero(_changes([lang, head]))
        return _projections(lang.take(pa.array(fresh)), head.take(pa.array(fresh)), fresh, tail, count)

    return scan


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before it."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    if len(fresh) > 1:
        fresh[1:] = ~np.logical_and.reduce([pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns])
    return fresh


_PROJECTIONS = "lang string, head string, n long, tails string, counts binary"


def _projections(lang: pa.Array, head: pa.Array, starts: np.ndarray, tail: pa.Array, count: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    """Rows of heads whose tails begin at ``starts``: the tails, a line each, and their counts as four bytes each."""
    ends = np.append(starts, len(tail)).astype(np.int32)
    tails = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail), "\n")
    blob = pa.py_buffer(count.astype("<u4").tobytes())
    counts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * np.int32(4)), blob])
    n = np.add.reduceat(count, starts) if len(starts) else np.zeros(0, dtype=np.int64)
    arrays = [lang, head, pa.array(n, pa.int64()), tails, counts, *more]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "head", "n", "tails", "counts", "part"][: len(arrays)])


class _Tails:
    """The tails of some rows of projections, as codes of their words."""

    def __init__(self, rows: pa.Table, longest: int):
        lists = pc.split_pattern(_whole(rows["tails"]), "\n")
        self.tail = lists.flatten()
        self.row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        self.count = np.frombuffer(b"".join(rows["counts"].to_pylist()), dtype="<u4").astype(np.int64)
        words = pc.split_pattern(self.tail, " ")
        coded = words.flatten().dictionary_encode()
        self.words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(lengths) - lengths
        self.size = np.where(pc.equal(self.tail, "").to_numpy(zero_copy_only=False), 0, lengths)
        self.codes = np.full((longest - 1, len(self.tail)), -1, dtype=np.int64)
        for j in range(longest - 1):
            has = self.size > j
            self.codes[j, has] = codes[at[has] + j]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _deal(longest: int, parts: int, hot: set[tuple[str, str]]):
    """Rows of hot heads -> rows (with ``part``) of their tails dealt by the words up to the first that is not hot."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.Table.from_batches([batch.slice(i, 1)])
                tails, lang = _Tails(rows, longest), rows["lang"][0].as_py()
                plain = np.array([(lang, w) not in hot for w in tails.words], dtype=bool)
                key, settled = np.zeros(len(tails.tail), dtype=np.int64), np.zeros(len(tails.tail), dtype=bool)
                named = np.array([xxhash.xxh64_intdigest(w) >> 1 for w in tails.words], dtype=np.int64)
                for codes in tails.codes:
                    go = ~settled & (codes >= 0)
                    with np.errstate(over="ignore"):
                        key[go] = key[go] * np.int64(6364136223846793005) + named[codes[go]]
                    settled[go] |= plain[codes[go]]
                part = (key >> 16) % parts
                order = np.argsort(part, kind="stable")
                starts = np.flatnonzero(np.diff(part[order], prepend=-1))
                same = lambda c: pa.array([rows[c][0].as_py()] * len(starts), pa.string())  # noqa: E731, B023
                yield _projections(same("lang"), same("head"), starts, tails.tail.take(pa.array(order)), tails.count[order], pa.array(part[order][starts], pa.int32()))

    return deal


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about GATHER_BYTES."""
    upto, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(upto):
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + GATHER_BYTES, side="right")))
        yield start, stop
        start = stop


def _grow(longest: int, least: int, hot: set[tuple[str, str]]):
    """Rows (lang, head, part, tails, counts) sorted by the first three -> (lang, phrase, size, n).

    Counts are whole but for phrases of hot words alone, of which each part gives its own."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _changes([batch.column(0), batch.column(1), pc.fill_null(batch.column(2), -1)])
            fresh[0] = not held or any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(3))
            starts = np.flatnonzero(fresh)
            if not len(starts):
                held.append(batch)
                continue
            # The last head may go on in the next batch.
            ready = [*held, batch.slice(0, int(starts[-1]))]
            held = [batch.slice(int(starts[-1]))]
            yield grown(pa.Table.from_batches([x for x in ready if x.num_rows] or [batch.slice(0, 0)]).combine_chunks())
        if held:
            yield grown(pa.Table.from_batches(held).combine_chunks())

    def grown(rows: pa.Table) -> pa.RecordBatch:
        found: list[tuple[str, str, int, int]] = []
        if rows.num_rows:
            langs, heads, part = _whole(rows["lang"]), _whole(rows["head"]), _whole(rows["part"])
            tails = _Tails(rows, longest)
            unit = (np.cumsum(_changes([langs, heads, pc.fill_null(part, -1)])) - 1)[tails.row]
            order = np.lexsort((*tails.codes[::-1], unit))
            codes, row = tails.codes[:, order], tails.row[order]
            dealt = pc.is_valid(part).to_numpy(zero_copy_only=False)
            # Words that make a phrase whole: all, unless the head is hot too.
            plain = {}
            for k in np.unique(tails.row[dealt[tails.row]]).tolist():
                lang = langs[k].as_py()
                if lang not in plain:
                    plain[lang] = np.array([(lang, w) not in hot for w in tails.words], dtype=bool)
            patterns = _Patterns(unit[order], codes, tails.size[order], np.concatenate([[0], np.cumsum(tails.count[order])]), least)
            for depth, low, count in patterns.frequent(dealt[row], lambda low: plain[langs[int(row[low])].as_py()]):
                own = [tails.words[c] for c in codes[: depth - 1, low]]
                k = int(row[low])
                found.append((langs[k].as_py(), " ".join([heads[k].as_py(), *own]), depth, count))
        columns = list(zip(*found)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())],
            names=["lang", "phrase", "size", "n"],
        )

    return grow


class _Patterns:
    """Sorted contexts as a tree of prefixes: ``starts`` has, for each length of a prefix, where its runs begin."""

    def __init__(self, unit: np.ndarray, codes: np.ndarray, size: np.ndarray, upto: np.ndarray, least: int):
        self.codes, self.size, self.upto, self.least = codes, size, upto, least
        fresh = np.diff(unit, prepend=-1) != 0
        self.starts = [np.flatnonzero(fresh)]
        for words in codes:
            fresh = fresh | (np.diff(words, prepend=-2) != 0)
            self.starts.append(np.flatnonzero(fresh))

    def frequent(self, dealt: np.ndarray, plain_of: Callable[[int], np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(length, a row, count) of every frequent phrase of two words or more, depth
        first; of dealt heads also the parts of phrases of hot words alone."""
        ends = np.append(self.starts[0][1:], len(self.size))
        keep = dealt[self.starts[0]] | (self.upto[ends] - self.upto[self.starts[0]] >= self.least)
        for low, high in zip(self.starts[0][keep].tolist(), ends[keep].tolist()):
            yield from self._right(low, high, 2, plain_of(low) if dealt[low] else None)

    def _right(self, low: int, high: int, depth: int, plain: np.ndarray | None) -> Iterator[tuple[int, int, int]]:
        """Extends the prefix of rows ``low`` to ``high`` by one word, and each
        frequent result again. ``plain`` says which words are not hot, where all so far are."""
        runs = self.starts[depth - 1]
        a, b = np.searchsorted(runs, [low, high])
        begin, stop = runs[a:b], np.append(runs[a + 1:b], high)
        count = self.upto[stop] - self.upto[begin]
        longer = self.size[begin] >= depth - 1
        last = depth == len(self.starts)
        whole = np.ones(len(begin), dtype=bool) if plain is None or last else plain[self.codes[depth - 2, begin]]
        for i in np.flatnonzero(longer & (~whole | (count >= self.least))).tolist():
            yield depth, int(begin[i]), int(count[i])
            if not last:
                yield from self._right(int(begin[i]), int(stop[i]), depth + 1, None if whole[i] else plain)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered: int = 50, lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    Text is lower-cased (A-Z), cut into pieces at ``.,;:!?`` and at line feeds,
    vertical tabs, form feeds and carriage returns, and these into words at
    spaces and tabs. Candidates are phrases of 2 to ``longest`` words that occur
    ``least`` times or more, overlaps included; a is that count, l and r those
    of the parts at the lowest-scoring cut (ties: the earliest), n all words of
    the language. A candidate is dropped where a longer one that holds its words
    in a row occurs at least ``covered`` % as often. Order: score and a
    descending, phrase in byte order. A null language counts as ``und``; null,
    empty and wordless texts hold nothing, repeated rows count each. Only text
    and ``lang`` are read; an empty table gives an empty result.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases need two words and one occurrence at least")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    pointers = materialise(
        docs.filter("text IS NOT NULL").select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), "text")
        .mapInArrow(tidy(_scan(longest)), _PROJECTIONS),
        "pointers", "zstd",
    )
    words = materialise(pointers.groupBy("lang", "head").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    # Fewer than there are partitions, by arithmetic.
    hot = {(r["lang"], r["head"]) for r in words.filter(F.col("n") * parts > total).select("lang", "head").collect()}
    named = F.concat_ws("\t", "lang", "head")  # a word has no tab
    is_hot = named.isin([f"{x}\t{w}" for x, w in hot]) if hot else F.lit(False)
    projected = pointers.filter(~is_hot).select("lang", "head", F.lit(None).cast("int").alias("part"), "tails", "counts")
    if hot:
        dealt = pointers.filter(is_hot).mapInArrow(tidy(_deal(longest, parts, hot)), f"{_PROJECTIONS}, part int")
        projected = projected.unionByName(dealt.drop("n"))
    phrases = materialise(
        projected.repartition(parts, "lang", "head", "part").sortWithinPartitions("lang", "head", "part")
        .mapInArrow(tidy(_grow(longest, least, hot)), "lang string, phrase string, size int, n long")
        .groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least),
        "phrases",
    )
    release(pointers)
    counts = words.filter(F.col("n") >= least).select("lang", F.col("head").alias("phrase"), "n").unionByName(phrases.select("lang", "phrase", "n"))
    out = _scored(_uncovered(phrases, longest, covered), counts, longest)
    ordered = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ordered.filter(F.col("rank") <= top).join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _words_of(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def _uncovered(phrases: DataFrame, longest: int, covered: int) -> DataFrame:
    """The phrases that no longer one holds and nearly matches in number."""
    if longest == 2:
        return phrases

    def runs(k: int) -> Column:
        """All runs of ``k`` words of a longer phrase."""
        inside = F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
        return F.when(F.col("size") > k, inside).otherwise(F.array())

    held = (
        phrases.filter("size > 2").withColumn("w", _words_of())
        .select("lang", "n", F.explode(F.array_distinct(F.flatten(F.array(*map(runs, range(2, longest)))))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    )
    return phrases.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * covered)).drop("longer")


def _scored(phrases: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, a, l, r, score by the lowest cut."""
    w = _words_of()
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), cut).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(w, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    score = _div((exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), (exact("l") * exact("r")).cast("decimal(38,0)"))
    lowest = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("c")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
