"""N-gram Jaccard self-join by PartEnum signatures, and its components.

Sets of word shingles link when intersection / union >= numerator /
denominator. Sizes fall in bands; two sets that link, the larger one in a band
whose largest size is r, differ in at most k = 2 r (den-num)/(den+num)
elements. The shingle domain is cut by hash into n1 partitions of n2 parts
each; k differences leave at least one partition with no more than k2 =
k // n1 (rounded down) parts that differ, so one of its subsets of n2 - k2
parts is equal in both sets. Each set signs every such subset for its own band
and for the bands in which a larger partner may lie. (n1, n2, k2) is the
cheapest choice whose subsets hold TARGET shingles or more. A subset empty in
a set is signed only when the set has so many that the others would not be
enough, so empty subsets make no common signature.

The shared signatures' groups are verified and joined up by ``linking``.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb, exp

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .linking import component_rows, linked_sets, row_key
from .shingles import mix

BAND_RATIO = (7, 5)
TARGET = 5.5
#: (parts of a partition n2, parts that may differ k2), by rising number of signatures.
SCHEMES = ((1, 0), (3, 1), (4, 2), (5, 2))


def _bands(limit: int) -> np.ndarray:
    """Lower ends of the size bands up to beyond ``limit``."""
    ends = [1]
    while ends[-1] <= limit:
        ends.append(max(ends[-1] + 1, ends[-1] * BAND_RATIO[0] // BAND_RATIO[1]))
    ends.append(ends[-1] * 2)
    return np.array(ends)


@lru_cache(maxsize=4096)
def scheme(least: int, top: int, k: int) -> tuple[int, int, int]:
    """(n1, n2, k2) for sets of ``least`` to ``top`` elements that differ in up to k."""
    for n2, k2 in SCHEMES:
        needed = k // (k2 + 1) + 1
        held = top * (n2 - k2) / (needed * n2)
        if held >= TARGET:
            break
    # More partitions than needed make up for the subsets that a small set leaves empty.
    empty = min(0.5, comb(n2, k2) * exp(-least * (n2 - k2) / (needed * n2)))
    return int((needed + 1) / (1 - empty)) + 1, n2, k2


def signatures(elements: np.ndarray, num: int, den: int) -> np.ndarray:
    """PartEnum signatures of one set (int64); none where only equal sets can link."""
    size = len(elements)
    largest = size * den // num
    bands = _bands(largest)
    own = int(np.searchsorted(bands, size, side="right")) - 1
    values = mix(elements, seed=12)
    places = mix(elements, seed=13)
    out = []
    for band in range(own, len(bands) - 1):
        if bands[band] > largest:
            break
        top = int(bands[band + 1]) - 1
        k = 2 * top * (den - num) // (den + num)
        if k == 0:
            continue
        n1, n2, k2 = scheme(max(1, int(bands[band]) * num // den), top, k)
        part = (places % np.uint64(n1 * n2)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sorted_part = part[order]
        first = np.flatnonzero(np.diff(sorted_part, prepend=-1))
        sums, filled = np.zeros(n1 * n2, dtype=np.uint64), np.zeros(n1 * n2, dtype=bool)
        sums[sorted_part[first]] = np.add.reduceat(values[order], first)
        filled[sorted_part[first]] = True
        sums, filled = mix(sums, seed=14).reshape(n1, n2), filled.reshape(n1, n2)
        subsets = [list(x) for x in combinations(range(n2), n2 - k2)]
        odd = np.arange(n2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        label = np.arange(n1, dtype=np.uint64) * np.uint64(1 << 12) + np.uint64(band)
        total = np.stack([(sums[:, x] * odd[x]).sum(axis=1, dtype=np.uint64) + mix(label, seed=20 + i) for i, x in enumerate(subsets)], axis=1)
        used = np.stack([filled[:, x].any(axis=1) for x in subsets], axis=1)
        signed = mix(total, seed=16)
        # With k differences at least so many partitions have an equal subset.
        sure = n1 - k // (k2 + 1)
        out.append(signed[used] if (~used.all(axis=1)).sum() < sure else signed.ravel())
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def _linked(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    return linked_sets(docs, words, num, den, lambda elements: signatures(elements, num, den))


def ngram_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are runs of characters other than space and \\t..\\r, with A-Z
    lower-cased. A text with fewer than ``words`` words has its whole sequence
    as its one shingle. A null, empty or wordless text has no shingle and is
    linked with nothing: its component_id is its own doc_id. Equal sets always
    link. Rows that repeat a doc_id are rows of their own with the same ids in
    the result; a null doc_id counts only where no other is in its component.
    An empty table gives an empty result. Only doc_id and text are read.
    """
    return component_rows(*_linked(docs.select("doc_id", "text"), words, num, den))


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays.

    It is the row with the smallest doc_id (a null doc_id counts last, ties go
    by a hash of the whole row); rows alike in all columns count as one. Other
    rows may share its doc_id: they stay or go with their own texts. Rows
    without a word (null, empty, white space) are linked with nothing and all stay.
    """
    sets, by_set = _linked(docs, words, num, den)
    first = (
        sets.join(by_set, ["high", "low"])
        .groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("row"))
        .select("row.k1", "row.k2")
    )
    worded = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    stay = (
        docs.filter(worded).select(F.struct(*docs.columns).alias("row"), *row_key(docs))
        .join(materialise(first, "first"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
    )
    return stay.unionByName(docs.filter(~worded))
