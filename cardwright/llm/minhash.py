"""MinHash near-duplicates with circulant permutations.

Two permutations of the 64-bit numbers make all coordinates of a signature: the
first one scatters a set's shingles, and the second one is read from a start
that moves on circularly by one for every coordinate. Coordinate k is the least
value of second((first(x) - k) modulo 2^64) over the set. Runs of ``rows``
coordinates make a band; sets that agree in a band are candidates, which
``linking`` verifies on the texts' own shingles. The number of bands is such
that a pair just at the threshold misses them all with a probability of at most
MISS; sets that are more alike miss less.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import component_rows, linked_sets
from .shingles import mix

MISS = 1e-8
#: Values that one step works on, so that they stay in the processor's cache.
CELLS = 1 << 17


def bands_for(num: int, den: int, rows: int) -> int:
    """Bands with which a pair at the threshold num / den is missed with probability MISS at most."""
    if num >= den:
        return 1
    return max(1, ceil(log(MISS) / log(1 - (num / den) ** rows)))


def coordinates(elements: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values (uint64) of a set that is not empty."""
    first = mix(elements, seed=41)
    shifts = np.arange(count, dtype=np.uint64)[:, None]
    out = np.full(count, ~np.uint64(0))
    step = max(1, CELLS // count)
    for start in range(0, len(first), step):
        np.minimum(out, mix(first[None, start: start + step] - shifts, seed=42).min(axis=1), out=out)
    return out


def band_keys(elements: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key (int64) a band."""
    own = mix(coordinates(elements, bands * rows), seed=43).reshape(bands, rows)
    odd = np.arange(rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    label = mix(np.arange(bands, dtype=np.uint64), seed=44)
    return mix((own * odd).sum(axis=1, dtype=np.uint64) + label, seed=45).view(np.int64)


def minhash_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Sets, words and components are those of ``ngram_join.ngram_components``:
    null, empty and wordless texts have no shingle, link with nothing and are
    kept; rows that repeat a doc_id are rows of their own. A row is kept where
    its doc_id is its component_id (both null counts as equal), so of equal ids
    in one component all are kept. ``rows`` is the length of a band. An empty
    table gives an empty result; only doc_id and text are read.
    """
    bands = bands_for(num, den, rows)

    def signer(elements: np.ndarray) -> np.ndarray:
        n = len(elements)
        if n * den // num == n and -(-n * num // den) == n:
            return np.zeros(0, dtype=np.int64)  # so small that only equal sets can link
        return band_keys(elements, bands, rows)

    sets, by_set = linked_sets(docs.select("doc_id", "text"), words, num, den, signer)
    return component_rows(sets, by_set).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
