"""Word shingles of whole texts, a slice of texts at a time: as 64-bit hashes
for candidate search, and as they are for verification.

A slice is cut into words by Arrow; each distinct word is hashed once, by a
keyed 128-bit hash of its bytes. A set's key is 128 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1_000_000
_SEED = 0x632BE59BD9B4E019


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(two 64-bit hashes of every word, as rows, number of words of each text); A-Z count as a-z."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts, flat = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64), cut.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # not so before and behind outer white space
    coded = flat.dictionary_encode()
    hashed = [xxhash.xxh3_128_digest(w, _SEED) for w in coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()]
    each = np.frombuffer(b"".join(hashed), dtype="<u8").reshape(-1, 2)
    owner = np.repeat(np.arange(len(counts)), counts)[full]
    codes = coded.indices.to_numpy(zero_copy_only=False)[full]
    return each[codes].T, np.bincount(owner, minlength=len(counts))


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _set_key(elements: np.ndarray, others: np.ndarray) -> tuple[int, int]:
    """128 bits (two signed numbers) of a set, whose elements have two hashes each."""
    sums = np.array([mix(elements, seed=7).sum(dtype=np.uint64), mix(others, seed=8).sum(dtype=np.uint64)], dtype=np.uint64)
    low, high = mix(sums + np.uint64(len(elements)), seed=9).view(np.int64).tolist()
    return high, low


def shingle_sets(texts: list[str | None], words: int) -> Iterator[tuple[np.ndarray, tuple[int, int] | None]]:
    """For each text the sorted distinct hashes of its ``words``-word shingles, and the set's key.

    A text with fewer words gives its whole sequence as one shingle; null and
    wordless texts give an empty set, whose key is None.
    """
    for part in _slices(texts):
        hashes, counts = _words(pa.array(part, pa.string()))
        grams = np.zeros(hashes.shape, dtype=np.uint64)
        for j in range(min(words, hashes.shape[1])):
            grams[:, : hashes.shape[1] - j] += mix(hashes[:, j:], seed=j + 1)
        grams = mix(grams, seed=99)
        stops = np.cumsum(counts)
        for start, stop in zip(stops - counts, stops):
            if stop - start >= words:
                elements, first = np.unique(grams[0, start: stop - words + 1], return_index=True)
                yield elements, _set_key(elements, grams[1, start: stop - words + 1][first])
            elif stop > start:
                both = np.zeros(2, dtype=np.uint64)
                for j in range(stop - start):
                    both += mix(hashes[:, start + j], seed=j + 1)
                both = mix(both, seed=100 + int(stop - start))
                yield both[:1], _set_key(both[:1], both[1:])
            else:
                yield np.zeros(0, dtype=np.uint64), None


def shingles(text: bytes, words: int) -> set[tuple[bytes, ...]]:
    """The shingles of one text (UTF-8) themselves."""
    own = text.lower().split()  # of bytes: A-Z alone are lowered, and these six spaces part words
    if len(own) < words:
        return {tuple(own)} if own else set()
    return set(zip(*[own[j:] for j in range(words)]))
