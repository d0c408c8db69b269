"""Language ID by error-correcting output codes over hashed letter n-grams.

Every language has a codeword of bits; for every bit a binary n-gram
classifier (log-odds of hashed bigrams and trigrams, from the languages with
the bit against those without) predicts its value. Decoding weighs each bit's
logistic loss by how far the bit's two sides lie apart in the training counts
and chooses the nearest codeword; a runner-up about as near flags ambiguity.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

UNDETERMINED = "und"
FEATURE_BITS = 16
MAX_TRAIN_DOCS = 20_000
MARGIN_SCALE = 6.0
AMBIGUOUS_BELOW = 0.6
SLICE_CHARS = 250_000
_TABLE: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    """Code points as lower-case letters or marks, 32 for everything else. A
    worker's table is filled in rows of 256, those that it meets."""
    if not _TABLE:
        _TABLE.extend([np.full((0x110000 >> 8, 256), 32, dtype=np.uint32), np.zeros(0x110000 >> 8, dtype=bool)])
    table, known = _TABLE
    met = np.zeros(len(known), dtype=bool)
    met[codes >> 8] = True
    for row in np.flatnonzero(met & ~known).tolist():
        for low in range(256):
            c = chr(row << 8 | low)
            if unicodedata.category(c)[0] in "LM":
                table[row, low] = ord(c.lower()[0])
        known[row] = True
    return table.ravel()[codes]


def _ngrams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hashed features, how many each text has), slice by slice.

    Non-letters count as one space, and every text begins and ends with one;
    features are the bigrams and trigrams inside a text.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE_CHARS):
            size += len(texts[last])
            last += 1
        lengths = np.fromiter((len(t) + 2 for t in texts[first:last]), dtype=np.int64, count=last - first)
        joined = "".join(f" {t} " for t in texts[first:last]).encode("utf-32-le", "surrogatepass")
        codes = _letters(np.frombuffer(joined, dtype=np.uint32))
        owner = np.repeat(np.arange(last - first), lengths)
        blank = codes == 32
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
        codes, owner = codes[keep], owner[keep]
        two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
        shift = np.uint32(32 - FEATURE_BITS)
        hashed = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
        in_two, in_three = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
        at = np.concatenate([owner[1:][in_two], owner[2:][in_three]])
        features = np.concatenate([hashed(two)[in_two], hashed(three)[in_three]])
        order = np.argsort(at, kind="stable")
        yield first, features[order], np.bincount(at, minlength=last - first)
        first = last


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all distinct splits up to six languages, else
    the best of a fixed series of random codes by smallest distance."""
    if n <= 6:
        bits = max(0, 2 ** (n - 1) - 1)
        return np.array([[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for c in range(bits)] for i in range(n)], dtype=np.float32).reshape(n, bits)
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7)

    def least(code: np.ndarray) -> float:
        apart = (bits - code @ code.T) / 2
        return float((apart + np.eye(n) * bits).min())

    return max((rng.choice(np.array([-1, 1], dtype=np.float32), (n, bits)) for _ in range(50)), key=least)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their codewords, a weight of each feature for each bit, and each bit's say."""

    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    says: np.ndarray

    def distances(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for first, features, counts in _ngrams(texts):
            ends = np.cumsum(counts)
            total = np.zeros((len(counts), self.codes.shape[1]))
            some = counts > 0
            if some.any():
                total[some] = np.add.reduceat(self.weights[features], (ends - counts)[some], axis=0)
            margin = MARGIN_SCALE * total / np.maximum(counts, 1)[:, None]
            for k, code in enumerate(self.codes):
                out[first: first + len(counts), k] = (self.says * np.logaddexp(0, -code * margin)).sum(axis=1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score from 0 to 1, ambiguous) of each text."""
        known = np.array([has_letter(t) for t in texts], dtype=bool) & (len(self.langs) > 0)
        langs, score, unsure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        at = np.flatnonzero(known)
        if len(at):
            far = self.distances([texts[i] for i in at])
            near = np.exp(far.min(axis=1, keepdims=True) - far)
            best = far.argmin(axis=1)
            score[at] = 1 / near.sum(axis=1)
            unsure[at] = score[at] < AMBIGUOUS_BELOW
            for i, k in zip(at, best):
                langs[i] = self.langs[k]
        return langs, score, unsure


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, own in pdf.groupby("lang"):
            total = counts.setdefault(lang, np.zeros(1 << FEATURE_BITS, dtype=np.int64))
            for _, features, _ in _ngrams(own["text"].tolist()):
                total += np.bincount(features, minlength=1 << FEATURE_BITS)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "feature": at, "n": total[at]})


def fit_language_model(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> LanguageModel:
    """Learn from ``labelled`` (doc_id, text, lang).

    Rows with a null lang or text teach nothing. A language with more than
    ``max_docs`` rows is represented by a sample of about ``max_docs`` whole
    texts, chosen by a hash of doc_id, so the cost of learning is bounded.
    To the driver come at most 2**16 counts per language.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = tuple(sorted(sizes))
    codes = codewords(len(langs))
    if not langs:
        return LanguageModel((), codes.reshape(0, 0), np.zeros((1 << FEATURE_BITS, 0), np.float32), np.zeros(0))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, max_docs / n) * (1 << 20))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 20)) < share)
    counts = (
        sample.select("lang", "text").mapInPandas(tidy(_count_features), "lang string, feature int, n long")
        .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    )
    shares = np.zeros((len(langs), 1 << FEATURE_BITS))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        shares[k, own["feature"]] = own["n"]
        shares[k] = (shares[k] + 0.5) / (shares[k].sum() + 0.5 * (1 << FEATURE_BITS))
    weights = np.zeros((1 << FEATURE_BITS, codes.shape[1]), dtype=np.float32)
    says = np.ones(codes.shape[1])
    for b in range(codes.shape[1]):
        on, off = shares[codes[:, b] > 0].mean(axis=0), shares[codes[:, b] < 0].mean(axis=0)
        weights[:, b] = np.log(on / off)
        says[b] = ((on - off) * weights[:, b]).sum()
    return LanguageModel(langs, codes, weights, says / max(says.mean(), 1e-9) if len(says) else says)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and ambiguous, from ``text`` alone.

    A text that is null or has no letter gets ``und`` with score 0, as does
    every text where the model knows no language. Columns of ``docs`` named
    like an added one are replaced.
    """
    added = ["lang_pred", "score", "ambiguous"]
    kept = docs.select(*[c for c in docs.columns if c.lower() not in added])
    import pyarrow as pa

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, unsure = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(unsure)],
                names=[*batch.schema.names, *added],
            )

    kinds = zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()))
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, kind) for c, kind in kinds]])
    return kept.mapInArrow(tidy(predict), schema)


def held_out(doc_id: str = "doc_id"):
    """The rows that nothing is learned from: crc32 of doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
