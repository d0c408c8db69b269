"""Token-ID output: frequency-ranked ids in byte-aligned variable length.

Layout of a token file (a folder that Spark writes, so any store will do):

``ranks``   one row per token id that occurs: rank, id. Rank 0 is the most
            frequent id of the corpus (ties: smaller id first).
``shards``  one row per run of documents, in output order: part, seq (the
            order of shards), part_offset (ids of the part before the shard),
            n_tokens, doc_ids, lengths, and the two streams of the ids' ranks:
            ``control`` with two bits per value (bytes used less one, four
            values to a byte, lowest bits first) and ``data`` with one to four
            little-endian bytes per value. Each document fills up its last
            control byte with zeros, so documents can be joined as bytes.

Every text is tokenised once. Its ids go to a work table, from which the
frequencies are counted; documents are sorted as ids, and ranks are packed as
the shards are written.

A tokenizer that drops white space and never joins across it is run on chunks
with a bounded cache in each worker, so that the ids are those of the whole
text (tests hold it against the library's own output). Which files are of this
kind is read from the file; any other file takes the library's batch call.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, release, shuffle_partitions, text_or_empty, tidy, write_settings

END_ID = 2
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 1 << 19
SLICE_BYTES = 2_000_000
BLOCK_CHUNKS = 1 << 19

#: Which of the four little-endian bytes of each of four values are stored, by control byte.
_KEEP = np.array(
    [[[b <= (c >> (2 * v)) & 3 for b in range(4)] for v in range(4)] for c in range(256)], dtype=bool
)


def pack_ranks(ranks: np.ndarray, counts: np.ndarray | None = None) -> tuple[list[bytes], list[bytes]]:
    """uint32 values of documents of ``counts`` values each (one document if not
    given) -> (control bytes, data bytes) of each, filled up with zeros to a
    multiple of four values."""
    counts = np.array([len(ranks)]) if counts is None else counts
    room = -(-counts // 4) * 4
    ends = np.cumsum(room)
    padded = np.zeros(int(room.sum()), dtype="<u4")
    padded[np.repeat(ends - room - (np.cumsum(counts) - counts), counts) + np.arange(len(ranks))] = ranks
    code = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    fours = code.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    data = padded.view(np.uint8)[_KEEP[control].ravel()].tobytes()
    sizes = np.concatenate([[0], np.cumsum(fours.sum(axis=1, dtype=np.int64) + 4)])
    cuts = np.concatenate([[0], ends // 4])
    bits, at = control.tobytes(), sizes[cuts].tolist()
    cuts = cuts.tolist()
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])], [data[a:b] for a, b in zip(at, at[1:])]


def unpack_ranks(control: bytes, data: bytes) -> np.ndarray:
    """Inverse of :func:`pack_ranks`, with its filling: one table lookup per control byte."""
    keep = _KEEP[np.frombuffer(control, dtype=np.uint8)].reshape(-1, 4)
    out = np.zeros((len(keep), 4), dtype=np.uint8)
    out[keep] = np.frombuffer(data, dtype=np.uint8)
    return out.view("<u4").ravel()


#: The text handling that ChunkEncoder takes over from a tokenizer file.
_CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {
            "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def drops_white_space(path: str) -> bool:
    """Whether the tokenizer file handles text in the way that ChunkEncoder takes over."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return (
        all(spec.get(k) == v for k, v in _CHUNKED.items()) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        and not any(spec.get(k) for k in ("truncation", "padding"))
        and all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        and not any(re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


class WholeEncoder:
    """Token ids by the library's own batch call, for any tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16

    def forget(self) -> None:
        """Nothing is kept between calls."""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter((i for one in ids for i in one), dtype=np.uint32, count=int(sizes.sum())), sizes


class ChunkEncoder(WholeEncoder):
    """Token ids of texts through a cache of chunks (what white space separates).

    Arrow cuts a batch into chunks and finds its distinct ones; only these meet
    the cache. Chunks of plain Latin text are lower-cased and cut as the
    tokenizer cuts them (``_piece`` is its pattern), and its model encodes the
    unknown pieces. Other chunks, those with white space beyond ASCII among
    them, go through the whole tokenizer one by one.
    """

    _plain = re.compile("[\t-\r -~\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e]*")
    _piece = re.compile(r"[a-z\xb5\xdf-\xf6\xf8-\u017f]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-z0-9\xb5\xdf-\xf6\xf8-\u017f]+")

    def __init__(self, path: str):
        super().__init__(path)
        # Byte-level vocabularies write a byte as its own character where that can be printed, else from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self.index: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {}
        self.filled = self.known = 0
        self.starts, self.sizes = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.store = np.zeros(1 << 18, dtype=np.uint32)

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.known + len(chunks), self.filled + len(ids)
        if n > len(self.sizes):
            self.starts, self.sizes = np.resize(self.starts, 2 * n), np.resize(self.sizes, 2 * n)
        if m > len(self.store):
            self.store = np.resize(self.store, 2 * m)
        self.store[self.filled: m] = ids
        self.sizes[self.known: n] = sizes
        self.starts[self.known: n] = self.filled + np.cumsum(sizes) - sizes
        self.index.update(zip(chunks, range(self.known, n)))
        self.known, self.filled = n, m

    def _encode_piece(self, piece: str) -> list[int]:
        mapped = piece if piece.isascii() else "".join([self.shown[b] for b in piece.encode()])
        ids = self.pieces[piece] = [t.id for t in self.tokenizer.model.tokenize(mapped)]
        return ids

    def _learn(self, chunks: list[str]) -> None:
        plain, odd = [], []
        for chunk in chunks:
            (plain if self._plain.fullmatch(chunk) and "<|" not in chunk else odd).append(chunk)
        known, flat, sizes = self.pieces.get, [], []
        for chunk in map(str.lower, plain):
            before = len(flat)
            for piece in [chunk] if chunk.isalpha() else self._piece.findall(chunk):
                flat += known(piece) or self._encode_piece(piece)
            sizes.append(len(flat) - before)
        self._keep(plain, np.array(flat, dtype=np.uint32), np.array(sizes, dtype=np.int64))
        if odd:
            self._keep(odd, *super().encode(pa.array(odd)))
        if len(self.pieces) > CACHE_WORDS // 2:
            self.pieces = {}

    def _places(self, chunks: list[str]) -> np.ndarray:
        """The cache's place of each of some distinct chunks."""
        if len(self.index) + len(chunks) > CACHE_WORDS:
            self.forget()
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._learn([chunks[k] for k in missing])
            at[missing] = [self.index[chunks[k]] for k in missing]
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        chunks = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        coded = chunks.flatten().dictionary_encode()
        at = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        parts = [np.zeros(0, dtype=np.uint32)]
        for some in (at[k: k + BLOCK_CHUNKS] for k in range(0, len(at), BLOCK_CHUNKS)):
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            parts.append(self.store[np.repeat(self.starts[some] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))])
        upto = np.concatenate([[0], np.cumsum(self.sizes[at])])[np.concatenate([[0], np.cumsum(counts)])]
        return np.concatenate(parts), np.diff(upto)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WholeEncoder:
    return ChunkEncoder(path) if drops_white_space(path) else WholeEncoder(path)


def _id_type(path: str, end_id: int) -> str:
    """Two bytes an id in work tables where the vocabulary allows it."""
    return "<u4" if _encoder(path).wide or end_id >= 1 << 16 else "<u2"


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about SLICE_BYTES."""
    upto, start = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(texts):
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _binary(blob: bytes, ends: np.ndarray) -> pa.Array:
    """Consecutive parts of ``blob`` as binary values."""
    if len(blob) >= 1 << 31:
        return pa.array([blob[a:b] for a, b in zip([0, *ends], ends)], pa.binary())
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(blob)])


def _tokenise(path: str, end_id: int):
    """Appends n_tokens and ids (little-endian, the end id last) to rows with ``text`` as the last column."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = _encoder(path), np.dtype(_id_type(path, end_id))
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(batch.num_columns - 1)):
                ids, sizes = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(at, len(texts)).columns[:-1], pa.array(sizes + 1),
                        _binary(ids.tobytes(), np.cumsum(sizes + 1) * kind.itemsize),
                    ],
                    names=[*batch.schema.names[:-1], "n_tokens", "ids"],
                )
                at += len(texts)
        encoder.forget()  # the worker may serve other stages next

    return tokenise


def _count_ids(kind: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind))
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return count


def _write_shards(ranked: np.ndarray, kind: str):
    """Rows (doc_id, n_tokens, ids) of one partition in order -> its shards, the ids as packed ranks."""
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, offset = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, control, data, size = [], [], [], [], 0
        for batch in batches:
            columns = batch.to_pydict()
            n = np.array(columns["n_tokens"], dtype=np.int64)
            start = 0
            while start < len(n):
                # Up to the document that fills the shard.
                stop = start + int(np.searchsorted(np.cumsum(n[start:]), SHARD_TOKENS - size)) + 1
                stop = min(stop, len(n))
                ids = np.frombuffer(b"".join(columns["ids"][start:stop]), dtype=kind)
                bits, low = pack_ranks(rank_of[ids], n[start:stop])
                doc_ids += columns["doc_id"][start:stop]
                lengths += columns["n_tokens"][start:stop]
                control += bits
                data += low
                size += len(ids)
                start = stop
                if size >= SHARD_TOKENS:
                    yield _shard(part, seq, offset, size, doc_ids, lengths, control, data)
                    doc_ids, lengths, control, data, seq, offset, size = [], [], [], [], seq + 1, offset + size, 0
        if doc_ids:
            yield _shard(part, seq, offset, size, doc_ids, lengths, control, data)

    return write


def _shard(part: int, seq: int, offset: int, size: int, doc_ids: list, lengths: list, control: list, data: list) -> pa.RecordBatch:
    row = {
        "part": part, "seq": seq, "part_offset": offset, "n_tokens": size, "doc_ids": doc_ids, "lengths": lengths,
        "control": b"".join(control), "data": b"".join(data),
    }
    return pa.RecordBatch.from_pylist([row], schema=_ARROW_SHARDS)


_ARROW_SHARDS = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("part_offset", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()),
])
_SHARDS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
    T.StructField("part_offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType()),
])


def write_token_file(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, order_by: tuple[str, ...] = ("doc_id",)
) -> None:
    """Tokenise every whole text and write the token file ``path``.

    Documents follow each other in ascending ``order_by`` (nulls first; rows
    with equal keys in any order). Null text counts as empty, so it gives the
    end id alone. Columns other than doc_id, text and the order are not read.
    doc_id is kept as a long: one that is no number becomes null, or is an
    error in ANSI mode.
    An empty table gives a file without shards.
    """
    spark = docs.sparkSession
    order = [f"order_{k}" for k in range(len(order_by))]
    keyed = docs.select(
        *[F.col(c).alias(name) for name, c in zip(order, order_by)],
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
    )
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1]]
    tokens = materialise(
        keyed.mapInArrow(tidy(_tokenise(tokenizer_path, end_id)), ", ".join([*kinds, "n_tokens long", "ids binary"])), "token-ids", "zstd"
    )
    id_type = _id_type(tokenizer_path, end_id)
    counts = (
        tokens.select("ids").mapInArrow(_count_ids(id_type), "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    )
    ranked = np.array([r["id"] for r in counts.collect()], dtype=np.int64)  # at most the vocabulary
    spark.createDataFrame(
        pd.DataFrame({"rank": np.arange(len(ranked)), "id": ranked}), "rank int, id int"
    ).coalesce(1).write.parquet(f"{path}/ranks")
    with write_settings(spark):
        # The bounds of the ranges come from a sample of the work table; ranks are packed after the exchange, once.
        (
            tokens.repartitionByRange(shuffle_partitions(spark), *order)
            .sortWithinPartitions(*order)
            .select("doc_id", "n_tokens", "ids")
            .mapInArrow(tidy(_write_shards(ranked, id_type)), _SHARDS)
            .write.parquet(f"{path}/shards")
        )
    release(tokens)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian unsigned 32-bit), decoded from a token file."""
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    ids = {r["rank"]: r["id"] for r in spark.read.parquet(f"{path}/ranks").collect()}
    ranked = np.array([ids[k] for k in range(len(ids))], dtype="<u4")
    # One row per output part; there are as many as the writer asked for.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, upto = {}, 0
    for row in totals:
        starts[row["part"]], upto = upto, upto + row["n"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.itertuples(index=False):
                lengths = np.asarray(s.lengths, dtype=np.int64)
                ends, room = np.cumsum(lengths), -(-lengths // 4) * 4
                blob = ranked[unpack_ranks(s.control, s.data)].tobytes()
                starts_at = np.cumsum(room) - room
                yield pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(d) else int(d) for d in s.doc_ids], dtype="Int64"),
                    "start": starts[s.part] + s.part_offset + ends - lengths,
                    "n_tokens": lengths,
                    "ids": [blob[4 * a: 4 * (a + n)] for a, n in zip(starts_at, lengths)],
                })

    return shards.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids binary")
