"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each scan partition fingerprints its texts (SHA-256, native). The narrow
   table (row key, doc_id, digest) is written to the shared folder, bucketed by
   *chunk* (rows of one scan partition, at most 2**CHUNK_BITS), so that a chunk
   is read twice without an exchange. A chunk is the sender.
2. A chunk sorts its distinct fingerprints - the digest's first bits, eight more
   than it takes to number the rows - splits them by owner (the leading bits)
   and sends each owner one Golomb-coded message. A text that a chunk holds a
   thousand times is sent once.
3. An owner decodes its messages, finds the fingerprints that came from more
   than one chunk and answers every message with a bitmap.
4. A chunk turns bitmaps and its own repeats into suspect rows. Only suspects
   meet their digest's group, and only their texts are compared byte by byte,
   with map-side combine; a digest that stood for two different texts would
   stop the job.

Nothing grows with a group of copies: a chunk and an owner hold fingerprints
only, an owner's share is bounded by the number of owners, which follows the
number of rows, and groups are summed by partial aggregation. The last join,
of suspects with their groups, reads two written tables, so a digest that very
many rows share is split by adaptive execution.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_filter, materialise, may_hold, release, release_path, shuffle_partitions, text_or_empty, work_path

CHUNK_BITS = 20
OWNER_FINGERPRINTS = 1 << 22
SPARE_BITS = 8


# --- Golomb-Rice messages -------------------------------------------------

def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as a Golomb-Rice message.

    The gaps are coded with a power-of-two parameter: quotients in unary in
    one bit stream, remainders of fixed width in another, so that both sides
    work on whole arrays.
    """
    n = len(values)
    if n == 0:
        return b""
    first, gaps = int(values[0]), np.diff(values)
    mean = float(gaps.astype(np.float64).mean()) if n > 1 else 1.0
    width = max(0, min(63, int(math.log2(max(1.0, mean * math.log(2))))))
    quotient = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + n - 1, dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    shifts = np.arange(width, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8)
    head = b"".join(map(_varint, (n, width, first, len(unary))))
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def _varint(value: int) -> bytes:
    """Seven bits a byte, the lowest first; the last byte is less than 128."""
    out = bytearray()
    while value >= 128:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _read_varints(message: bytes, count: int) -> tuple[list[int], int]:
    """(``count`` values, where the rest begins)."""
    out, at = [], 0
    for _ in range(count):
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if message[at - 1] < 128:
                break
        out.append(value)
    return out, at


def golomb_decode(message: bytes) -> np.ndarray:
    """Inverse of :func:`golomb_encode`."""
    if not message:
        return np.zeros(0, dtype=np.uint64)
    (n, width, first, n_unary), at = _read_varints(message, 4)
    body = np.frombuffer(message, dtype=np.uint8, offset=at)
    cut = (n_unary + 7) // 8
    ends = np.flatnonzero(np.unpackbits(body[:cut], count=n_unary) == 0)
    quotient = np.diff(ends, prepend=-1) - 1
    low = np.zeros(n - 1, dtype=np.uint64)
    if width:
        bits = np.unpackbits(body[cut:], count=(n - 1) * width).reshape(n - 1, width)
        low = (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    gaps = (quotient.astype(np.uint64) << np.uint64(width)) + low
    return np.concatenate([np.array([first], dtype=np.uint64), np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)])


def _fingerprints(digests: pa.ChunkedArray, width: int) -> np.ndarray:
    """The first ``width`` bits of each digest."""
    whole = b"".join(c.cast(pa.binary(32)).buffers()[1][32 * c.offset: 32 * (c.offset + len(c))].to_pybytes() for c in digests.chunks)
    return np.frombuffer(whole, dtype=">u8")[::4].astype(np.uint64) >> np.uint64(64 - width)


def _owners(fingerprints: np.ndarray, width: int, bits: int) -> np.ndarray:
    return (fingerprints >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(fingerprints), dtype=np.int64)


def _send(width: int, bits: int):
    def send(key: tuple, rows: pa.Table) -> pa.Table:
        distinct = np.unique(_fingerprints(rows["digest"], width))
        owner = _owners(distinct, width, bits)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        # What the owner knows is not sent: its own bits.
        parts = np.split(distinct - (owner.astype(np.uint64) << np.uint64(width - bits) if bits else np.uint64(0)), cuts[1:])
        return pa.table({
            "owner": pa.array(owner[cuts], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
            "message": pa.array([golomb_encode(p) for p in parts], pa.binary()),
        })

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [golomb_decode(m) for m in pdf["message"]]
    sizes = np.array([len(p) for p in parts])
    merged = np.concatenate(parts)
    order = np.argsort(merged, kind="stable")
    same = merged[order][1:] == merged[order][:-1]
    repeated = np.zeros(len(merged), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    bitmaps = [np.packbits(b).tobytes() for b in np.split(repeated, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"chunk": pdf["chunk"], "owner": pdf["owner"], "bitmap": bitmaps})


def _suspects(width: int, bits: int):
    def suspects(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        own = _fingerprints(rows["digest"], width)
        distinct, counts = np.unique(own, return_counts=True)
        flagged = counts > 1
        by_owner = dict(zip(bitmaps["owner"].to_pylist(), bitmaps["bitmap"].to_pylist()))
        owner = _owners(distinct, width, bits)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        for start, stop in zip(cuts, [*cuts[1:], len(distinct)]):
            packed = np.frombuffer(by_owner[owner[start]], dtype=np.uint8)
            flagged[start:stop] |= np.unpackbits(packed, count=stop - start).astype(bool)
        return rows.select(["row_key", "doc_id", "digest"]).append_column("suspect", pa.array(flagged[np.searchsorted(distinct, own)]))

    return suspects


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty, so all null
    and empty texts form one group. Of equal texts the row with the largest
    doc_id stays (a null doc_id sorts first). Rows that share doc_id and text
    are copies too, and exactly one of them stays. An empty table gives an
    empty result. Only ``doc_id`` and ``text`` are read, whatever other
    columns there are.
    """
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    name, path = f"cardwright_fingerprints_{uuid.uuid4().hex}", work_path(spark, "fingerprints")
    row_key = F.monotonically_increasing_id()
    docs.select(row_key.alias("row_key"), F.shiftright(row_key, CHUNK_BITS).alias("chunk"), "doc_id", digest.alias("digest")).write.bucketBy(
        parts, "chunk"
    ).option("path", path).saveAsTable(name)
    rows = spark.table(name)
    try:
        n_rows = rows.count()
        width = min(64, math.ceil(math.log2(n_rows + 1)) + SPARE_BITS)
        bits = math.ceil(math.log2(n_rows // OWNER_FINGERPRINTS + 1))
        messages = rows.select("chunk", "digest").groupBy("chunk").applyInArrow(_send(width, bits), "owner long, chunk long, message binary")
        bitmaps = messages.groupBy("owner").applyInPandas(_answer, "chunk long, owner long, bitmap binary")
        id_type = rows.schema["doc_id"].dataType.simpleString()
        flagged = materialise(
            rows.groupBy("chunk").cogroup(bitmaps.groupBy("chunk"))
            .applyInArrow(_suspects(width, bits), f"row_key long, doc_id {id_type}, digest binary, suspect boolean"),
            "flagged",
        )
    finally:
        spark.sql(f"DROP TABLE {name}")
    release_path(spark, path)
    suspects, others = flagged.filter("suspect").drop("suspect"), flagged.filter("NOT suspect")
    groups = materialise(
        suspects.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row_key")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "copies",
    )
    # Byte verification: the texts of suspects only, combined on the map side.
    suspected = may_hold(key_filter(groups, F.xxhash64("digest")), F.xxhash64("digest"))
    texts = (
        docs.select(digest.alias("digest"), text_or_empty().alias("text")).filter(suspected).distinct()
        .groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"))
    )
    verified = materialise(
        groups.join(texts, "digest", "left").select(
            "digest",
            F.when(F.col("n_texts") == 1, F.col("best"))
            .otherwise(F.raise_error(F.lit("one digest, several texts")).cast("struct<doc_id:%s,row_key:bigint>" % id_type))
            .alias("best"),
            "n",
        ),
        "groups",
    )
    release(groups)
    copies = suspects.join(verified, "digest", "left")
    unique = others.select("*", F.lit(None).cast("struct<doc_id:%s,row_key:bigint>" % id_type).alias("best"), F.lit(None).cast("long").alias("n"))
    return copies.unionByName(unique.drop("suspect")).select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("best.row_key") == F.col("row_key"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
