"""Helpers shared by the training-data operators: work tables and sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
#: While a work table is written its shuffles end with the write, and batches for Python are cut by bytes, as texts may be long.
_WRITE_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, which is right
    only in local mode; on a cluster the absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="cardwright-"))
    return "file://" + _LOCAL_ROOT[0]


def work_path(spark: SparkSession, name: str) -> str:
    return f"{_own_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/cardwright/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Delete all work tables and token files of this application, when nothing reads its results any more."""
    release_path(spark, _own_root(spark))


@contextmanager
def write_settings(spark: SparkSession) -> Iterator[None]:
    """The session with _WRITE_SETTINGS; its own values come back afterwards."""
    before = {k: spark.conf.get(k) for k in _WRITE_SETTINGS}
    for k, v in _WRITE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` over batches; when a partition is done its unused Arrow
    memory goes back, as the worker stays alive for later stages."""

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return run


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: losing an executor later costs a re-read, and the
    values (row keys, chunk ids) no longer depend on how the input is scanned.
    The shuffles that made the table are deleted with the end of the write.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    with write_settings(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete work tables that no unfinished DataFrame reads any more."""
    for df in tables:
        path = getattr(df, "_work_path", None)
        if path:
            release_path(df.sparkSession, path)


def release_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_lines(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """Write a text file to any store, a megabyte at a time."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    try:
        held, size = [], 0
        for line in lines:
            held.append(line)
            size += len(line)
            if size > 1 << 20:
                out.write(bytearray(("\n".join(held) + "\n").encode()))
                held, size = [], 0
        out.write(bytearray("".join(x + "\n" for x in held).encode()))
    finally:
        out.close()


#: Bits of a key filter for each key, and the least and most 64-bit words of one (32 kB, 32 MB).
FILTER_BITS, FILTER_WORDS = 16, (1 << 12, 1 << 22)


@dataclass(frozen=True)
class KeyFilter:
    """One row of ``words`` 64-bit words with a bit set for each key."""

    bits: DataFrame
    words: int


def filter_words(keys: int) -> int:
    """Words of a filter for so many keys: a power of two. Up to 16.8 million keys one
    hash in 16 or fewer passes by chance; with 100 million it is a third, with 270 million two thirds."""
    least, most = FILTER_WORDS
    return min(most, max(least, 1 << max(0, -(-keys * FILTER_BITS // 64) - 1).bit_length()))


def key_filter(keys: DataFrame, hashed: Column) -> KeyFilter:
    """A filter by 64-bit hashes ``hashed`` of ``keys``, a work table, sized by
    their number up to 32 MB. Beyond it lets more through, so it saves work and
    decides nothing."""
    n = filter_words(keys.count())
    word = F.pmod(hashed, F.lit(n)).cast("int").alias("word")
    words = keys.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), _filter_bit(hashed)).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    whole = keys.sparkSession.range(n).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    pairs = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return KeyFilter(whole.agg(F.transform(pairs, lambda p: p["bits"]).alias("bits")), n)


def _filter_bit(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 58).cast("int")


def may_hold(filter_: KeyFilter, hashed: Column) -> Column:
    """False where no key of :func:`key_filter` has this hash."""
    word = F.get(filter_.bits.scalar(), F.pmod(hashed, F.lit(filter_.words)).cast("int"))
    return F.call_function("shiftrightunsigned", word, _filter_bit(hashed)).bitwiseAND(F.lit(1)) == 1


def hashable(docs: DataFrame) -> list[Column]:
    """All columns of ``docs`` as values that can be hashed: those with maps as JSON, entries in their own order."""
    return [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
