"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []


def work_root(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``; where that is
    unset a temporary folder, which is right only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="cardwright-"))
        root = _LOCAL_ROOT[0]
    return f"{root.rstrip('/')}/cardwright-tables/{spark.sparkContext.applicationId}"


def clear_work_tables(spark: SparkSession) -> None:
    """Delete this application's work tables, when nothing reads its results any more."""
    _delete(spark, work_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, read back: its lineage ends here, so losing an executor costs a re-read."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that no unfinished DataFrame reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._work_path)


#: Where a row of :func:`sorted_table` stands: the number of its file, and its place in it from 0.
FILE, ROW = "_file", "_row"


def sorted_table(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written in the order of ``keys`` over and within its files, with the
    columns FILE and ROW. A range exchange deals the rows out; adaptive execution
    lets the number of its parts follow the table's size."""
    table = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys), "sorted")
    out = table.select(
        "*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias(FILE), F.col("_metadata.row_index").alias(ROW)
    )
    out._work_path = table._work_path
    return out
