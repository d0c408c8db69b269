"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read back as the next one's input.

Language ID drops documents without a language; of near duplicates (five-word
shingles, similarity 0.8) one stays; documents that hold a benchmark item go;
what is left is put in the order of the target mix; and in this order it is
written as token ids and read back. The order travels in the files: the mix
writes them sorted, and the last stage reads them by file name and row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwright.llm.common import release_path, shuffle_partitions, table, work_path
from cardwright.llm.decontamination import drop_contaminated
from cardwright.llm.language_id import UNDETERMINED, fit_language_model, held_out, identify
from cardwright.llm.ngram_join import drop_near_duplicates
from cardwright.llm.queries import MIX_WEIGHTS
from cardwright.llm.source_mix import mix_sources
from cardwright.llm.token_output import read_token_file, write_token_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is undetermined: null texts and texts without a letter."""
    model = fit_language_model(docs.select("doc_id", "text", "lang").filter(~held_out()))
    names = ["lang_pred", "score", "ambiguous"]
    plain = docs.select(*[F.col(c).alias(f"doc_{c}") for c in docs.columns if c != "text"], "text")
    kept = identify(plain, model).filter(F.col("lang_pred") != UNDETERMINED).drop(*names)
    return kept.select(*[F.col(c if c == "text" else f"doc_{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays, once; a null doc_id counts last."""
    return drop_near_duplicates(docs, words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item within its error budget."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the target mix: sorted over and within partitions."""
    parts, rows = shuffle_partitions(spark), max(1, docs.count())
    mixed = mix_sources(docs, MIX_WEIGHTS)
    # Positions run from 0 to rows - 1, so a row's partition is arithmetic and needs no sample.
    return (
        mixed.repartitionById(parts, F.expr(f"cast(mix_position * {parts} div {rows} as int)")).sortWithinPartitions("mix_position")
        .select(*docs.columns)
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the token file, which
    holds the documents in the order of the files they come in (by number) and of
    the rows in them."""
    path = work_path(spark, "pipeline-tokens")
    # Spark numbers the files it writes with at least five digits, so names are compared by number.
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    placed = docs.select("doc_id", "text", number.alias("file"), F.col("_metadata.row_index").alias("row"))
    write_token_file(placed, path, public_tokenizers.path("word_bpe_49k.json"), order_by=("file", "row"))
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each on the files of the one before,
    which go when the next ones are written. Work tables and the token file
    stay until ``cardwright.llm.common.clear_work(spark)``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            release_path(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # it has written its file, and reads that alone
    release_path(spark, before)
    return out
