"""The pipeline against a brute-force version, and the queries against their oracles."""

import os
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cardwright.llm import common, queries
from cardwright.llm.decontamination import ERROR_EVERY, normalise
from cardwright.llm.source_mix import edf_period
from tests.llm.test_ngram_join import brute as brute_components
from tests.llm.test_decontamination import distance
from tests.test_queries import compare, duck  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_the_oracle(spark, duck, name):  # noqa: F811
    compare(spark, duck, name, queries.queries()[name], queries.oracle_sql()[name])


def mixed(rows, weights, block):
    """Positions by simulating every slot."""
    import hashlib

    groups = {}
    for r in rows:
        groups.setdefault(r["source"] if r["source"] in weights else "*", []).append(r)
    weights = {"*": 1} | weights
    queue = {}
    for g, own in groups.items():
        own.sort(key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
        queue[g] = [own[i: i + block] for i in range(0, len(own), block)]
    out = []
    while queue:
        live = {g: weights[g] for g in queue}
        owner = {t: g for g, slots in edf_period(live).items() for t in slots}
        now = 0
        while all(queue.values()):
            out += queue[owner[now % len(owner)]].pop(0)
            now += 1
        queue = {g: q for g, q in queue.items() if q}
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_whole_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).selectExpr("100000 + doc_id AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = [r.asDict() for r in docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))]
    first = {(d, c) for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80, 100)}
    rows = [r for r in rows if (r["doc_id"], r["doc_id"]) in first]
    items = [normalise(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    def leaks(text):
        text = normalise(text)
        for item in items:
            pieces = len(item) // ERROR_EVERY + 1
            cuts = [len(item) * i // pieces for i in range(pieces + 1)]
            if any(item[a:b] in text for a, b in zip(cuts, cuts[1:])) and distance(item, text) <= len(item) // ERROR_EVERY:
                return True
        return False
    rows = mixed([r for r in rows if not leaks(r["text"])], queries.MIX_WEIGHTS, 8)
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for r in rows:
        ids = np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [2], dtype="<u4")
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_mixed_documents_stand_in_order_over_all_files(spark, make_docs, tmp_path):
    docs = make_docs([(k, f"t{k}", "en", f"src{k % 7}") for k in range(300)])
    corpus_pipeline.mix(spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    got = spark.read.parquet(f"{tmp_path}/mixed").selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS r").orderBy("f", "r").collect()
    want = queries.mix_sources(docs, queries.MIX_WEIGHTS).orderBy("mix_position").collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want] and len({r["f"] for r in got}) > 1


def test_repeated_and_null_ids_lose_no_document(spark, make_docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = make_docs([(3, a), (5, a), (5, b), (None, b), (None, c), (7, c.replace("c0 ", "x "))])
    got = sorted(((r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=repr)
    assert got == [(3, "a"), (5, "b"), (7, "x")]


def test_a_run_leaves_only_what_its_result_reads(spark):
    corpus_pipeline.run(spark, SF).count()
    left = {p.name.rsplit("-", 1)[0] for p in Path(common._own_root(spark).removeprefix("file://")).iterdir()}
    assert not any(name.startswith("pipeline-") and name != "pipeline-tokens" for name in left)
    common.clear_work(spark)
    assert not Path(common._own_root(spark).removeprefix("file://")).exists()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert stage(spark, docs.limit(0), SF).count() == 0
