import pytest
from pyspark.sql import functions as F

from cardwright.llm import common
from cardwright.llm.common import filter_words, key_filter, may_hold
from cardwright.llm.exact_dedup import exact_dedup
from cardwright.llm.line_dedup import line_dedup


def test_a_filter_follows_the_number_of_keys():
    assert [filter_words(n) for n in (0, 1, 16_384, 16_385, 16_777_216, 10**12)] == [4096, 4096, 4096, 8192, 1 << 22, 1 << 22]
    for n in (20_000, 300_000, 5_000_000):
        assert 16 * n <= 64 * filter_words(n) < 32 * n + 64


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_no_key_is_missed_and_few_others_pass(spark, n):
    keys = spark.range(n).select(F.xxhash64("id").alias("h"))
    seen = spark.range(40_000).select("id", may_hold(key_filter(keys, F.col("h")), F.xxhash64("id")).alias("hit"))
    assert seen.filter("hit").filter(F.col("id") < n).count() == n
    assert seen.filter("hit").filter(F.col("id") >= n).count() <= 40_000 / 16 * 1.2 * (n > 0)


def test_a_full_filter_changes_no_result(make_docs, monkeypatch):
    rows = [(i, f"text {i % 90}\nsecond\nthird {i % 7}\nlast") for i in range(300)]
    results = lambda: (
        sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(make_docs(rows)).collect()),
        sorted((r["doc_id"], r["n_removed"], r["text"]) for r in line_dedup(make_docs(rows)).collect()),
    )
    before = results()
    monkeypatch.setattr(common, "FILTER_WORDS", (1, 1))
    assert results() == before
