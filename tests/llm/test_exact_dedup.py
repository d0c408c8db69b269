import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cardwright.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode
from tests.llm.conftest import ODD_ROWS


@given(st.sets(st.integers(0, 2**64 - 1), max_size=200))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), dtype=np.uint64)
    assert (golomb_decode(golomb_encode(v)) == v).all()


def test_golomb_is_compact():
    v = np.unique(np.random.default_rng(0).integers(0, 2**63, 10_000, dtype=np.uint64))
    assert 8 * len(golomb_encode(v)) < 52 * len(v)  # log2 of the mean gap, and about 1.5 bits


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    key = lambda i: (i is not None, i)
    return {t: (max(ids, key=key), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}


@pytest.mark.parametrize("rows", [[r[:2] for r in ODD_ROWS], [(i, f"t{i % 7}") for i in range(500)], [(i, "same") for i in range(300)]])
def test_against_brute_force(make_docs, rows):
    want = brute(rows)
    got = exact_dedup(make_docs(rows).repartition(5)).collect()
    texts = {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == want[texts[r["doc_id"]]]
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len(want)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_no_rows(make_docs):
    assert exact_dedup(make_docs([])).collect() == []
