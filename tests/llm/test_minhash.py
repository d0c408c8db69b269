from collections import Counter

import numpy as np
import pytest

from cardwright.llm import minhash
from cardwright.llm.minhash import band_keys, bands_for, coordinates, minhash_components
from cardwright.llm.shingles import mix
from tests.llm.conftest import ODD_ROWS
from tests.llm.test_ngram_join import borderline, brute, near_copies


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


@pytest.mark.parametrize("words, num, den, rows_", [(5, 85, 100, 5), (3, 70, 100, 3)])
def test_against_brute_force(make_docs, words, num, den, rows_):
    rows = near_copies(1) + [(1000 + d, t) for d, t in borderline(2, 30)]
    assert found(minhash_components(make_docs(rows), words, num, den, rows_)) == brute(rows, words, num, den)


def test_odd_rows(make_docs):
    rows = [r[:2] for r in ODD_ROWS]
    assert found(minhash_components(make_docs(rows))) == brute(rows, 5, 80, 100)
    assert minhash_components(make_docs([])).collect() == []


def test_coordinates_are_one_permutation_read_from_shifted_starts():
    one = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    first = [int(x) for x in mix(one, seed=41)]
    got = coordinates(one, 40)
    for k in (0, 1, 17, 39):
        shifted = np.array([(x - k) % 2**64 for x in first], dtype=np.uint64)
        assert got[k] == mix(shifted, seed=42).min()


def test_steps_change_nothing(monkeypatch):
    one = np.random.default_rng(2).integers(0, 2**63, 3000, dtype=np.uint64)
    whole = coordinates(one, 160)
    monkeypatch.setattr(minhash, "CELLS", 1000)
    assert (coordinates(one, 160) == whole).all()


def test_coordinates_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.7, 0.9):
        both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        one, two = (np.concatenate([both, rng.integers(0, 2**63, (1000 - len(both)) // 2, dtype=np.uint64)]) for _ in range(2))
        assert (coordinates(one, 4000) == coordinates(two, 4000)).mean() == pytest.approx(share, abs=0.04)


def test_pairs_at_the_threshold_share_a_band():
    bands, rng, missed = bands_for(85, 100, 5), np.random.default_rng(4), 0
    assert bands == 32
    for n in (7, 13, 40, 300):
        for _ in range(300):
            one = rng.integers(0, 2**63, n, dtype=np.uint64)
            two = one[: -(-n * 85 // 100)]
            missed += not set(band_keys(one, bands, 5).tolist()) & set(band_keys(two, bands, 5).tolist())
    assert missed == 0
