import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import cardwright.llm.ngram_join as join
from cardwright.llm import linking
from cardwright.llm.ngram_join import drop_near_duplicates, ngram_components
from cardwright.llm.shingles import shingle_sets, shingles
from tests.llm.conftest import ODD_ROWS


def brute(rows, words, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i: i + words]) for i in range(len(w) - words + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return Counter(out)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    rows = []
    base = None
    for i in range(n):
        if i % 20 == 0:
            base = [str(rng.randrange(300)) for _ in range(rng.choice([4, 9, 30, 150]))]
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            copy[rng.randrange(len(copy))] = str(rng.randrange(300))
        if rng.random() < 0.3:
            copy = copy[: len(copy) - rng.randrange(1 + len(copy) // 8)]
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("words, num, den", [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_against_brute_force(make_docs, words, num, den):
    for seed in (1, 2):
        rows = near_copies(seed)
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(make_docs(rows), words, num, den).collect())
        assert got == brute(rows, words, num, den)


def test_sketches_fold_and_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((30, 40), (100, 700), (3000, 9000)):
        a, b = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, m, dtype=np.uint64)
        both = rng.integers(0, 2**63, 500, dtype=np.uint64)
        one, two = np.concatenate([a, both]), np.concatenate([b, both])
        rows = linking.folded([linking.sketch(one), linking.sketch(two)])
        apart = int(np.bitwise_count(rows[0] ^ rows[1]).sum())
        assert apart <= n + m and (apart > 0.7 * (n + m) or n + m > 5000)


def test_groups_dealt_as_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 4)
    rows = near_copies(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(make_docs(rows), 3, 80, 100).collect())
    assert got == brute(rows, 3, 80, 100)


def test_coarse_sketches_lose_no_link(make_docs, monkeypatch):
    monkeypatch.setattr(linking, "_forest", lambda bits, n, num, den: [(i, i + 1) for i in range(len(n) - 1)])
    rows = near_copies(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(make_docs(rows), 3, 80, 100).collect())
    assert got == brute(rows, 3, 80, 100)


def borderline(seed, n):
    """One base text, each copy with so many changes that about half of the pairs just fail."""
    rng = random.Random(seed)
    base = [str(rng.randrange(300)) for _ in range(120)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block, nearest", [(2048, 1), (8, 1), (8, 4)])
def test_rounds_find_the_links_that_forests_miss(make_docs, monkeypatch, block, nearest):
    """Clusters as a whole and by signature group; several rounds, as every component starts with one pair."""
    monkeypatch.setattr(linking, "BLOCK", block)
    monkeypatch.setattr(linking, "NEAREST", nearest)
    # The farthest possible pairs first, so that as many as can be are no links.
    real = linking._distance_limit
    monkeypatch.setattr(linking, "_forest", lambda bits, n, num, den: [(0, i) for i in range(1, len(n)) if real(n[:1], n[i:i + 1], num, den)[0] >= 0])
    rows = borderline(7, 60)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(make_docs(rows), 5, 80, 100).collect())
    want = brute(rows, 5, 80, 100)
    assert got == want and len({c for _, _, c in want}) > 2


def test_nearest_pairs_name_every_component(monkeypatch):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    n, component = np.full(40, 2000), np.repeat([5, 6, 7, 8], [20, 10, 6, 4])
    every = {(i, j) for i in range(40) for j in range(40) if component[i] != component[j] and component[i] != 5}
    pairs, more = linking._nearest(bits, n, component, 90, 100, 10_000)
    assert set(pairs) == every and not more
    pairs, more = linking._nearest(bits, n, component, 90, 100, 3)
    assert more and Counter(component[i] for i, _ in pairs) == {6: 3, 7: 3, 8: 3}


def test_odd_rows(make_docs):
    rows = [r[:2] for r in ODD_ROWS]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(make_docs(rows)).collect())
    assert got == brute(rows, 3, 90, 100)
    assert ngram_components(make_docs([])).collect() == []


def test_null_ids_link_and_bridge(make_docs):
    base = [f"w{i}" for i in range(200)]
    change = lambda at: " ".join("x" if i in at else w for i, w in enumerate(base))
    rows = [(None, change({3})), (5, change({3, 90})), (None, change(())), (9, change({3, 90, 150})), (9, "something else"), (7, change(()))]
    rows += [(None, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4"), (2**60 + 1, "far away from all"), (2**60 + 3, "far away from all")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(make_docs(rows), 3, 90, 100).collect())
    assert got == brute(rows, 3, 90, 100)


def test_long_words_that_a_polynomial_hash_confuses(make_docs):
    """Thue-Morse words of equal length are alike for any polynomial hash modulo a power of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, one), (2, one.translate({97: 98, 98: 97})), (3, "A b"), (4, "a B"), (5, "ab")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(make_docs(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}


def test_one_row_of_each_component_stays(make_docs):
    a, near, b = " ".join(map(str, range(100))), " ".join(map(str, [*range(99), "x"])), "quite another text of its own"
    rows = [(3, a), (5, near), (5, b), (None, a), (8, a), (8, a), (None, "alone in the world with no id"), (None, None), (6, " "), (6, " ")]
    docs = make_docs(rows).withColumn("k1", F.lit("x")).withColumn("row", F.lit(1))
    out = drop_near_duplicates(docs, 5, 80, 100)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(3, a), (5, b), (None, "alone in the world with no id"), (None, None), (6, " "), (6, " ")], key=repr)
    assert drop_near_duplicates(make_docs([])).collect() == []


def test_batches_with_fewer_words_than_a_shingle(make_docs):
    for texts in product(["", "a", "a b", "b c d", "a b c d e"], repeat=2):
        for words in range(1, 7):
            got = [(len(s), key) for s, key in shingle_sets(list(texts), words)]
            assert [n for n, _ in got] == [len(shingles(t.encode(), words)) for t in texts]
            assert (got[0][1] == got[1][1]) == (texts[0] == texts[1])
    rows = [(4, "one two"), (3, "One  TWO"), (5, "one")]
    assert Counter(map(tuple, ngram_components(make_docs(rows), 5, 80, 100).collect())) == brute(rows, 5, 80, 100)


def test_rows_that_differ_in_a_map_alone_are_two(spark):
    rows = [(1, "", {"a": 1}), (1, "one two", {"a": 1}), (1, "one two", {"a": 2}), (1, "one two", None), (1, "one two", {"a": 1}), (2, "x", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    keys = docs.select(*linking.row_key(docs)).distinct().count()
    assert keys == 5 and drop_near_duplicates(docs).count() == 3


def test_linked_sets_share_a_signature():
    """Signatures of linked sets always meet, whatever scheme the sizes take."""
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        for n in (6, 10, 19, 40, 90, 300, 2000):
            for _ in range(6):
                one = rng.integers(0, 2**63, n, dtype=np.uint64)
                gone = int(n * (den - num) / den)  # the other set lacks these
                two = one[gone:]
                swapped = np.concatenate([one[: n - (m := n * (den - num) // (den + num))], rng.integers(0, 2**63, m, dtype=np.uint64)])
                own = set(join.signatures(one, num, den).tolist())
                assert gone == 0 or own & set(join.signatures(two, num, den).tolist())
                assert m == 0 or own & set(join.signatures(swapped, num, den).tolist())


def test_subsets_are_enumerated_where_parts_are_small():
    assert join.scheme(900, 1000, 2 * 1000 * 10 // 190)[1:] == (1, 0)
    n1, n2, k2 = join.scheme(800, 1000, 2 * 1000 * 20 // 180)
    assert k2 > 0 and n1 * n2 < 1000


def test_shared_signatures_across_batches():
    rng = random.Random(1)
    for _ in range(200):
        rows = sorted((rng.randint(0, 6), rng.randint(0, 4)) for _ in range(rng.randint(1, 25)))
        frame = pd.DataFrame(rows, columns=["sig", "low"])
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randint(0, 4))))
        parts = [frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        got = sorted((r.sig, r.low, r.rank) for x in linking._shared(iter(parts)) for r in x.itertuples())
        want = []
        for s in {r[0] for r in rows}:
            ids = sorted({r[1] for r in rows if r[0] == s})
            want += [(s, i, k) for k, i in enumerate(ids)] if len(ids) > 1 else []
        assert got == sorted(want)
