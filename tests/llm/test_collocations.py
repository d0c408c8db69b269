import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from cardwright.llm import collocations as module
from cardwright.llm.collocations import collocations
from tests.llm.conftest import ODD_ROWS


def brute(rows, longest=3, least=10, top=2000, covered=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i: i + k]] = max(held[p[i: i + k]], a)
        scored = []
        for p, a in cand.items():
            if held[p] and 100 * held[p] >= covered * a:
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = ["The", "the", "of", "new", "york", "City", "é", "Ω", "漢字", "x\x00", "a b", "it's", " ", "\x01"]
    ends = [" ", "  ", "\t", " ", " ", " ", ". ", ",", "\n", ";", "!", "?", ":", "\x0b", "\x0c", "\r"]
    return [
        (i, "".join(rng.choice([" ", ""]) + "".join(rng.choices(words, range(len(words), 0, -1))) + rng.choice(ends) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None]))
        for i in range(docs)
    ]


@pytest.mark.parametrize("longest, least, top", [(3, 10, 2000), (2, 3, 2000), (4, 4, 5)])
def test_against_brute_force(make_docs, longest, least, top):
    rows = corpus(1) + [(500 + i, "again and again and again and again", "de") for i in range(6)]
    got = made(collocations(make_docs(rows), longest, least, top))
    assert got == brute([r[1:] for r in rows], longest, least, top) and got


@pytest.mark.parametrize("gather", [1, 300, 8_000_000])
def test_hot_heads_and_small_gatherings(spark, make_docs, monkeypatch, gather):
    """One word begins half of all contexts, and one pair most of these."""
    monkeypatch.setattr(module, "GATHER_BYTES", gather)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["hot pair", "hot", f"w{rng.randrange(9)}", "hot pair end."]) for _ in range(50)), "en") for i in range(60)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = made(collocations(make_docs(rows).repartition(5), 4, 6))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute([r[1:] for r in rows], 4, 6)


def test_ties_go_by_bytes_and_to_the_first_cut(make_docs):
    rows = [(i, "b a. é z. z é. Z\U0001f600 q. p q r", "en") for i in range(10)]
    got = made(collocations(make_docs(rows)))
    assert got == brute([r[1:] for r in rows])
    assert [g[2] for g in got] == ["b a", "p q r", "z\U0001f600 q", "z é", "é z"]


def test_odd_rows(make_docs):
    rows = [(*r[:2], None if len(r) < 3 else r[2]) for r in ODD_ROWS]
    assert made(collocations(make_docs(rows))) == brute([r[1:] for r in rows])
    assert collocations(make_docs([])).collect() == [] and collocations(make_docs([(1, None, "en"), (2, " .\n", "en")])).collect() == []
    with pytest.raises(ValueError):
        collocations(make_docs([]), longest=1)


def test_counts_beyond_64_bits_in_products(spark):
    """Scores of counts whose products need more than 64 bits are exact."""
    n = 3_037_000_501
    phrases = spark.createDataFrame([("en", "a b", 2, n)], "lang string, phrase string, size int, n long")
    counts = spark.createDataFrame([("en", "a", n + 2), ("en", "b", n * 7)], "lang string, phrase string, n long")
    [row] = module._scored(phrases, counts, 3).collect()
    assert row["score"] == 1_000_000 * n * n // ((n + 2) * 7 * n)


def test_contexts_end_with_pieces():
    lang, head, tail, n = module.contexts(pa.array(["A b, c d e f", "", "c d  e\tf"]), pa.array(["x"] * 3), 3)
    got = sorted(zip(head.to_pylist(), tail.to_pylist(), n.tolist()))
    assert got == [("a", "b", 1), ("b", "", 1), ("c", "d e", 2), ("d", "e f", 2), ("e", "f", 2), ("f", "", 2)]
