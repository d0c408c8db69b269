import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest

from cardwright.llm.language_id import codewords, fit_language_model, held_out, identify
from tests.llm.conftest import ODD_ROWS


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 40):
        code = codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert (apart + np.eye(n) * 99).min() >= 1
    assert codewords(4).shape == (4, 7) and codewords(1).shape == (1, 0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", held_out().alias("held"))
    model = fit_language_model(docs.filter("NOT held"))
    pdf = identify(docs.filter("held AND lang IS NOT NULL"), model).toPandas()
    assert len(pdf) > 200 and (pdf["lang"] == pdf["lang_pred"]).mean() >= 0.99
    assert pdf["score"].between(0, 1).all()


def test_a_prediction_depends_on_its_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs)
    texts = [r["text"] for r in docs.limit(40).collect()]
    together = model.distances(texts)
    alone = np.vstack([model.distances([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)


def brute(train, texts):
    """Counts, bit classifiers and decoding in plain Python: {(language, score)} of each text."""
    def features(text):
        codes = [32]
        for c in f"{text} ":
            x = ord(c.lower()[0]) if unicodedata.category(c)[0] in "LM" else 32
            if x != 32 or codes[-1] != 32:
                codes.append(x)
        out, low = [], 0xFFFFFFFF
        for i in range(len(codes) - 1):
            two = (codes[i] * 0x9E3779B1 + codes[i + 1] * 0x85EBCA77) & low
            grams = [two] + ([(two * 0xC2B2AE3D + codes[i + 2] * 0x27D4EB2F + 1) & low] if i + 2 < len(codes) else [])
            out += [(((g ^ g >> 15) * 0x2C1B3C6D) & low) >> 16 for g in grams]
        return out

    counts = {}
    for text, lang in train:
        counts.setdefault(lang, Counter()).update(features(text))
    langs = sorted(counts)
    totals = {g: sum(counts[g].values()) for g in langs}
    share = lambda g, f: (counts[g][f] + 0.5) / (totals[g] + 0.5 * 65536)
    code = {g: row.tolist() for g, row in zip(langs, codewords(len(langs)))}
    sides = [([g for g in langs if code[g][b] > 0], [g for g in langs if code[g][b] < 0]) for b in range(len(code[langs[0]]))]

    def mean(gs, f):
        return sum(share(g, f) for g in gs) / len(gs)

    every = set().union(*counts.values())
    says = []
    for on, off in sides:
        said = [(a - b) * math.log(a / b) for a, b in ((mean(on, f), mean(off, f)) for f in every)]
        rest = next(f for f in range(65536) if f not in every)
        a, b = mean(on, rest), mean(off, rest)
        says.append(sum(said) + (65536 - len(every)) * (a - b) * math.log(a / b))
    says = [x / (sum(says) / len(says)) for x in says]
    out = []
    for text in texts:
        own = features(text)
        margins = [6 * sum(math.log(mean(on, f) / mean(off, f)) for f in own) / len(own) for on, off in sides]
        far = {g: sum(w * math.log1p(math.exp(-c * m)) for w, c, m in zip(says, code[g], margins)) for g in langs}
        best = min(langs, key=far.get)
        out.append((best, 1 / sum(math.exp(far[best] - d) for d in far.values())))
    return out


@pytest.mark.parametrize("n_langs", [3, 8])
def test_against_brute_force(make_docs, n_langs):
    rng = random.Random(n_langs)
    letters = "abcdefghijklmnopqrstuvwxyz\u00e4\u00e9\u00f1\u010d\u0434\u043b\u03c9"
    tongues = {f"l{k}": rng.choices(letters, k=9) for k in range(n_langs)}
    say = lambda g, n: " ".join("".join(rng.choice(tongues[g]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    train = [(say(g, 12) + rng.choice([".", " !", "", " 42"]), g) for g in tongues for _ in range(6)]
    texts = [say(rng.choice(list(tongues)), rng.randint(1, 9)) for _ in range(40)] + ["A", "\u010c b,  c", f"{say('l0', 3)} {say('l1', 3)}"]
    model = fit_language_model(make_docs([(k, t, g) for k, (t, g) in enumerate(train)]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["ambiguous"]) for r in identify(make_docs(list(enumerate(texts))), model).collect()}
    for k, (lang, score) in enumerate(brute(train, texts)):
        assert got[k][1] == pytest.approx(score, abs=1e-3) and got[k][2] == (got[k][1] < 0.6)
        assert got[k][0] == lang or score < 0.5


def test_odd_rows(make_docs):
    docs = make_docs(ODD_ROWS)
    got = identify(docs, fit_language_model(docs)).collect()
    assert len(got) == len(ODD_ROWS)
    for r in got:
        blank = not (r["text"] and any(map(str.isalpha, r["text"])))
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1
    nothing = identify(docs, fit_language_model(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and {r["score"] for r in nothing} == {0.0}
    assert identify(docs.limit(0), fit_language_model(docs)).collect() == []
    one = fit_language_model(docs.filter("lang = 'de'"))
    assert {r["lang_pred"] for r in identify(docs, one).collect()} == {"de", "und"}
