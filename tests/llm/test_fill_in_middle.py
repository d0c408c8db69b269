import hashlib
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cardwright.llm import fill_in_middle as fim
from cardwright.llm.fill_in_middle import Sentinels, fill_in_middle, restore_text
from tests.llm.conftest import LONG, ODD_ROWS

MARKS = Sentinels()


def brute(doc_id, text, percent=100, spm=50):
    """By lists of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    if h[3] % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def depth(rope):
    return 0 if isinstance(rope, fim.Leaf) else 1 + max(depth(rope.left), depth(rope.right))


@given(st.lists(st.text("ab\n\r<PS>é🙂", max_size=30), max_size=12), st.integers(1, 7), st.data())
def test_ropes_count_cut_and_join(parts, leaf, data):
    old, fim.LEAF = fim.LEAF, leaf
    try:
        text = "".join(parts)
        rope, lines = fim.build(text), re.findall(r"[^\n]*\n|[^\n]+", text)
        assert (rope.units if rope else 0) == len(lines) and (rope.chars if rope else 0) == len(text)
        k = data.draw(st.integers(0, len(lines)))
        a, b = fim.split(rope, k, "units")
        assert fim.read(a) == "".join(lines[:k]) and fim.read(b) == "".join(lines[k:])
        assert (b.units if b else 0) == len(lines) - k
        at = data.draw(st.integers(0, len(text)))
        a, b = fim.split(rope, at, "chars")
        assert fim.read(a) == text[:at] and fim.read(b) == text[at:]
        back = fim.concat(b, a)
        assert fim.read(back) == text[at:] + text[:at] and (back.units if back else 0) >= len(lines)
    finally:
        fim.LEAF = old


def test_ropes_stay_balanced(monkeypatch):
    monkeypatch.setattr(fim, "LEAF", 4)
    rng, rope = random.Random(1), fim.build("line\n" * 4000)
    for _ in range(300):
        a, b = fim.split(rope, rng.randrange(4001), "units")
        rope = fim.concat(b, a)
    leaves = len(fim.read(rope)) // 4
    assert rope.units == 4000 and depth(rope) == rope.height <= 1.45 * leaves.bit_length() + 3


@given(st.text("<>PSMab\n", max_size=40), st.sampled_from(["psm", "spm"]), st.data())
def test_every_cut_comes_back(text, form, data):
    rope = fim.build(text)
    if rope is None or MARKS.inside(text):
        return
    low, high = sorted(data.draw(st.tuples(*[st.integers(0, rope.units)] * 2)))
    out, prefix, middle = fim.transform(rope, low, high, form, MARKS)
    assert fim.restore(fim.read(out), form, MARKS) == text and out.chars == len(text) + 9


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 30), (0, 50)])
def test_rows_against_brute_force(make_docs, percent, spm):
    rng = random.Random(3)
    rows = [r[:2] for r in ODD_ROWS]
    rows += [(100 + i, "".join(rng.choice(["a line\n", "é\r\n", "\n", "<P", ">", "<M>", " ", "\x0b"]) for _ in range(rng.randrange(30)))) for i in range(150)]
    rows += [(300, LONG + "\n" + LONG), (301, "\n" * 5000), (302, "x"), (303, "\n")]
    made = fill_in_middle(make_docs(rows), "7", percent, spm)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()), key=repr)
    assert got == sorted(((d, *brute(d, t, percent, spm)) for d, t in rows), key=repr)
    back = sorted(((r["doc_id"], r["restored"]) for r in restore_text(made).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t in rows), key=repr)
    assert len({r[2] for r in got}) == (1 if percent == 0 else 3)


def test_batches_are_cut_by_size(make_docs, monkeypatch):
    monkeypatch.setattr(fim, "BATCH", 50)
    rows = [(i, f"one\ntwo {i}\nthree\n" * (i % 5)) for i in range(40)]
    rows_out = {r["doc_id"]: r["restored"] for r in restore_text(fill_in_middle(make_docs(rows).coalesce(1))).collect()}
    assert rows_out == dict(rows)


def test_empty_table_and_bad_sentinels(make_docs):
    assert restore_text(fill_in_middle(make_docs([]))).collect() == []
    for own in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P><S>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            Sentinels(*own)


def test_other_sentinels(make_docs):
    marks = Sentinels("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    rows = [(i, "a\nb <P>\nc<|fim_\n" * (i % 4)) for i in range(20)] + [(99, "x<|fim_middle|>")]
    made = fill_in_middle(make_docs(rows), marks=marks)
    assert {r["doc_id"]: r["restored"] for r in restore_text(made, marks).collect()} == dict(rows)
    assert {r["form"] for r in made.filter("doc_id = 99").collect()} == {"plain"}
