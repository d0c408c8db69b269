import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardwright.llm.chat_format import ChatTemplate, chat_segments, conversation_digests, escape, escape_role, turn_order, unescape, unescape_role

SCHEMA = "conv_id long, turn long, role string, text string, segments string, valid int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|\\im_start>end\n%0A a", max_size=12), min_size=1, max_size=40))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("b"), unescape_role(escape_role(F.col("t"))).alias("r"), escape_role(F.col("t")).alias("er"))
    for row in df.collect():
        assert row["b"] == row["t"] == row["r"] and "<|" not in row["e"] and "\n" not in row["er"]


def test_digests_read_back(spark):
    rows = [
        (1, 1, "assistant", "yo <|im_end|>\\|"), (1, 0, "user", "hi\n<|im_start|>user\nx"), (2, 0, "user", None), (2, None, "system", "s"),
        (3, 0, "assistant", "é漢"), (None, 0, None, "no role"), (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "assistant", "<\\|b"),
    ]
    got = {r["conv_id"]: r for r in conversation_digests(turns(spark, rows)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        said, loss = "".join(f"{r}\n{x}\n" for *_, r, x in own), "".join(x for *_, r, x in own if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: g["valid"] for c, g in got.items()} == {1: True, 2: False, 3: False, None: False, 4: False}


def test_a_long_conversation_is_checked_in_blocks(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "t") for i in range(2000)]
    assert turn_order(turns(spark, rows)).first()["valid"] is True
    broken = [(c, t, "user" if t == 1001 else r, x) for c, t, r, x in rows]
    assert turn_order(turns(spark, broken)).first()["valid"] is False


def test_segments_carry_the_loss(spark):
    out = chat_segments(turns(spark, [(1, 0, "assistant", "x")]), ChatTemplate(open="[", role_end="]", close="/")).first()
    assert [(s["text"], s["loss"]) for s in out["segments"]] == [("[assistant]", False), ("x", True), ("/", False)]


@pytest.mark.parametrize("job", [chat_segments, conversation_digests, turn_order])
def test_no_rows(spark, job):
    assert job(turns(spark, [])).collect() == []
