import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardwright.llm import token_output
from cardwright.llm.token_output import ChunkEncoder, pack_ranks, read_token_file, unpack_ranks, write_token_file
from tests.llm.conftest import ODD_ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=100))
def test_packing_round_trip(values):
    v = np.array(values, dtype=np.uint32)
    [control], [data] = pack_ranks(v)
    assert (unpack_ranks(control, data)[: len(v)] == v).all() and len(control) == -(-len(v) // 4)


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=9))
def test_documents_pack_alone_and_together(docs):
    counts = np.array([len(d) for d in docs], dtype=np.int64)
    flat = np.array([v for d in docs for v in d], dtype=np.uint32)
    control, data = pack_ranks(flat, counts)
    assert [(c, d) for c, d in zip(control, data)] == [(c, d) for x in docs for [c], [d] in [pack_ranks(np.array(x, dtype=np.uint32))]]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_chunks_give_the_library_s_ids(library):
    encoder, rng = ChunkEncoder(PATH), random.Random(0)
    letters = "abcXYZé ñß'’“—_-.,;:12½²ª\n\t \u0085\x1c\x0b'sS'T'Re'VE'm'LL'd<|>ΣσİıǅÀ́ ​漢🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["<|startoftext|>a<|endoftext|>", "don't'LL", "x" * 500, ""]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def same_ids(library, texts):
    ids, sizes = ChunkEncoder(PATH).encode(pa.array(texts))
    ends = np.cumsum(sizes)
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    return [t for t, w, a, b in zip(texts, want, ends - sizes, ends) if ids[a:b].tolist() != w.ids]


def test_every_plain_and_every_white_character(library):
    """Alone, before and after a letter, between, behind an apostrophe and between spaces."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = [c for c in every if c.isspace() or c < "\u3100" or ChunkEncoder._plain.fullmatch(c)]
    assert not same_ids(library, [t for c in some for t in (c, f"a{c}", f"{c}a", f"a{c}b", f"1{c}'s", f"'{c}ll", f"foo {c} bar")])


def test_texts_over_all_planes(library):
    rng = random.Random(5)
    near = [*map(chr, range(0x20, 0x250)), *map(chr, range(0x2000, 0x2070)), *"\u00a0\u1680\u202f\u3000\u0085\ufeff"]

    def one():
        c = rng.randrange(0x110000)
        return rng.choice(near) if rng.random() < 0.8 or 0xD800 <= c < 0xE000 else chr(c)

    assert not same_ids(library, ["".join(one() for _ in range(rng.randint(0, 12))) for _ in range(60_000)])


def test_a_small_cache_gives_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_WORDS", 50)
    monkeypatch.setattr(token_output, "BLOCK_CHUNKS", 7)
    encoder, rng = ChunkEncoder(PATH), random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 400)}, é{rng.randint(0, 9)}" for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for part in token_output._slices(pa.array(texts)):
        ids, sizes = encoder.encode(part)
        assert ids.tolist() == [i for t in part.to_pylist() for i in library.encode(t, add_special_tokens=False).ids]


def test_another_tokenizer_file(spark, make_docs, tmp_path):
    """A file that keeps white space takes the library's own call."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert token_output.drops_white_space(PATH) and not token_output.drops_white_space(other)
    rows, own = [(k, t) for k, t in enumerate(["Two  words\n", None, " x", "\u00e9\u6f22 <|endoftext|> a", ""])], Tokenizer.from_file(other)
    path = f"file://{tmp_path}/other"
    write_token_file(make_docs(rows), path, other, end_id=50256)
    got = {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in read_token_file(spark, path).collect()}
    assert got == {d: own.encode(t or "", add_special_tokens=False).ids + [50256] for d, t in rows}


@pytest.mark.parametrize("rows", [[r[:2] for r in ODD_ROWS] + [(20, "Il a dit\u00a0: bonjour"), (21, "a\u00a0b \u00a0 it's\u00a0ok\u202f!\u3000\u6f22")], []])
def test_file_round_trip(spark, make_docs, library, tmp_path, rows):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    write_token_file(make_docs(rows).repartition(3), path, PATH)
    got = read_token_file(spark, path).withColumn("c", F.crc32("ids")).collect()
    assert len(got) == len(rows)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    texts, start = dict(rows), 0
    for r in ordered:
        ids = np.array(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["c"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
