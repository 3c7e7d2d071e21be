from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from docweave.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
CODER = T.PieceCoder(PATH)


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(100, 300), min_size=1, max_size=400), max_size=6))
def test_round_trip(docs):
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    ids = np.array([i for d in docs for i in d], dtype=np.uint32)
    payload, at = T.pack(ids, lengths)
    assert T.unpack(payload, lengths, at).tolist() == ids.tolist()


CASES = ["", " ", "Hello, World!!", "don't It's", "a\xa0b c", "É́ é ñ", "<|endoftext|> <|ENDOFTEXT|> A", "\x1cq 12x,3", "ΑΣ ΣΑΣ", "K ſ İ", "x" * 3000, "thed, thed. (it)", "日本 語", "a'b .' '", "Éa\xd7 ÀÖØÞß ÿ÷ x²", "e\u0301. é\u0301,", "été, ÉTÉ.."]


@pytest.mark.parametrize("text", CASES)
def test_ids(text):
    ids, n = CODER.encode([text.encode()], 1)
    assert ids.tolist() == whole(text) and n.tolist() == [len(ids)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abSsZ9. \n\té'\x85<|>日")) | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_any_text(texts):
    ids, n = CODER.encode([t.encode() for t in texts], 1)
    assert ids.tolist() == [i for t in texts for i in whole(t)] and n.tolist() == [len(whole(t)) for t in texts]


def test_files(spark):
    rows = [(5, "one two", 1), (3, None, 2), (3, "x y", 3), (9, "", 4), (-2, "w " * 5000, 5), (3, "x y", 6), (None, "null id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")  # a clashing extra column
    got = sorted(map(tuple, T.token_files(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, -2, 3, 3, 3, 5, 9]
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    want = sorted((i if i is not None else -99, len(whole(t)), zlib.crc32(np.array(whole(t), "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((r[0] if r[0] is not None else -99, r[2], r[3]) for r in got) == want
    assert T.token_files(docs.limit(0)).collect() == []


def test_several_chunks_of_a_shard(spark):
    body = [f"w{i % 7} x. " * (i % 5 * 3000) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(body)), "doc_id int, text string").coalesce(1)
    got = sorted(map(tuple, T.token_files(docs).collect()))
    own = [whole(t) for t in body]
    assert sum(map(len, own)) > 2 * T.CHUNK_IDS
    assert got == [(i, sum(map(len, own[:i])), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in enumerate(own)]


def test_views_nulls_and_splits_of_an_array():
    texts = pa.array([b"cut", None, b"  two  words.\n", b"<|endoftext|> A", b"", b"ABC abc abc."], pa.binary())
    ids, n = CODER.encode(texts.slice(1), 1)
    own = [whole(t.decode() if t else "") for t in texts.to_pylist()[1:]]
    assert ids.tolist() == [i for d in own for i in d] and n.tolist() == list(map(len, own))
    assert CODER.encode(texts.slice(0, 0), 1)[1].tolist() == []


def test_the_cache_counts_what_it_holds():
    coder = T.PieceCoder(PATH)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    coder.encode([" ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}lang" for i in range(17000)).encode()], 1)
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert held <= coder.size * 1.1
