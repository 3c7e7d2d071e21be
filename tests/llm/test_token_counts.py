from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from docweave.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
COUNTER = T.PieceCounter(PATH)
CASES = ["", " ", "\n", "a", " a", "a ", "a  b", "a b\nc d", "x\n\ny z", "it's  we'll don't 'tis", "a b c", "é́ ñ", "<|endoftext|>", "a <|endoftext|> b",
         "x<|endoftext|>\ny", "a\tb c", "\x1cq r\x1cs", "日本 語", "1 23 4567 .. !! ??", "a" * 5000, "ab " * 3000 + "x" * 200, "a\r\nb", " \n ", "a \n b"]


def whole(text):
    return len(WHOLE.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(text):
    assert T.count_texts([text], COUNTER) == [whole(text)]


@pytest.mark.parametrize("text", ["a\tb\tc\n\n\nd", "col1\tcol2\tcol3\n\n\nnext", "a\xa0b  c", "a\tb ", "\na\tb"])
def test_other_white_space_does_not_make_up_for_runs(text):
    assert T.count_texts([text], COUNTER) == [whole(text)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sZ9. \n\té  \x85<|>日")) | st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    assert T.count_texts([text], COUNTER) == [whole(text)]


def test_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "y"), (4, "w " * 600, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")  # a clashing extra column
    got = sorted(map(tuple, T.token_counts(docs, PATH, 512).collect()), key=str)
    want = sorted([(i, len((t or "").encode()), whole(t or ""), whole(t or "") > 512) for i, t, _ in rows], key=str)
    assert got == want
    assert T.token_counts(docs.limit(0), PATH, 512).collect() == []
