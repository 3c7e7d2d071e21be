"""Token counts: texts are encoded in Arrow batches and only the numbers of tokens come back.

A text is cut at boundaries across which the byte-level pre-tokenizer never joins characters: a single blank or
newline between two characters that are not white space. Equal pieces are encoded once per worker and their lengths
kept, so that the library sees each piece of the running vocabulary once; very long texts need no special case, as
their pieces are short. Texts with other runs of white space are cut at their single blanks only.

Result by case: a null or empty text has 0 bytes and 0 tokens; white space alone counts as the library counts it; a
text without a safe boundary is encoded whole; repeated rows and null ids keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table

#: Pieces up to this many characters are kept in a worker's cache, and so many of them.
PIECE_CHARS, CACHE_PIECES = 64, 1_500_000
#: Characters given to the library in one encode_batch call.
CALL_CHARS = 1 << 18

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space that is no single blank or newline between two other characters.
_UNEVEN = re.compile(r"[^\S \n]|\s\s|\A\s|\s\Z")
_counters: dict[str, "PieceCounter"] = {}


class PieceCounter(dict):
    """Piece -> number of tokens. A piece stands for itself behind a blank, or behind the newline it starts with."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def lengths(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CALL_CHARS or i + 1 == len(texts):
                batch = self.tokenizer.encode_batch_fast(texts[start: i + 1], add_special_tokens=False)
                out.extend(len(e) for e in batch)
                start, size = i + 1, 0
        return out

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self]
        self.update(zip(new, self.lengths([_as_text(p) for p in new])))


def _as_text(piece: str) -> str:
    return piece if piece[:1] == "\n" else " " + piece


def cut(text: str) -> tuple[list[str], bool]:
    """The pieces of a text; True if they follow the newline form, which has one newline too many."""
    if not _UNEVEN.search(text):  # every separator is a single blank or newline
        return ("\n" + text).replace("\n", " \n")[1:].split(" "), True
    first, *rest = _SAFE.split(text)
    return [first, *(" " + p for p in rest)], False


def count_texts(texts: list[str], counter: PieceCounter) -> list[int]:
    """Tokens of each text, as the library gives them for the whole text."""
    regular = [cut(t) if t else ([], False) for t in texts]
    if len(counter) > CACHE_PIECES:
        counter.clear()
    new: set[str] = set()
    for pieces, form in regular:
        if form:
            new.update(pieces)
    counter.learn({p for p in new if p not in counter and len(p) <= PIECE_CHARS})
    long = [p for p in new if len(p) > PIECE_CHARS]
    uncached = dict(zip(long, counter.lengths([_as_text(p) for p in long])))
    out = []
    for pieces, form in regular:
        if not form:
            out.append(sum(counter.lengths(pieces)))
        elif uncached:
            out.append(sum(uncached[p] if len(p) > PIECE_CHARS else counter[p] for p in pieces) - 1)
        else:
            out.append(sum(map(counter.__getitem__, pieces)) - 1)
    return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_bytes, n_tokens and over_limit of every row. ``tokenizer``: path of a byte-level tokenizer file on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(tokenizer) or _counters.setdefault(tokenizer, PieceCounter(tokenizer))
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                tokens = np.array(count_texts(texts, counter), dtype=np.int64)
                size = np.array([len(t.encode()) if t else 0 for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


QUERIES = {"op5_token_counts": op5_token_counts}
