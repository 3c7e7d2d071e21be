"""Benchmark decontamination with spaced seeds.

A seed is the hash of the words at the set places of a mask, wherever the mask is laid; words at its other places may
differ. Hashes of the benchmark's items form an index, which every task joins with the hashes of its documents. A hit
gives an item and a shift; along it the words of both are compared, and a stretch of which at least SHARE of the words
agree is a match if it has MIN_WORDS words. The longest stretch of a document and item comes first, then the longest that
shares no word with those taken, and so on; each is a row. The benchmark is indexed in blocks of a bounded size.

No such stretch is without a seed. It can be cut into pieces of MIN_WORDS to 2 * MIN_WORDS - 1 words, of which one agrees
in SHARE of its words; that piece holds 10 words with at most 2 differences or 15 with 3, and MASKS hit all placements of
those (a test lays them all). Items under MIN_WORDS words match as a whole: from 5 words on with one difference, through
masks that each leave out a part of the item, and without any below.

Words are the letters and digits between white space, in lower case.

Result by case: null, empty and wordless texts and items match nothing; items with the same words all match, an item given
twice counts once; equal documents give equal results; null ids stay; an empty benchmark or table gives no matches. An
item under SURE_WORDS words is reported wherever it stands, but ``clean`` drops a document for it only if the item is all
of its words, since running text holds such words anyway.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import keeping, slices, store, table

#: Weight 6 each, found by search: four such masks can't hit all placements, these five do.
MASKS = ("1111011", "11011101", "10101111", "110010111", "1111000011")
MIN_WORDS, SHARE = 10, 0.8
#: Words that the masks of an item under MIN_WORDS keep where a word may differ.
SHORT_WEIGHT = 4
SURE_WORDS = 5
#: Bytes of benchmark text that are indexed and broadcast at once.
BLOCK_BYTES = 8 << 20
#: Pieces of text kept in a worker's cache, and bytes of text that are worked on at once.
CACHE_PIECES, SLICE_BYTES = 300_000, 2 << 20

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Piece of text between white space -> 64-bit hash of its word, 0 if it has none."""

    def __missing__(self, piece: str) -> int:
        import xxhash

        word = "".join(_WORD.findall(piece))
        self[piece] = value = (xxhash.xxh64_intdigest(word.encode()) or 1) if word else 0
        return value

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, one after another, and where each text's begin."""
        if len(self) > CACHE_PIECES:
            self.clear()
        parts = [np.fromiter(map(self.__getitem__, p), dtype=np.uint64, count=len(p)) for p in ((t or "").lower().split() for t in texts)]
        parts = [p[p > 0] for p in parts]
        ends = np.cumsum([0, *map(len, parts)])
        return np.concatenate([np.zeros(0, dtype=np.uint64), *parts]), ends


_words = Words()


def seeds(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the masked words at every place where the mask fits, whatever texts it lies on."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = np.full(n, salt + 1, dtype=np.uint64)
    for place, bit in enumerate(mask):
        if bit == "1":
            value = (value ^ tokens[place: place + n]) * _MIX
            value ^= value >> np.uint64(29)
    return value


def places(ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and first place of every window of ``span`` words that lies inside one text."""
    counts = np.maximum(0, np.diff(ends) - span + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    return text, ends[:-1][text] + np.arange(int(counts.sum())) - (np.cumsum(counts) - counts)[text]


def short_masks(size: int) -> list[str]:
    """Masks over a whole item of ``size`` words: every set of differences that SHARE allows is left out by one of them."""
    differ = size - -(-round(100 * SHARE) * size // 100)
    if not differ:
        return ["1" * size]
    # One difference lies in one of the parts, so leaving out each part in turn is enough.
    parts = next(p for p in range(2, size + 1) if size - -(-size // p) >= SHORT_WEIGHT)
    cuts = [size * p // parts for p in range(parts + 1)]
    return ["1" * low + "0" * (high - low) + "1" * (size - high) for low, high in zip(cuts, cuts[1:])]


class Index:
    """Seeds of a block of items, sorted by hash, and a table of bits that most other hashes fail."""

    def __init__(self, items: list[tuple[object, str]]):
        tokens, ends = Words().tokens([text for _, text in items])
        held: dict[bytes, dict] = {}
        for n, (item_id, _) in enumerate(items):
            own = tokens[ends[n]: ends[n + 1]]
            if len(own):
                held.setdefault(own.tobytes(), {})[item_id] = None
        #: Distinct items' words, and all ids of each.
        self.items = [np.frombuffer(words, dtype=np.uint64) for words in held]
        self.ids = [list(ids) for ids in held.values()]
        by_size: dict[int, list[int]] = {}
        for n, own in enumerate(self.items):
            by_size.setdefault(min(len(own), MIN_WORDS), []).append(n)
        #: (mask, salt, items)
        laid = [(m, n) for size, n in sorted(by_size.items()) for m in (MASKS if size == MIN_WORDS else short_masks(size))]
        self.masks = [(mask, salt, which) for salt, (mask, which) in enumerate(laid)]
        found, item, place = [], [], []
        for mask, salt, which in self.masks:
            for n in which:
                value = seeds(self.items[n], mask, salt)
                found.append(value)
                item.append(np.full(len(value), n))
                place.append(np.arange(len(value)))
        value = np.concatenate([np.zeros(0, dtype=np.uint64), *found])
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.item = np.concatenate([np.zeros(0, dtype=np.int64), *item])[order]
        self.place = np.concatenate([np.zeros(0, dtype=np.int64), *place])[order]
        self.bits = np.uint64(max(16, int(len(value) * 16).bit_length()))
        self.filter = np.zeros(1 << int(self.bits), dtype=bool)
        self.filter[self.value >> (np.uint64(64) - self.bits)] = True

    def shifts(self, tokens: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, place in the tokens where the item's first word would lie), each once, sorted."""
        out = set()
        for mask, salt, which in self.masks:
            if not which:
                continue
            value = seeds(tokens, mask, salt)
            maybe = np.flatnonzero(self.filter[value >> (np.uint64(64) - self.bits)])
            low = np.searchsorted(self.value, value[maybe], side="left")
            count = np.searchsorted(self.value, value[maybe], side="right") - low
            text = np.searchsorted(ends, maybe, side="right") - 1
            real = (count > 0) & (maybe + len(mask) <= ends[text + 1])
            maybe, low, count, text = maybe[real], low[real], count[real], text[real]
            entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            shift = np.repeat(maybe, count) - self.place[entry]
            out.update(zip(np.repeat(text, count).tolist(), self.item[entry].tolist(), shift.tolist()))
        return sorted(out)

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, first word, words, agreeing words, words of the text) of every stretch of the texts that matches."""
        if len(_words) > CACHE_PIECES:
            _words.clear()
        tokens, ends = _words.tokens(texts)
        for (text, n), shifts in groupby(self.shifts(tokens, ends), key=lambda hit: hit[:2]):
            own, first, end = self.items[n], int(ends[text]), int(ends[text + 1])
            every = []
            for _, _, shift in shifts:
                low, high = max(shift, first), min(shift + len(own), end)
                every += [(size, agree, low + start - first) for start, size, agree in stretches(tokens[low:high] == own[low - shift: high - shift], min(MIN_WORDS, len(own)))]
            for size, agree, start in apart(every):
                yield text, n, start, size, agree, end - first

    def matches(self, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
        """(text, item id, first word, words, agreeing words)."""
        return [(text, item_id, start, size, agree) for text, n, start, size, agree, _ in self.found(texts) for item_id in self.ids[n]]

    def contaminated(self, texts: list[str | None]) -> list[int]:
        """Texts that an item of SURE_WORDS or more, or one that is the whole text, rules out."""
        return sorted({text for text, n, _, size, _, words in self.found(texts) if len(self.items[n]) >= SURE_WORDS or size == words})


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """First place, length and agreeing places of the longest stretch that passes, and of those before and after it."""
    out, todo = [], [(0, len(same))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        start, size, agree = longest(same[low:high])
        if size >= least:
            out.append((low + start, size, agree))
            todo += [(low, low + start), (low + start + size, high)]
    return out


def apart(every: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(length, agreeing, first place), longest, then best agreeing, then earliest first, without those that overlap one before."""
    taken: list[tuple[int, int]] = []
    out = []
    for size, agree, start in sorted(set(every), key=lambda s: (-s[0], -s[1], s[2])):
        at = bisect_left(taken, (start, 0))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= start + size):
            taken.insert(at, (start, start + size))
            out.append((size, agree, start))
    return out


def longest(same: np.ndarray) -> tuple[int, int, int]:
    """First place, length and agreeing places of the longest stretch of which at least SHARE agree."""
    hundredths = round(100 * SHARE)
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - hundredths, -hundredths))])
    lowest = np.minimum.accumulate(total)
    # The first place whose total is no greater than the one at each end: lowest falls, so search it backwards.
    first = np.searchsorted(-lowest, -total, side="left")
    size = np.arange(len(total)) - first
    end = int(size.argmax())
    return int(first[end]), int(size[end]), int(same[first[end]: end].sum())


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items in blocks of about BLOCK_BYTES of text; items with the same letters and digits share a block."""
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    number = total // BLOCK_BYTES + 1
    bare = F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}]+", "")
    for block in range(number):
        part = items if number == 1 else items.filter(F.pmod(F.xxhash64(bare), F.lit(number)) == block)
        rows = [(r["i"], r["t"]) for r in part.collect()]
        yield sorted(rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for every document, item and stretch that match: ids, first word, words and agreeing words.

    Of a benchmark of several blocks each one's rows are stored before the next is indexed, so that one index lives at a time.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, start long, n_words long, n_agree long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts, shared = [], None
    for items in blocks(benchmark, item_col, item_text_col):
        if shared is not None:
            parts[-1] = store(parts[-1])[0]
            shared.destroy()
        shared = spark.sparkContext.broadcast(Index(items))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keeping(__name__, _words.clear)
            for whole in batches:
                for batch in slices(whole, "text", SLICE_BYTES):
                    found = shared.value.matches(batch.column("text").to_pylist())
                    if found:
                        row, item, *numbers = (list(c) for c in zip(*found))
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(item, item_type), *(pa.array(n, pa.int64()) for n in numbers)],
                                                         names=[id_col, item_col, "start", "n_words", "n_agree"])

        parts.append(rows.mapInArrow(find, schema))
    return reduce(DataFrame.union, parts)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that match an item, see the module about short ones."""
    spark = docs.sparkSession
    for items in blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(Index(items))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keeping(__name__, _words.clear)
            for whole in batches:
                for batch in slices(whole, text_col, SLICE_BYTES):
                    stay = np.ones(batch.num_rows, dtype=bool)
                    stay[shared.value.contaminated(batch.column(text_col).to_pylist())] = False
                    yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
