"""Ranked lexical search by range-maximum tables over posting lists.

Every task cuts its documents into shards and builds, for the terms of the queries, posting lists (documents of the
shard, ascending) with the score each term gives each document. A sparse table over a list answers where its greatest
score within any range of documents lies. A query's search goes over intervals of documents: the sum of its terms'
greatest scores in an interval bounds every document there. Best intervals come first; each is split at the document
that holds its greatest single score, that document is scored in full, and what lies left and right of it becomes two
intervals with bounds of their own. An interval whose bound is below the query's k-th score so far is dropped, so the
result is exact. The k best are carried from shard to shard of a task, and tasks' results meet in two steps of top k.

The searches of a shard run at once, in arrays: a round takes the better half of each query's open intervals.

Counts over all documents (documents and terms, and each query term's documents) come from a pass before. Queries are
worked on in blocks of a bounded size of text, so that what is broadcast doesn't grow with them; each block takes a pass.

Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z become lower case.

Result by case: null and empty texts and texts without terms are no documents; a query without terms, or whose terms no
document has, gets no rows, and so do all if there are no documents; equal scores go by id, null ids last; equal rows
are documents of their own; items with equal ids or texts are queries of their own; very long texts are read in pieces;
ids are integers (others raise a TypeError).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from docweave.operators.keyed import top_k_by

from .common import slices, table, word_chunks
from .decontaminate import blocks

TOP = 50
#: Bytes of text of a shard, queries that are searched at once, and intervals of a query in a round at least.
SHARD_BYTES, QUERIES_AT_ONCE, LEAST_INTERVALS = 16 << 20, 256, 16
#: Groups in which tasks' results meet first.
LANES = 64
#: Posting numbers of a shard take so many bits below a score.
POSTING_BITS = np.int64(27)
NULL_ID = 2**63 - 1

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The text's terms, a piece of it at a time."""
    for piece in word_chunks((text or b"").translate(_FOLD), 4 << 20):
        yield piece.split()


class Queries:
    """A block of queries: the numbers of their terms, and each query's terms, once each."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        self.terms = []
        for _, text in items:
            own = {self.numbers.setdefault(t, len(self.numbers)) for part in terms(text.encode()) for t in part}
            self.terms.append(np.array(sorted(own), dtype=np.int64))

    def postings(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of every text, and (term, text, occurrences) of the queries' terms, by term and text."""
        lengths, found, whose = np.zeros(len(texts), dtype=np.int64), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, text in enumerate(texts):
            for part in terms(text):
                lengths[i] += len(part)
                own = np.fromiter(map(self.numbers.get, part, repeat(-1)), dtype=np.int64, count=len(part))
                own = own[own >= 0]
                found.append(own)
                whose.append(np.full(len(own), i))
        n = max(1, len(texts))
        key, count = np.unique(np.concatenate(found) * n + np.concatenate(whose), return_counts=True)
        return lengths, key // n, key % n, count


class Shard:
    """Posting lists of a run of documents, one after another by term, and their sparse table."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray, docs: int):
        self.docs, self.doc, self.score, self.key = docs, doc, score, term * docs + doc
        sizes = np.bincount(term) if len(term) else np.zeros(0, dtype=np.int64)
        #: table[j][p]: the posting with the greatest score among the 2**j from p on.
        self.table = [np.arange(len(term), dtype=np.int32)]
        for j in range(int(sizes.max(initial=1)).bit_length() - 1):
            a, b = self.table[-1][: -(1 << j)], self.table[-1][1 << j:]
            self.table.append(np.where(score[b] > score[a], b, a))

    def place(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first posting of ``term`` at or after ``doc``."""
        return np.searchsorted(self.key, term * self.docs + doc)

    def greatest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The posting with the greatest score in every range [low, high), none of them empty."""
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for j in np.unique(level).tolist():
            at = np.flatnonzero(level == j)
            a, b = self.table[j][low[at]], self.table[j][high[at] - (1 << j)]
            out[at] = np.where(self.score[b] > self.score[a], b, a)
        return out


class Best:
    """The ``top`` documents with the greatest scores of every query so far, equal scores by id."""

    def __init__(self, queries: int, top: int):
        self.top, self.floor = top, np.ones(queries, dtype=np.int64)
        self.query, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        stay = score >= self.floor[query]
        query, score, own = (np.concatenate(c) for c in zip((self.query, self.score, self.id), (query[stay], score[stay], own[stay])))
        order = np.lexsort((own, -score, query))
        query, score, own = query[order], score[order], own[order]
        rank = ranks(query)
        last = rank == self.top - 1
        self.floor[query[last]] = score[last]
        stay = rank < self.top
        self.query, self.score, self.id = query[stay], score[stay], own[stay]


def ranks(sorted_keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    n = len(sorted_keys)
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if n else np.zeros(0, dtype=bool)
    return np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, dtype=np.int64)


class Frontier:
    """Open intervals of documents with, for every query term that occurs there, its range of postings.

    ``query``, ``bound`` and ``split`` (a document) are an interval's; ``term``, ``low`` and ``high`` belong to its
    ranges, which stand together in the order of the intervals, ``size`` of them each.
    """

    FIELDS = ("query", "bound", "split", "size"), ("term", "low", "high")

    def __init__(self, *fields: np.ndarray):
        self.query, self.bound, self.split, self.size, self.term, self.low, self.high = fields

    @classmethod
    def of(cls, shard: Shard, owner: np.ndarray, query: np.ndarray, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> Frontier:
        """Intervals of ranges: ``owner`` ascends and tells intervals apart; empty ranges are left out."""
        real = low < high
        owner, query, term, low, high = owner[real], query[real], term[real], low[real], high[real]
        if not len(owner):
            return cls(*(owner for _ in range(7)))
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        top = shard.greatest(low, high)
        score = shard.score[top]
        best = np.maximum.reduceat((score << POSTING_BITS) | top, first) & ((np.int64(1) << POSTING_BITS) - 1)
        return cls(query[first], np.add.reduceat(score, first), shard.doc[best], np.diff(np.append(first, len(owner))), term, low, high)

    def keep(self, stay: np.ndarray) -> Frontier:
        ranges = np.repeat(stay, self.size)
        return Frontier(self.query[stay], self.bound[stay], self.split[stay], self.size[stay], self.term[ranges], self.low[ranges], self.high[ranges])

    def __add__(self, other: Frontier) -> Frontier:
        return Frontier(*(np.concatenate([getattr(self, f), getattr(other, f)]) for part in self.FIELDS for f in part))


def search(shard: Shard, ids: np.ndarray, terms_of: list[np.ndarray], best: Best, first_query: int = 0) -> None:
    """Brings ``best`` up to date with the shard's documents for the queries that have the terms ``terms_of``."""
    query = first_query + np.repeat(np.arange(len(terms_of)), [len(t) for t in terms_of])
    term = np.concatenate([np.zeros(0, dtype=np.int64), *terms_of])
    everywhere = np.zeros(len(term), dtype=np.int64)
    live = Frontier.of(shard, query, query, term, shard.place(term, everywhere), shard.place(term + 1, everywhere))
    while len(live.query):
        order = np.lexsort((-live.bound, live.query))
        number = np.bincount(live.query)[live.query]
        chosen = np.zeros(len(order), dtype=bool)
        chosen[order] = ranks(live.query[order]) < np.maximum(LEAST_INTERVALS, number[order] // 2)
        now, rest = live.keep(chosen), live.keep(~chosen)
        owner = np.repeat(np.arange(len(now.query)), now.size)
        split, whose = np.repeat(now.split, now.size), np.repeat(now.query, now.size)
        middle = shard.place(now.term, split)
        hit = (middle < now.high) & (shard.doc[np.minimum(middle, len(shard.doc) - 1)] == split)
        score = np.add.reduceat(np.where(hit, shard.score[np.minimum(middle, len(shard.doc) - 1)], 0), np.cumsum(now.size) - now.size)
        best.add(now.query, score, ids[now.split])
        left = Frontier.of(shard, owner, whose, now.term, now.low, middle)
        right = Frontier.of(shard, owner, whose, now.term, middle + hit, now.high)
        live = rest + left + right
        # An equal bound may still hide an equal score of a smaller id.
        live = live.keep(live.bound >= best.floor[live.query])


def statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and the documents of each query term; tasks send sums only."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.numbers) + 2, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                lengths, term, _, _ = shared.value.postings(batch.column("text").to_pylist())
                total[:-2] += np.bincount(term, minlength=len(total) - 2)
                total[-2:] += [np.count_nonzero(lengths), lengths.sum()]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(queries.numbers) + 2, dtype=np.int64)
    total[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return int(total[-2]), int(total[-1]), total[:-2]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    """Ids and texts of a task's documents, about SHARD_BYTES of text at a time, by id."""
    held, size = [], 0

    def shard() -> tuple[np.ndarray, list[bytes | None]]:
        rows = pa.Table.from_batches(held).sort_by("id")
        return rows.column("id").to_numpy(), rows.column("text").to_pylist()

    for whole in batches:
        for batch in slices(whole, "text", SHARD_BYTES):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= SHARD_BYTES:
                yield shard()
                held, size = [], 0
    if held:
        yield shard()


def best_documents(docs: DataFrame, queries: Queries, top: int) -> DataFrame:
    """``query, id, score``: at most ``top`` rows of each task for each query, the best among them."""
    total, words, seen = statistics(docs, queries)
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) if n else 0 for n in seen.tolist()], dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        best = Best(len(queries.items), top)
        for ids, texts in shards(batches):
            lengths, term, doc, often = queries.postings(texts)
            longer = np.array([50 + 50 * n * total // words for n in lengths.tolist()], dtype=np.int64)
            score = weight[term] * (1_000_000_000 * often // (1000 * often + 20 * longer[doc]))
            some = score > 0
            shard = Shard(term[some], doc[some], score[some], len(texts))
            for first in range(0, len(queries.items), QUERIES_AT_ONCE):
                search(shard, ids, queries.terms[first: first + QUERIES_AT_ONCE], best, first)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.id), pa.array(best.score)], names=["query", "id", "score"])

    return docs.mapInArrow(run, "query long, id long, score long")


def ranked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """Item id, rank from 1, document id and score of every item's best documents."""
    spark, kind, item_kind = docs.sparkSession, docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = spark.createDataFrame([], f"`{item_col}` {item_kind.simpleString()}, rank int, `{id_col}` {kind.simpleString()}, score long")
    for items in blocks(benchmark, item_col, item_text_col):
        queries = Queries(items)
        if not queries.numbers:
            continue
        found = best_documents(rows, queries, top).withColumn("lane", F.spark_partition_id() % LANES)
        order = [F.desc("score"), F.asc("id")]
        fewer = top_k_by(found, ["query", "lane"], order, top, "place").drop("place")
        placed = top_k_by(fewer, ["query"], order, top)
        names = spark.createDataFrame(list(enumerate(queries.items)), f"query long, item {item_kind.simpleString()}")
        named = placed.join(F.broadcast(names), "query")  # a block's items
        out = out.union(named.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NULL_ID, F.col("id")).cast(kind).alias(id_col), "score"))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every document of every term of every item is scored.
ORACLE = f"""
with docs as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents where text is not null),
counted as (select doc_id, w, cast(len(w) as bigint) as n from docs where len(w) > 0),
whole as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from counted),
items as (select item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) as t from benchmark where text is not null),
postings as (select doc_id, n, t, cast(count(*) as bigint) as tf from (select doc_id, n, unnest(w) as t from counted) semi join items using (t) group by doc_id, n, t),
weights as (select t, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from postings, whole group by t),
scores as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) as bigint) as score
  from items join postings using (t) join weights using (t), whole group by item_id, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= {TOP}
"""

QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLES = {"op12_ranked_search": ORACLE}
