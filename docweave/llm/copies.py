"""Near copies: texts whose sets of five-word runs have a Jaccard similarity of at least 0.8, joined into components.

All sets are sorted by one order of the runs, the rarer bucket of runs first; two sets that similar share a run among
the first ``n - ceil(0.8 n) + 1`` of each, n being the runs of a set. Texts that share such a run are candidates, and a
candidate pair is a link only if the whole sets say so. First neighbours by size among the texts that share a run meet;
while runs still hold many pairs of texts of different components, one text of each run, another in every round, meets
those of it that are in other components. Then all pairs of a run whose texts are in different components meet, but for
those that their sizes, or the runs left behind the shared one, keep from being similar. So the components are exactly
those of all similar pairs; only pairs inside a component are left out. Where many texts share rare runs and none is
similar, that last step is quadratic in them by its nature; it holds one run's block at a time.

Texts with the same words are one node, known by a 64-bit hash; runs are known by 64-bit hashes too.

Result by case: words are what white space separates, A-Z in lower case; a text of one to four words is one run; texts
without words (null, empty, white space) are copies of each other; repeated rows are copies; null ids come last; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docweave.operators.keyed import attach

from .common import forget, fresh, keeping, slices, store, sweep
from .components import components
from .decontaminate import seeds

WORDS = 5
#: Rounds at most, before all pairs, in which one text of each run meets the others, while a row of a run has more than
#: CROWD partners in other components on average.
ROUNDS, CROWD = 4, 16
#: Rows of a run that one group of a task pairs with the whole run.
BLOCK_ROWS = 4096
#: Runs are counted in so many buckets, of which the order is made; nodes are looked up in so many.
BUCKET_BITS, NODE_BITS = 18, 22
CACHE_WORDS = 100_000
#: Bytes of text that are hashed at once.
SLICE_BYTES = 2 << 20


class WordHashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def word_hashes(text: bytes | None) -> np.ndarray:
    if len(_words) > CACHE_WORDS:
        _words.clear()
    words = (text or b"").lower().split()
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def runs(words: np.ndarray) -> np.ndarray:
    """The distinct hashes of the runs of a text's words, ascending."""
    return np.unique(seeds(words, "1" * min(WORDS, len(words)), WORDS - min(WORDS, len(words)))) if len(words) else words


def node(words: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(words.tobytes())


def with_node(docs: DataFrame, name: str, text_col: str) -> DataFrame:
    """All columns of ``docs`` and the hash of the text's words as a signed 64-bit integer."""
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema
    source = docs.select("*", F.col(text_col).cast("binary").alias(name))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeping(__name__, _words.clear)
        for whole in batches:
            for batch in slices(whole, name):
                nodes = np.array([node(word_hashes(t)) for t in batch.column(name).to_pylist()], dtype=np.uint64)
                yield batch.set_column(batch.num_columns - 1, name, pa.array(nodes.view(np.int64)))

    return source.mapInArrow(add, schema)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many runs of all ``texts(node, text)`` fall into each bucket; a task gives one row for a bucket."""
    shift = np.uint64(64 - BUCKET_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found = [runs(word_hashes(t)) >> shift for t in batch.column("text").to_pylist()]
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def prefixes(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """``run, n, at, node``: the first runs of each text of ``texts(node, text)``, how many it has and the run's place in the order."""
    shared, shift = texts.sparkSession.sparkContext.broadcast(counts), np.uint64(64 - BUCKET_BITS)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                found, sizes, lengths, places, nodes = [], [], [], [], []
                for key, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                    if key in seen:
                        continue
                    seen.add(key)
                    own = runs(word_hashes(text))
                    n = len(own)
                    own = own[np.argsort(shared.value[(own >> shift).astype(np.int64)], kind="stable")[: n - (4 * n + 4) // 5 + 1]]
                    found.append(own)
                    sizes.append(n)
                    lengths.append(len(own))
                    places.append(np.arange(len(own), dtype=np.int32))
                    nodes.append(key)
                if found:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(found).view(np.int64)),
                        pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths)),
                        pa.array(np.concatenate(places)),
                        pa.array(np.repeat(np.array(nodes, dtype=np.int64), lengths))], names=["run", "n", "at", "node"])

    return texts.mapInArrow(first, "run long, n int, at int, node long")


def shared_runs(firsts: DataFrame) -> DataFrame:
    """``run, n, at, node, before``: the rows of runs that several nodes have, each once; ``before`` is the node in front of
    it by size, if it is large enough."""

    def rows(found: list[np.ndarray], stay: np.ndarray, before: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
        run, n, key, at = (c[stay] for c in found)
        return pa.RecordBatch.from_arrays([pa.array(run), pa.array(n), pa.array(at), pa.array(key), pa.array(before[stay], mask=~near[stay])], names=["run", "n", "at", "node", "before"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by run, size and node. The last row of a batch waits for the next one, and keeps what it knows."""
        last, last_near, last_before, last_same = None, False, 0, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            found = [batch.column(c).to_numpy() for c in ("run", "n", "node", "at")]
            if last is not None:
                found = [np.concatenate([x, y]) for x, y in zip(last, found)]
            run, n, key, _ = found
            new = np.concatenate([[True], (run[1:] != run[:-1]) | (key[1:] != key[:-1])])
            run, n, key, _ = found = [c[new] for c in found]
            same = np.concatenate([[last_same], run[1:] == run[:-1]])
            before = np.concatenate([[last_before], key[:-1]])
            near = np.concatenate([[last_near], same[1:] & (5 * n[:-1].astype(np.int64) >= 4 * n[1:].astype(np.int64))])
            stay = same[:-1] | same[1:]
            yield rows([c[:-1] for c in found], stay, before[:-1], near[:-1])
            last, last_near, last_before, last_same = [c[-1:] for c in found], bool(near[-1]), int(before[-1]), bool(same[-1])
        if last is not None:
            yield rows(last, np.array([last_same]), np.array([last_before], dtype=np.int64), np.array([last_near]))

    dealt = firsts.repartition("run").sortWithinPartitions("run", "n", "node")
    return dealt.mapInArrow(pick, "run long, n int, at int, node long, before long")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose whole sets of runs are similar enough."""
    slot = F.explode(F.array("a", "b")).alias("node")
    slots = pairs.select(slot).select(F.col("node").bitwiseAND(F.lit((1 << NODE_BITS) - 1).cast("long")).alias("slot")).distinct()
    # Most texts are in no pair; they are left out before anything is sent.
    wanted = np.zeros(1 << NODE_BITS, dtype=bool)
    wanted[slots.toArrow().column("slot").to_numpy()] = True
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keep = shared.value[batch.column("node").to_numpy() & ((1 << NODE_BITS) - 1)]
            for i in np.flatnonzero(keep).tolist():
                key = batch.column("node")[i].as_py()
                keep[i] = key not in seen
                seen.add(key)
            yield batch.filter(pa.array(keep))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "x", SLICE_BYTES):
                stay = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    x, y = runs(word_hashes(x.as_py())), runs(word_hashes(y.as_py()))
                    stay.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
                yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    # Equal texts of several tasks become one row.
    known, _ = store(texts.mapInArrow(named, texts.schema).dropDuplicates(["node"]))
    left = pairs.join(known.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(known.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def apart(postings: DataFrame, links: DataFrame) -> tuple[DataFrame, str]:
    """The stored rows of ``postings`` whose run has texts of several components, with the component (``root``), the run's
    ``rows`` and how many ordered pairs of them are of different components (``cross``)."""
    spark = postings.sparkSession
    rooted, rooted_path = store(components(links))
    rows, rows_path = store(attach(postings.select("run", "n", "at", "node"), rooted, ["node"]).withColumn("root", F.coalesce("root", "node")))
    each = rows.groupBy("run", "root").agg(F.count("*").alias("n"))
    total = F.sum("n")
    runs_apart = each.groupBy("run").agg(total.alias("rows"), (total * total - F.sum(F.col("n") * F.col("n"))).alias("cross")).filter("cross > 0")
    out, out_path = store(attach(rows, runs_apart, ["run"], "inner"))
    forget(spark, rooted_path, rows_path)
    return out, out_path


def pivot_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """``a, b``: the ``turn``-th chosen text of each run, by hash, with those of it that are in other components and near in size."""
    middle = rows.groupBy("run").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "n", "node", "root")).alias("m"))
    others = attach(rows, middle, ["run"], "inner").filter(F.col("root") != F.col("m.root"))
    near = 5 * F.least("n", "m.n") >= 4 * F.greatest("n", "m.n")
    return others.filter(near).select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct()


def all_pairs(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: every pair of texts that share a run, are in different components and can be similar by their sizes and the run's places.

    From the first run that two texts share, no more are left than behind it in either. Runs of many rows are cut into
    blocks, each of which meets the whole run.
    """
    cut = rows.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
    names = ("n", "at", "node", "root")
    x = cut.select("run", *names, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    y = cut.select("run", *[F.col(c).alias(f"{c}2") for c in names], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    once = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("node") < F.col("node2")))
    behind = 9 * F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= 4 * (F.col("n") + F.col("n2"))
    able = once & (F.col("root") != F.col("root2")) & (5 * F.col("n") >= 4 * F.col("n2")) & behind
    return x.join(y, ["run", "block"]).filter(able).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def copy_links(texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``a, b``: links among the nodes of ``texts(node, text)`` whose components are those of all similar pairs."""
    spark = texts.sparkSession
    postings, postings_path = store(shared_runs(prefixes(texts, bucket_counts(texts))))
    near = postings.filter("before is not null")
    tried, _ = store(near.select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")).distinct())
    links, _ = store(similar(tried, texts))
    sweep(spark)
    for turn in range(rounds + 1):
        rows, rows_path = apart(postings, links)
        pairs, count = rows.agg(F.sum(F.col("cross") / F.col("rows")), F.count("*")).first()
        last = turn == rounds or (pairs or 0) <= CROWD * count
        untried, untried_path = store((all_pairs(rows) if last else pivot_pairs(rows, turn)).join(tried, ["a", "b"], "left_anti"))
        forget(spark, rows_path)
        if not untried.isEmpty():
            found, _ = store(similar(untried, texts))
            links, tried = links.union(found), tried.union(untried)
        sweep(spark)
        if last:
            break
    forget(spark, postings_path)
    return links


def keep_first_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row for each component: the first by id (null last), then by its text's hash."""
    key, row = fresh(docs, "_node", "_row")
    marked, _ = store(with_node(docs, key, text_col).withColumn(row, F.monotonically_increasing_id()))
    texts = marked.select(F.col(key).alias("node"), F.col(text_col).cast("binary").alias("text"))
    rooted = components(copy_links(texts))
    rooted = rooted.select(F.col("node").alias("other"), "root")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col(row).alias("row"))
    firsts = marked.groupBy(F.col(key).alias("node")).agg(F.min(order).alias("first"))
    best = firsts.join(rooted, F.col("node") == F.col("other"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    return marked.join(best.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)
