"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

A tile holds the fingerprints with the same population counts in the four 16-bit parts of the word. Two fingerprints
whose population counts differ, part by part, by more than ``radius`` in sum cannot lie within ``radius`` bits, so such
tile pairs are skipped; the remaining pairs are compared in full with exclusive-or and bit counts. Only distinct
fingerprints are compared. Large tiles are cut into blocks, and one group of a task holds one block and what has to be
compared with it; the task reduces the links it finds to a forest, which keeps every component. Components are joined on
stored tables.

Comparison work grows with the square of the distinct fingerprints, over the number of tiles (about 1.6 % of all pairs
of evenly spread fingerprints are compared).

Result by case: a text without words (null, empty, white space) has fingerprint zero and is linked like any other; one
or two words are one shingle; repeated rows are one component; a null id takes part, and a component's id is the
smallest id in it that is not null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docweave.operators.keyed import attach

from .common import fresh, slices, store, table
from .components import components

WORDS, SEED, RADIUS, PARTS, PART_BITS = 3, 42, 2, 4, 16
#: Fingerprints of a block; a group of a task holds a block and one block's worth for each tile pair at most.
BLOCK_ROWS = 8192
#: Rows of the left side that are compared at once.
STRIP = 256
LANE_MOST = 65_535


def fingerprint_texts(texts: list[bytes]) -> np.ndarray:
    """SimHash of the word shingles of each text, A-Z in lower case."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes, counts = [], []
    for text in texts:
        words = text.lower().split()
        n = max(1, len(words) - WORDS + 1) if words else 0
        counts.append(n)
        if n == 1:
            hashes.append(np.array([digest(b" ".join(words), SEED)], dtype=np.uint64))
        elif n:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = np.concatenate([[0], ends[:n - 1]]).tolist()
            stops = (ends[WORDS - 1:] - 1).tolist()
            hashes.append(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=n))
    return majority(np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.array(counts, dtype=np.int64))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of ``counts`` hashes the word of the bits that more than half of them have.

    Votes are added for four bits at a time, in 16-bit lanes of the word; longer runs are cut so that no lane runs over.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full) == 0:
        return out
    pieces = -(-counts[full] // LANE_MOST)
    run = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(run)) - (np.cumsum(pieces) - pieces)[run]
    starts = (np.cumsum(counts) - counts)[full][run] + nth * LANE_MOST
    votes = np.zeros((len(full), 64), dtype=np.int64)
    lanes = np.uint64(0x0001000100010001)
    for bit in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, starts)
        for lane in range(4):
            np.add.at(votes[:, bit + 16 * lane], run, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
    bits = (2 * votes > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed 64-bit integer."""
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema
    source = docs.select("*", F.col(text_col).cast("binary").alias(name))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, name):
                prints = fingerprint_texts([t or b"" for t in batch.column(name).to_pylist()]).view(np.int64)
                yield batch.set_column(batch.num_columns - 1, name, pa.array(prints))

    return source.mapInArrow(add, schema)


def neighbour_shifts(radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Differences of part counts that two fingerprints within ``radius`` bits can have, from the smaller tile on."""
    every = product(range(-radius, radius + 1), repeat=PARTS)
    return [s for s in every if sum(map(abs, s)) <= radius and s > (0,) * PARTS]


class Tile:
    """One block of fingerprints and the forest of links found so far, its own or through what was compared with it."""

    def __init__(self, home: np.ndarray, radius: int):
        self.home, self.radius, self.up = home, radius, list(range(len(home)))

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def links(self, others: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Compares all of ``others`` with the block, or the block with itself; links that join something new.

        A root is always the smallest row number, so that rows of the block never hang on a row of ``others``, and
        these can be forgotten afterwards.
        """
        n, found = len(self.home), []
        rows = self.home if others is None else others
        if others is not None:
            self.up += range(n, n + len(others))
        words = self.home.view(np.uint64)
        for start in range(0, len(rows), STRIP):
            strip = rows[start: start + STRIP].view(np.uint64)
            near = np.bitwise_count(strip[:, None] ^ words[None, :]) <= self.radius
            for x, y in zip(*(a.tolist() for a in np.nonzero(near))):
                if others is None and x + start <= y:
                    continue
                a, b = self._root(x + start + (0 if others is None else n)), self._root(y)
                if a != b:
                    self.up[max(a, b)] = min(a, b)
                    found.append((int(rows[x + start]), int(self.home[y])))
        del self.up[n:]
        return found


def near_links(prints: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: links among the distinct values of ``prints(fp)`` that join what lies within ``radius`` bits."""
    mask = (1 << PART_BITS) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", PART_BITS * i).bitwiseAND(F.lit(mask).cast("long"))) for i in range(PARTS)]
    tiles = prints.select("fp", F.array(*counts).alias("tile"))
    blocks = tiles.groupBy("tile").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    # A tile is one of at most 17^4 values, so this table stays small whatever the input.
    placed = tiles.join(blocks, "tile").select("fp", "tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), "blocks")
    home = placed.select("tile", "block", "fp", F.lit(True).alias("home"))
    # Inside a tile a block's rows go to the later blocks; between tiles to every block of the larger tile.
    inside = placed.filter("block + 1 < blocks").select("tile", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), "fp", F.lit(False).alias("home"))
    shifts = F.array(*[F.array(*[F.lit(x) for x in s]) for s in neighbour_shifts(radius)])
    moved = placed.select("fp", F.explode(F.transform(shifts, lambda s: F.zip_with("tile", s, lambda x, y: (x + y).cast("int")))).alias("tile"))
    across = moved.join(blocks, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "fp", F.lit(False).alias("home"))
    groups = home.union(inside).union(across).withColumn("tile", F.xxhash64("tile"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come one after another, each with its own rows first; the rest is streamed past it."""
        key, own, tile = None, [], None

        def rows(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def closed() -> Tile:
            return Tile(np.concatenate([np.zeros(0, dtype=np.int64), *own]), radius)

        for batch in batches:
            tiles, numbers = batch.column("tile").to_numpy(), batch.column("block").to_numpy()
            fps, home = batch.column("fp").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(numbers) != 0) | (np.diff(home.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)]):
                if a == b:
                    continue
                if key != (tiles[a], numbers[a]):
                    if key is not None and tile is None:
                        yield from rows(closed().links())
                    key, own, tile = (tiles[a], numbers[a]), [], None
                if home[a]:
                    own.append(fps[a:b])
                    continue
                if tile is None:
                    tile = closed()
                    yield from rows(tile.links())
                yield from rows(tile.links(fps[a:b]))
        if key is not None and tile is None:
            yield from rows(closed().links())

    dealt = groups.repartition("tile", "block").sortWithinPartitions("tile", "block", F.desc("home"))
    return dealt.mapInArrow(compare, "a long, b long")


def simhash_components(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``fp, root, component_id`` for every fingerprint of ``prints(id_col, fp)``."""
    ids, _ = store(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    rooted, _ = store(components(near_links(ids.select("fp"), radius)))
    # A node without links has no row; it is its own root.
    named = ids.join(rooted, ids["fp"] == rooted["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(smallest, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, fingerprint (hexadecimal) and component id of every row."""
    prints, _ = store(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "fp", "text").select("id", "fp"))
    groups = simhash_components(prints, "id").select("fp", "component_id")
    joined = attach(prints, groups, ["fp"])
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row for each component: the first by id (null last), then by its text's hash."""
    fp, row = fresh(docs, "_fp", "_row")
    printed, _ = store(with_fingerprint(docs, fp, text_col).withColumn(row, F.monotonically_increasing_id()))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col(row).alias("row"))
    firsts = printed.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first"))
    groups = simhash_components(printed.select(F.col(id_col).alias("id"), F.col(fp).alias("fp")), "id")
    best = groups.join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return printed.join(best.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_groups": op8_simhash_groups}
