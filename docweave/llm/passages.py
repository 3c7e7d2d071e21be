"""Removal of repeated passages of words by seed and extend.

Every window of WINDOW words has one seed in it, the SEED_WORDS words whose hash is the least (winnowing), so equal
windows have equal seeds at equal places. A seed with all windows that chose it is an occurrence; documents are joined
on the seeds of their occurrences:

1. Occurrences whose words are all the same: the earliest stays, the others are repeats as a whole. A task reduces its
   own first, so a shuffle gets a row per task and text, however many copies there are.
2. Different occurrences of a seed meet the earliest of them and are extended to both sides of the seed, word by word;
   what agrees over WINDOW words or more is a repeat. The parts of an occurrence that the earliest does not cover go on
   under longer seeds: a window that starts ``o`` words before its seed holds ``o`` words to its left and the rest to
   its right, so the windows are halved by ``o``, and the seed of a half grows by the words that all its windows hold.
   The earliest of each longer seed is met in turn. After five rounds a seed is a whole window, so no match is lost,
   and no occurrence meets more than one other in a group: no group's pairs are compared.
3. Repeated windows are joined to maximal ranges of words and cut out of their texts.

Hot seeds: the rounds aggregate (tasks reduce their rows first) and join on a key that run-time re-planning can split.
In step 1 seeds that a bounded sample shows in many documents are dealt by their words as well; their occurrences all go
on to step 2, so the sample decides where rows go, never what comes out.

Words are told apart by 64-bit hashes, occurrences by 128 bits.

Result by case: null and empty texts have no words and keep nothing (the digest of the empty string); texts of fewer
than WINDOW words keep all; null ids count as smaller than all others; rows with equal ids are ordered by the hash of
their text, and equal rows with equal ids are one text; very long texts are read in pieces that overlap by the words of
a window but one, which changes nothing; ids are integers (others raise a TypeError); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from docweave.operators.keyed import attach

from .common import forget, slices, store, table, word_chunks
from .copies import WordHashes
from .decontaminate import seeds
from .windows import sliding_least

WINDOW, SEED_WORDS = 20, 6
#: Places of a seed in a window; a window's seed has at most SIDE words of the window on either side.
CHOICE = WINDOW - SEED_WORDS + 1
SIDE = CHOICE - 1
#: Words of an occurrence with its seed in the middle; places without a word are 0.
WIDTH = WINDOW + SIDE
#: Bytes of text that are hashed at once, and words in a worker's table of hashes.
HASH_BYTES, CACHE_WORDS = 4 << 20, 500_000
#: A place in the corpus below the id: the text's hash, the first window's first word, further windows of the run.
TAG_BITS, START_BITS, MORE_BITS = 25, 31, 7
NO_ID = -(2**63)
#: Documents in the sample that shows hot seeds, the share of them that makes a seed hot, and the most of such seeds.
SAMPLE_ROWS, HOT_SHARE, HOT_MOST = 4000, 0.005, 4096
#: Bits of a ranked seed that hold its place.
PLACE_BITS = np.uint64(31)

_BASE = 0x9E3779B97F4A7C15
_words = WordHashes()


def packed_at(tag: np.ndarray, first: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (tag << (START_BITS + MORE_BITS)) | (first << MORE_BITS) | more


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tag, first window and last window."""
    first = (at >> MORE_BITS) & ((1 << START_BITS) - 1)
    return at >> (START_BITS + MORE_BITS), first, first + (at & ((1 << MORE_BITS) - 1))


def _batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def word_blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in blocks, where blocks begin in them, and each block's text and first word's number.

    A window lies in one block: a block begins with the last words of the one before.
    """
    if len(_words) > CACHE_WORDS:
        _words.clear()
    found, row, base = [], [], []
    for i, text in enumerate(texts):
        done, held = 0, np.zeros(0, dtype=np.uint64)
        for piece in word_chunks(text) if len(text) > HASH_BYTES else [text]:
            words = piece.split()
            own = np.concatenate([held, np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))])
            found.append(own | np.uint64(1))
            row.append(i)
            base.append(done - len(held))
            done += len(words)
            held = own[len(own) - min(len(own), WINDOW - 1):]
    ends = np.cumsum([0, *map(len, found)])
    return np.concatenate([np.zeros(0, dtype=np.uint64), *found]), ends, np.array(row, dtype=np.int64), np.array(base, dtype=np.int64)


def occurrences(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, seed hash, seed's place, first and last window, hash of all words) of the blocks' occurrences, by place."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none
    value = seeds(words, "1" * SEED_WORDS, 0)
    ranked = (value >> PLACE_BITS << PLACE_BITS) | np.arange(len(value), dtype=np.uint64)
    place = (sliding_least(ranked, CHOICE)[:n] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    block = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:n]
    new = np.ones(n, dtype=bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(block) != 0)
    first = np.flatnonzero(new)
    last = np.minimum(np.concatenate([first[1:], [n]]) - 1, ends[block[first] + 1] - WINDOW)
    real = last >= first  # a window may not reach into the next block
    first, last = first[real], last[real]
    # Polynomial hash of any range of words from running sums.
    power = np.cumprod(np.full(len(words), _BASE, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * power)])
    back = np.cumprod(np.full(len(words), pow(_BASE, -1, 2**64), dtype=np.uint64))
    whole = (total[last + WINDOW] - total[first]) * back[first]
    return block[first], value[place[first]].view(np.int64), place[first], first, last, whole.view(np.int64)


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, whole, id, at) of the earliest of a batch's equal occurrences; the others come with ``h`` 0, they are repeats."""
    for whole_batch in batches:
        for batch in slices(whole_batch, "raw", HASH_BYTES):
            words, ends, row, base = word_blocks(batch.column("raw").to_pylist())
            block, h, _, first, last, whole = occurrences(words, ends)
            if not len(h):
                continue
            h, row, shift = h | 1, row[block], base[block] - ends[block]
            own, first, last = batch.column("id").to_numpy()[row], first + shift, last + shift
            at = packed_at(batch.column("tag").to_numpy()[row], first, last - first)
            order = np.lexsort((at, own, whole, h))
            same = np.concatenate([[False], (np.diff(h[order]) == 0) & (np.diff(whole[order]) == 0)])
            leader = order[np.flatnonzero(~same)[np.cumsum(~same) - 1]]
            # An equal row at the same place is the same text again.
            repeat = order[same & ((own[order] != own[leader]) | (at[order] != at[leader]))]
            heads = order[~same]
            yield _batch(h=h[heads], whole=whole[heads], id=own[heads], at=at[heads])
            if len(repeat):
                text, low, more = joined(row[repeat], first[repeat], last[repeat])
                at = packed_at(batch.column("tag").to_numpy()[text], low, more)
                own = batch.column("id").to_numpy()[text]
                # Their second column only deals them out evenly.
                yield _batch(h=np.zeros(len(at), dtype=np.int64), whole=(at * 0x9E3779B97F4A7C1) ^ own, id=own, at=at)


def joined(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window and further windows of the ranges with neighbours joined, in pieces that a place can hold."""
    order = np.lexsort((first, text))
    text, first, last = text[order], first[order], last[order]
    new = np.concatenate([[True], (np.diff(text) != 0) | (first[1:] > last[:-1] + 1)])
    begin = np.flatnonzero(new)
    low, high = first[begin], np.maximum.reduceat(last, begin)
    most = 1 << MORE_BITS
    parts = (high - low) // most + 1
    which = np.repeat(np.arange(len(low)), parts)
    low = low[which] + (np.arange(len(which)) - (np.cumsum(parts) - parts)[which]) * most
    return text[begin][which], low, np.minimum(high[which] - low, most - 1)


def resolver(hot: np.ndarray):
    """Occurrences in order of (h, whole, id, at): repeats come out with ``open`` false, and those that differ from
    others of their seed, or have a hot seed, with ``open`` true.

    Rows are streamed; of what came before, only the last leader is kept.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, given = None, False
        for batch in batches:
            h, whole, own, at = (batch.column(c).to_numpy() for c in ("h", "whole", "id", "at"))
            known = h == 0
            if known.any():
                yield _batch(open=np.zeros(int(known.sum()), dtype=bool), id=own[known], at=at[known])
                h, whole, own, at = h[~known], whole[~known], own[~known], at[~known]
            if not len(h):
                continue
            if lead is not None:
                h, whole, own, at = (np.concatenate([[x], c]) for x, c in zip(lead, (h, whole, own, at)))
            other_seed = np.concatenate([[True], np.diff(h) != 0])
            other = other_seed | np.concatenate([[True], np.diff(whole) != 0])
            heads = np.flatnonzero(other)
            leader = heads[np.cumsum(other) - 1]
            repeat = ~other & ((own != own[leader]) | (at != at[leader]))
            alone = np.concatenate([other_seed[heads], [True]])
            shared = ~(alone[:-1] & alone[1:])
            if len(hot):
                shared |= hot[np.minimum(np.searchsorted(hot, h[heads]), len(hot) - 1)] == h[heads]
            emit = shared.copy()
            if lead is not None and given:
                emit[0] = False
            out = np.concatenate([np.flatnonzero(repeat), heads[emit]])
            yield _batch(open=np.arange(len(out)) >= int(repeat.sum()), id=own[out], at=at[out])
            given = bool(emit[-1]) or (len(heads) == 1 and lead is not None and given)
            lead = (h[heads[-1]], whole[heads[-1]], own[heads[-1]], at[heads[-1]])

    return resolve


def _tables():
    """For every node of the halving its offsets [low, high] and its children; node 0 has all offsets."""
    nodes, children = [(0, SIDE)], []
    for low, high in nodes:  # grows while it is read
        middle = (low + high) // 2
        children.append((len(nodes), len(nodes) + 1) if low < high else ())
        if low < high:
            nodes += [(low, middle), (middle + 1, high)]
    return nodes, children


NODES, CHILDREN = _tables()


def seed_key(h: np.ndarray, around: np.ndarray, node: int) -> np.ndarray:
    """Hash of the seed of ``node``: the seed and the words that all windows of the node's offsets hold around it."""
    low, high = NODES[node]
    value = h.view(np.uint64) + np.uint64(node)
    for c in [*range(SIDE - low, SIDE), *range(SIDE + SEED_WORDS, WIDTH - high)]:
        value = (value ^ around[:, c]) * np.uint64(_BASE)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def _around(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, WIDTH)


def _binary(around: np.ndarray) -> pa.Array:
    raw, step = np.ascontiguousarray(around), WIDTH * 8
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, step * len(raw) + 1, step, dtype=np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


OPEN = "key long, h long, node int, low int, high int, id long, at long, around binary"


def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open occurrences of a text with the words around their seeds, under the first node."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for raw, own, tag, runs in zip(batch.column("raw"), batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("runs")):
            wanted = np.unique(unpacked(runs.values.to_numpy())[1])
            words, ends, _, base = word_blocks([expand(raw.as_py())])
            block, h, place, first, last, _ = occurrences(words, ends)
            start = first + (base - ends[:-1])[block]
            keep = np.isin(start, wanted)
            block, h, place, first, last, start = (c[keep] for c in (block, h, place, first, last, start))
            columns = place[:, None] + np.arange(-SIDE, WIDTH - SIDE)
            inside = (columns >= first[:, None]) & (columns < last[:, None] + WINDOW)
            around = np.where(inside, words[np.clip(columns, 0, len(words) - 1)], np.uint64(0))
            n, high = len(h), place - first
            yield _batch(key=h | 1, h=h | 1, node=np.zeros(n, dtype=np.int32), low=(place - last).astype(np.int32), high=high.astype(np.int32),
                         id=np.full(n, own, dtype=np.int64), at=packed_at(np.full(n, tag, dtype=np.int64), start, last - first), around=_binary(around))


def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extends occurrences from their seed along the earliest one: repeats (without ``around``), and what goes on.

    ``low`` and ``high`` bound the offsets (words of a window before its seed) that an occurrence has in its node.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        around, other = _around(batch.column("around")), _around(batch.column("other"))
        h, node, low, high, own, at = (batch.column(c).to_numpy() for c in ("h", "node", "low", "high", "id", "at"))
        same = around == other
        left = np.logical_and.accumulate(same[:, SIDE - 1:: -1], axis=1).sum(axis=1)
        right = np.logical_and.accumulate(same[:, SIDE + SEED_WORDS:], axis=1).sum(axis=1)
        middle = same[:, SIDE: SIDE + SEED_WORDS].all(axis=1)  # always, but for equal hashes of different seeds
        lowest = np.where(middle, np.maximum(low, SIDE - right), SIDE + 1)
        highest = np.minimum(high, left)
        tag, first, last = unpacked(at)
        # Offset o is the window that starts o words before the seed; the occurrence's first window has its greatest.
        greatest = np.logical_and.accumulate(around[:, SIDE - 1:: -1] != 0, axis=1).sum(axis=1)
        found = np.flatnonzero(lowest <= highest)
        if len(found):
            begin = first[found] + greatest[found] - highest[found]
            n = len(found)
            none = pa.nulls(n, pa.binary())
            zero = np.zeros(n, dtype=np.int32)
            yield _batch(key=np.zeros(n, dtype=np.int64), h=h[found], node=zero, low=zero, high=zero, id=own[found], at=packed_at(tag[found], begin, highest[found] - lowest[found]), around=none)
        for number in np.unique(node).tolist():
            for child in CHILDREN[number]:
                a, b = NODES[child]
                some = np.flatnonzero((node == number) & ((low < lowest) | (high > highest) | (lowest > highest)))
                x, y = np.maximum(low[some], a), np.minimum(high[some], b)
                # What the earliest covers at either end is done.
                covered = lowest[some] <= highest[some]
                x = np.where(covered & (lowest[some] <= x) & (x <= highest[some]), highest[some] + 1, x)
                y = np.where(covered & (lowest[some] <= y) & (y <= highest[some]), lowest[some] - 1, y)
                some, x, y = some[x <= y], x[x <= y], y[x <= y]
                if len(some):
                    yield _batch(key=seed_key(h[some], around[some], child), h=h[some], node=np.full(len(some), child, dtype=np.int32), low=x.astype(np.int32), high=y.astype(np.int32),
                                 id=own[some], at=at[some], around=_binary(around[some]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array([squeeze(t) for t in batch.column("raw").to_pylist()], pa.binary()))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def kept_words(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, int, str]:
    """Words, words in the disjoint ascending ranges [low, high), and the SHA-256 of the other words joined by blanks."""
    digest = hashlib.sha256()
    if not len(low):
        n, empty = 0, True
        for piece in word_chunks(text):
            words = piece.split()
            n += len(words)
            if words:
                digest.update(b" ".join(words) if empty else b" " + b" ".join(words))
                empty = False
        return n, 0, digest.hexdigest()
    space = np.concatenate([[True], _IS_SPACE[np.frombuffer(text, dtype=np.uint8)], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin, stop = edge[::2], edge[1::2]
    empty = True
    for a, b in zip([0, *high.tolist()], [*low.tolist(), len(begin)]):
        for i in range(a, b, 100_000):
            part = b" ".join(text[begin[i]: stop[min(b, i + 100_000) - 1]].split())
            digest.update(part if empty else b" " + part)
            empty = False
    return len(begin), int((high - low).sum()), digest.hexdigest()


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    none = np.zeros(0, dtype=np.int64)
    for batch in batches:
        out = []
        for raw, runs in zip(batch.column("raw"), batch.column("runs")):
            low, high = none, none
            if runs.is_valid:
                _, first, last = unpacked(runs.values.to_numpy())
                order = np.argsort(first, kind="stable")
                first, reach = first[order], np.maximum.accumulate(last[order] + WINDOW)
                begin = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
                low, high = first[begin], reach[np.concatenate([begin[1:], [len(first)]]) - 1]
            out.append(kept_words(expand(raw.as_py()), low, high))
        n, removed, digests = zip(*out) if out else ((), (), ())
        yield _batch(id=batch.column("id"), n_words=pa.array(n, pa.int64()), n_removed=pa.array(removed, pa.int64()), kept_sha256=pa.array(digests, pa.string()))


def hot_seeds(rows: DataFrame) -> np.ndarray:
    """Seeds that many documents of a bounded sample have, ascending; HOT_MOST at most."""
    total = rows.count()
    if not total:
        return np.zeros(0, dtype=np.int64)
    sample = rows.sample(min(1.0, SAMPLE_ROWS / total), seed=13)
    counts = sample.mapInArrow(find, "h long, whole long, id long, at long").filter("h != 0").groupBy("h").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") >= max(10, HOT_SHARE * min(total, SAMPLE_ROWS))).orderBy(F.desc("n"), "h").limit(HOT_MOST)
    return np.sort(np.array([r["h"] for r in often.collect()], dtype=np.int64))


def _tag(at: str) -> Column:
    return F.shiftright(at, START_BITS + MORE_BITS)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_words, n_removed and the SHA-256 of what is left of every row."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, not {kind.simpleString()}")
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("tag"), text.cast("binary").alias("raw"))
    hot = hot_seeds(rows)
    found = rows.mapInArrow(find, "h long, whole long, id long, at long")
    lane = F.when((F.col("h") == 0) | F.col("h").isin(hot.tolist()), F.col("whole")).otherwise(0)
    dealt = found.withColumn("lane", lane).repartition("h", "lane").drop("lane").sortWithinPartitions("h", "whole", "id", "at")
    runs, _ = store(dealt.mapInArrow(resolver(hot), "open boolean, id long, at long"))

    packed = rows.mapInArrow(_packed, rows.schema)
    # A text's own runs, here and below: no more than it is long.
    of_text = runs.filter("open").groupBy("id", _tag("at").alias("tag")).agg(F.collect_list("at").alias("runs"))
    live, path = store(packed.join(of_text, ["id", "tag"]).mapInArrow(surround, OPEN))
    repeats, paths = runs.filter("not open").select("id", "at"), []
    while not live.isEmpty():
        earliest = live.groupBy("key").agg(F.min(F.struct("id", "at", "around")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        pairs = attach(live, earliest.select("key", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"), F.col("first.around").alias("other")), ["key"], "inner")
        later = pairs.filter("id != first_id or at != first_at").select("h", "node", "low", "high", "id", "at", "around", "other")
        extended, further = store(later.mapInArrow(extend, OPEN))
        paths.append(further)
        repeats = repeats.union(extended.filter("around is null").select("id", "at"))
        forget(spark, *([path] if len(paths) == 1 else []))
        live = extended.filter("around is not null")

    of_text = repeats.groupBy("id", _tag("at").alias("tag")).agg(F.collect_list("at").alias("runs"))
    done = packed.join(of_text, ["id", "tag"], "left").select("id", "raw", "runs").mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string")
    own = F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias(id_col)
    return done.select(own, "n_words", "n_removed", "kept_sha256")


def op13_remove_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents"))


#: Every window as text, the earliest place of each, and the words that later ones cover.
ORACLE = f"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
starts as (select doc_id, unnest(range(0, greatest(len(w) - {WINDOW - 1}, 0))) as i, w from docs),
windows as (select doc_id, i, array_to_string(w[i + 1: i + {WINDOW}], ' ') as s from starts),
earliest as (select s, min((doc_id, i)) as first from windows group by s),
gone as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as i from windows join earliest using (s) where (doc_id, i) > first),
words as (select doc_id, unnest(range(0, len(w))) as i, unnest(w) as word from docs),
kept as (select doc_id, string_agg(word, ' ' order by i) as t, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from docs d left join kept k on k.doc_id = d.doc_id
"""

QUERIES = {"op13_remove_passages": op13_remove_passages}
ORACLES = {"op13_remove_passages": ORACLE}
