"""Removal of repeated passages: every byte under a LENGTH-byte string that starts earlier in the corpus as well.

Texts are cut by content: all starts of LENGTH-byte strings with the same chosen place (see ``windows``) form a run, and
equal strings have equal chosen places, so only runs with equal place hashes can share a string. Runs meet in a task by
that hash. Where their whole texts are equal, all but the earliest are repeats. Where texts differ, the distinct ones go
into a run-length index, whose streamed match lengths tell which starts are seen in an earlier one.

Hot places: a task first reduces its own equal runs to the earliest, so a shuffle gets a row per batch of texts and no
more. A place with more than HOT_RUNS different texts is not indexed as one group; its strings are counted one by one, by
hash, with sums that tasks reduce first and joins that run-time re-planning can split.

Texts cross a shuffle twice, compressed: once to cut out the runs that have to be indexed, once to be cut to the result.

Result by case: a null or empty text, or one shorter than LENGTH, keeps all it has; null ids count as smaller than all
others; rows with equal ids are ordered by the hash of their text, and equal rows with equal ids are one text; long
texts are cut in blocks that overlap, which changes nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweave.operators.keyed import attach

from .common import flat_bytes, slices, store, table
from .run_index import RunIndex
from .windows import CHOICE, LENGTH, chosen_places

#: Bytes of text that are hashed at once, and of runs that are indexed at once.
HASH_BYTES, INDEX_BYTES = 1 << 20, 1 << 19
HOT_RUNS = 20_000
#: A place in the corpus below the id: the text's hash, the first start, further starts of the run.
TAG_BITS, START_BITS, MORE_BITS = 25, 31, 7
NO_ID = -(2**63)


def _at(tag: np.ndarray, first: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (tag << (START_BITS + MORE_BITS)) | (first << MORE_BITS) | more


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tag, first start, last start."""
    first = (at >> MORE_BITS) & ((1 << START_BITS) - 1)
    return at >> (START_BITS + MORE_BITS), first, first + (at & ((1 << MORE_BITS) - 1))


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64, copy=False)) for c in columns], names=names)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a batch's texts: row, hash, first and last start in the text, and the hash of the run's bytes."""
    import xxhash

    for part in slices(batch, "raw", HASH_BYTES):
        base = part.column("row").to_numpy()
        raw, ends = flat_bytes(part.column("raw"))
        for low in range(0, max(1, len(raw)), HASH_BYTES) if part.num_rows == 1 else [0]:
            piece = raw[low: low + HASH_BYTES + LENGTH - 1] if part.num_rows == 1 else raw
            text, value, first, last = chosen_places(piece, np.array([0, len(piece)]) if part.num_rows == 1 else ends)
            data = piece.tobytes()
            whole = np.fromiter((xxhash.xxh64_intdigest(data[a: b + LENGTH]) | 1 for a, b in zip(first.tolist(), last.tolist())), dtype=np.uint64, count=len(first))
            start = low if part.num_rows == 1 else ends[text]
            shift = start if part.num_rows == 1 else -start
            yield base[text], (value | np.uint64(1)).view(np.int64), first + shift, last + shift, whole.view(np.int64)


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, whole, id, at) of the earliest of a batch's equal runs; the others come with ``whole`` 0, they are repeats."""
    names = ["h", "whole", "id", "at"]
    for batch in batches:
        ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("raw")], names=["row", "raw"])
        found = list(_blocks(numbered))
        if not found:
            continue
        row, h, first, last, whole = (np.concatenate(c) for c in zip(*found))
        at, own = _at(tags[row], first, last - first), ids[row]
        order = np.lexsort((at, own, whole, h))
        same = (np.diff(h[order]) == 0) & (np.diff(whole[order]) == 0)
        later = order[1:][same]
        head = np.ones(len(order), dtype=bool)
        head[later] = False
        # A row equal to the earliest, in id and place, is the same text again.
        group = np.cumsum(np.concatenate([[True], ~same])) - 1
        leader = np.empty(len(order), dtype=np.int64)
        leader[order] = order[np.flatnonzero(np.concatenate([[True], ~same]))[group]]
        twin = ~head & (own == own[leader]) & (at == at[leader])
        yield _batch(names, h[head], whole[head], own[head], at[head])
        # Neighbouring repeats of a text become longer runs, dealt evenly.
        r = np.flatnonzero(~head & ~twin)
        if len(r):
            low, high = merged(row[r], first[r], last[r])
            text = low[0]
            at = np.unique(np.stack([ids[text], _at(tags[text], low[1], high - low[1])]), axis=1)
            yield _batch(names, (at[1] * 0x9E3779B97F4A7C1 + at[0]) | 1, np.zeros(at.shape[1], dtype=np.int64), at[0], at[1])


def merged(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of starts with neighbours joined, cut again to what a place can hold: ((text, first), last)."""
    order = np.lexsort((first, text))
    text, first, last = text[order], first[order], last[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (np.diff(text) != 0) | (first[1:] > last[:-1] + 1)
    begin = np.flatnonzero(new)
    low, high, whose = first[begin], np.maximum.reduceat(last, begin), text[begin]
    most = 1 << MORE_BITS
    parts = (high - low) // most + 1
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.repeat(low, parts) + nth * most
    return np.stack([np.repeat(whose, parts), low]), np.minimum(np.repeat(high, parts), low + most - 1)


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of (h, whole, id, at): (0, id, at) for repeats, (h, id, at) for distinct texts of a shared place.

    Rows are streamed; of what came before, only the last run and whether its place is shared are kept.
    """
    names = ["h", "id", "at"]
    lead = None  # h, whole, id, at of the earliest of the present runs, and whether it has been given out
    for batch in batches:
        h, whole, own, at = (batch.column(c).to_numpy() for c in ("h", "whole", "id", "at"))
        known = whole == 0
        if known.any():
            yield _batch(names, np.zeros(int(known.sum())), own[known], at[known])
            h, whole, own, at = h[~known], whole[~known], own[~known], at[~known]
        if not len(h):
            continue
        if lead is not None:
            h, whole, own, at = (np.concatenate([[x], c]) for x, c in zip(lead, (h, whole, own, at)))
        new_place = np.concatenate([[True], np.diff(h) != 0])
        new_text = new_place | np.concatenate([[True], np.diff(whole) != 0])
        heads = np.flatnonzero(new_text)
        leader = heads[np.cumsum(new_text) - 1]
        repeat = ~new_text & ~((own == own[leader]) & (at == at[leader]))
        if repeat.any():
            yield _batch(names, np.zeros(int(repeat.sum())), own[repeat], at[repeat])
        alone_before = new_place[heads]
        shared = ~alone_before
        shared[:-1] |= ~alone_before[1:]
        given = lead is not None and lead_given
        if given:
            shared[0] = False
        out = heads[shared]
        if len(out):
            yield _batch(names, h[out], own[out], at[out])
        k = heads[-1]
        lead = (h[k], whole[k], own[k], at[k])
        lead_given = bool(shared[-1]) or (given and len(heads) == 1)


def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, at) of the repeated starts among runs that come in order of their place's hash."""
    held: list[pa.RecordBatch] = []

    def close() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        own, at = rows.column("id").to_numpy(), rows.column("at").to_numpy()
        order = np.lexsort((at, own))
        order = order[np.concatenate([[True], (np.diff(own[order]) != 0) | (np.diff(at[order]) != 0)])]
        own, at = own[order], at[order]
        raw, ends = flat_bytes(rows.column("piece").take(pa.array(order)).combine_chunks())
        made = RunIndex(raw, ends, LENGTH + CHOICE)
        seen = made.seen_before(LENGTH).astype(np.int8)
        edge = np.diff(np.concatenate([[0], seen]))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a text's end is never seen before
        text = np.searchsorted(made.start, begin, side="right") - 1
        tag, first, _ = _unpacked(at[text])
        if len(begin):
            yield _batch(["id", "at"], own[text], _at(tag, first + begin - made.start[text], stop - 1 - begin))

    size = 0
    for batch in batches:
        h = batch.column("h").to_numpy()
        at = 0
        if held and size >= INDEX_BYTES:  # close at the first row of another place
            last = held[-1].column("h")[-1].as_py()
            at = int(np.argmax(h != last)) if (h != last).any() else len(h)
            held.append(batch.slice(0, at))
            if at < len(h):
                yield from close()
                held, size = [], 0
        if at < len(h):
            held.append(batch.slice(at))
            size += batch.slice(at).column("piece").nbytes
    if held:
        yield from close()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = pa.array([squeeze(t) for t in batch.column("raw").to_pylist()], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("raw"), "raw", packed)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that a text gives to the index."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for raw, own, runs in zip(batch.column("raw"), batch.column("id").to_numpy(), batch.column("runs")):
            data = expand(raw.as_py())
            runs = runs.values.flatten()
            at = runs[1].to_numpy()
            _, first, last = _unpacked(at)
            pieces = pa.array([data[a: b + LENGTH] for a, b in zip(first.tolist(), last.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([runs[0], pa.array(np.full(len(at), own)), pa.array(at), runs[2], pieces], names=["h", "id", "at", "hot", "piece"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of a run on its own, by two hashes."""
    import xxhash

    for batch in batches:
        for piece, own, at in zip(batch.column("piece").to_pylist(), batch.column("id").to_numpy(), batch.column("at").to_numpy()):
            tag, first, last = _unpacked(at)
            starts = np.arange(last - first + 1)
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(piece[s: s + LENGTH]) for s in starts.tolist()), dtype=np.int64).reshape(-1, 2)
            yield _batch(["a", "b", "id", "at"], both[:, 0], both[:, 1], np.full(len(starts), own), _at(np.full(len(starts), tag), first + starts, np.zeros(len(starts), dtype=np.int64)))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the texts that have repeats."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        removed, spans, digests = [], [], []
        for raw, sha, runs in zip(batch.column("raw"), batch.column("sha"), batch.column("runs")):
            if not runs.is_valid:
                removed.append(0)
                spans.append(0)
                digests.append(sha.as_py())
                continue
            _, first, last = _unpacked(runs.values.to_numpy())
            order = np.argsort(first, kind="stable")
            first, reach = first[order], np.maximum.accumulate(last[order] + LENGTH)
            new = np.concatenate([[True], first[1:] > reach[:-1]])
            low, high = first[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(first) - 1]])]
            data = memoryview(expand(raw.as_py()))
            kept = hashlib.sha256()
            for a, b in zip([0, *high.tolist()], [*low.tolist(), len(data)]):
                kept.update(data[a:b])
            removed.append(int((high - low).sum()))
            spans.append(len(low))
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                                         names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _tag(at: str) -> Column:
    return F.shiftright(at, START_BITS + MORE_BITS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """Id, n_bytes, n_removed, n_spans and the SHA-256 of what is left of every row."""
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).bitwiseAND(F.lit((1 << TAG_BITS) - 1)).alias("tag"), text.cast("binary").alias("raw"))
    chosen = rows.mapInArrow(choose, "h long, whole long, id long, at long")
    ordered = chosen.repartition("h").sortWithinPartitions("h", "whole", "id", "at")
    runs, _ = store(ordered.mapInArrow(resolve, "h long, id long, at long"))

    heads = runs.filter("h != 0")
    crowded = heads.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot_runs).select("h", F.lit(True).alias("hot"))
    wanted = attach(heads, crowded, ["h"]).withColumn("hot", F.coalesce("hot", F.lit(False)))
    # A text's own runs: as many as it is long.
    of_text = wanted.groupBy("id", _tag("at").alias("tag")).agg(F.collect_list(F.struct("h", "at", "hot")).alias("runs"))
    packed = rows.mapInArrow(_packed, rows.schema)
    pieces, _ = store(packed.join(of_text, ["id", "tag"]).mapInArrow(_cut, "h long, id long, at long, hot boolean, piece binary"))

    indexed = pieces.filter("not hot").select("h", "id", "at", "piece").repartition("h").sortWithinPartitions("h").mapInArrow(index, "id long, at long")
    strings = pieces.filter("hot").select("id", "at", "piece").mapInArrow(_strings, "a long, b long, id long, at long")
    earliest = strings.groupBy("a", "b").agg(F.min(F.struct("id", "at")).alias("first"))
    counted = attach(strings, earliest, ["a", "b"], "inner").filter(F.struct("id", "at") > F.col("first")).select("id", "at")

    repeats = runs.filter("h = 0").select("id", "at").union(indexed).union(counted)
    of_text = repeats.groupBy("id", _tag("at").alias("tag")).agg(F.collect_list("at").alias("runs"))
    measured = rows.withColumn("n_bytes", F.octet_length("raw").cast("long")).withColumn("sha", F.sha2("raw", 256))
    done = measured.mapInArrow(_packed, measured.schema).join(of_text, ["id", "tag"], "left").select("id", "n_bytes", "sha", "raw", "runs").mapInArrow(_finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    own = F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias(id_col)
    return done.select(own, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every string of LENGTH bytes as hexadecimal text, the earliest place of each, and what later ones cover.
ORACLE = f"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
parts as (select doc_id, c, substr(h, 1000 * c + 1, {1000 + 2 * LENGTH - 2}) as part from (select doc_id, h, unnest(range(0, length(h) // 1000 + 1)) as c from docs)),
strings as (select doc_id, 500 * c + j as i, substr(part, 2 * j + 1, {2 * LENGTH}) as s from (select doc_id, c, part, unnest(range(0, length(part) // 2 - {LENGTH - 1})) as j from parts)),
earliest as (select s, min((doc_id, i)) as first from strings group by s),
repeats as (select doc_id, i from strings join earliest using (s) where (doc_id, i) > first),
edges as (select *, case when i > lag(i) over (partition by doc_id order by i) + {LENGTH} or lag(i) over (partition by doc_id order by i) is null then 1 else 0 end as fresh from repeats),
numbered as (select *, sum(fresh) over (partition by doc_id order by i) as run from edges),
runs as (select doc_id, run, min(i) as low, max(i) + {LENGTH} as high from numbered group by doc_id, run),
gaps as (select r.doc_id, run, low, high, coalesce(lag(high) over (partition by r.doc_id order by run), 0) as after, h from runs r join docs d on d.doc_id = r.doc_id),
kept as (select doc_id, sum(high - low) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * after + 1, 2 * (low - after)), '' order by run) || any_value(substr(h, 2 * last + 1)) as h
  from (select *, max(high) over (partition by doc_id) as last from gaps) group by doc_id)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(k.h, d.h))) as kept_sha256 from docs d left join kept k on k.doc_id = d.doc_id
"""

QUERIES = {"op4_remove_repeats": op4_remove_repeats}
ORACLES = {"op4_remove_repeats": ORACLE}
