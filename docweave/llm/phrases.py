"""Collocations: phrases that are frequent, and whose parts meet more often than their own counts would have it.

Mining takes three passes over the texts, each of which sends sums or bounded summaries:

1. Words of every language, and how many runs of one to five words fall to each hash partition (its mass).
2. Misra-Gries summaries. A task reduces the runs of a slice of texts to distinct keys with counts, and sends a hash
   partition's share of them as one row. A partition's summaries are merged one after another: counts of equal keys are
   added, and where more keys are left than the capacity, the greatest count beyond it is taken off all. With a capacity
   over mass / threshold, no key loses ``threshold`` or more in all, and what was lost in all is known; so every key whose
   count could still reach the threshold survives, and hardly any other does. The partition gives its survivors as its
   part of a table of bits.
3. Runs that are in the table are counted exactly, by their words, again a row for a slice and hash partition. Equal
   keys of different runs let a run through for nothing, they never change a count.

Memory: a task holds the runs of a slice, and a capacity of counters; the number of partitions grows with the mass (up
to MOST_PARTS; beyond that the capacity grows). The table of bits has a fixed size, FILTER_BITS bits, a part of it for
every partition, and is the only thing broadcast. It is a filter for the last pass: once survivors are many times its
bits it lets more runs through, which are counted and left out, so results stay the same.

Very frequent runs are reduced by every task before the shuffles; one language or word is dealt like many.

Result by case: null and empty texts have no words; a null language is ``und``; words never meet across a piece's end
or a text's; ties of score go by count, then by the phrase's bytes; equal rows count each; very long texts are read in
pieces cut at an end of a piece of text (longer pieces stay whole); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweave.operators.keyed import attach, top_k_by

from .common import slices, store, table
from .copies import WordHashes

LONGEST, LEAST_COUNT, TOP = 5, 100, 2000
#: Bytes of text whose runs are reduced at once; words in a worker's table of hashes.
SLICE_BYTES, CACHE_WORDS = 4 << 20, 300_000
#: Runs of a hash partition, partitions at most, bits of a key inside a partition.
PART_RUNS, MOST_PARTS, KEY_BITS = 1 << 23, 1 << 14, 32
#: Bits of the filter of survivors; groups in which a language's phrases are ranked first.
FILTER_BITS, LANES = 1 << 27, 16

#: A-Z in lower case; what ends a piece becomes a byte that no text has.
_END = b"\xff"
_FOLD = bytes(0xFF if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)

_hashes = WordHashes()


def _mixed(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    value = (value ^ word) * _MIX
    return value ^ (value >> np.uint64(29))


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, with ``_END`` where a piece ends; long texts some pieces at a time."""
    folded = (text or b"").translate(_FOLD)
    low = 0
    while low < len(folded):
        stop = folded.find(_END, low + SLICE_BYTES)
        stop = len(folded) if stop < 0 else stop
        yield folded[low:stop].replace(_END, b" \xff ").split()
        low = stop


class Runs:
    """The words of a slice of texts, one after another with ends between, and the hashes of all runs of them."""

    def __init__(self, texts: list[bytes | None], langs: list[str]):
        if len(_hashes) > CACHE_WORDS:
            _hashes.clear()
        _hashes[_END] = 0
        self.words: list[bytes] = []
        lengths = []
        for text in texts:
            before = len(self.words)
            for part in words_of(text):
                self.words += part
            self.words.append(_END)
            lengths.append(len(self.words) - before)
        self.langs = sorted(set(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.repeat(np.array([number[lang] for lang in langs], dtype=np.int64), lengths)
        hashes = np.fromiter(map(_hashes.__getitem__, self.words), dtype=np.uint64, count=len(self.words))
        ends = hashes == 0
        #: Words from each place to the next end.
        place = np.arange(len(hashes))
        self.room = np.minimum.accumulate(np.where(ends, place, len(hashes))[::-1])[::-1] - place
        self.salt = np.array([_hashes[lang.encode()] for lang in self.langs], dtype=np.uint64)
        self.hashes = hashes

    def n_words(self) -> np.ndarray:
        """Words of every language of the slice."""
        return np.bincount(self.lang[self.room > 0], minlength=len(self.langs))

    def all(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For one to LONGEST words: places where such runs begin, and their hashes, which differ by language."""
        value = self.salt[self.lang] if len(self.hashes) else self.hashes
        for n in range(1, LONGEST + 1):
            value = _mixed(value[: len(self.hashes) - n + 1], self.hashes[n - 1:])
            at = np.flatnonzero(self.room[: len(value)] >= n)
            yield n, at, value[at]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            yield Runs(batch.column("text").to_pylist(), batch.column("lang").to_pylist())


def masses(texts: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Words by language, and runs by the first bits of their hashes (MOST_PARTS numbers); tasks send sums only."""
    shift = np.uint64(64 - (MOST_PARTS.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(MOST_PARTS, dtype=np.int64), {}
        for runs in _slices(batches):
            for lang, n in zip(runs.langs, runs.n_words().tolist()):
                words[lang] = words.get(lang, 0) + n
            for _, _, value in runs.all():
                total += np.bincount((value >> shift).astype(np.int64), minlength=MOST_PARTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*words, *[None] * len(some)], pa.string()), pa.array([*[-1] * len(words), *some.tolist()], pa.int64()), pa.array([*words.values(), *total[some].tolist()], pa.int64())], names=["lang", "part", "n"])

    sums = texts.mapInArrow(count, "lang string, part long, n long").groupBy("lang", "part").agg(F.sum("n").alias("n"))
    stored, _ = store(sums)
    words = {r["lang"]: r["n"] for r in stored.filter("part < 0 and n > 0").collect()}
    found = stored.filter("part >= 0").select("part", "n").toArrow()
    total = np.zeros(MOST_PARTS, dtype=np.int64)
    total[found.column("part").to_numpy()] = found.column("n").to_numpy()
    return words, total


class Summary:
    """Misra-Gries counters: at most ``capacity`` keys, ascending, with lower bounds of their counts.

    ``lost`` is what any key's count may be short of. It is at most the mass taken in over ``capacity + 1``.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds another summary's keys, which may repeat; its own loss, if any, is to be added by the caller."""
        self.keys, inverse = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(inverse, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            stay = self.counts > off
            self.keys, self.counts, self.lost = self.keys[stay], self.counts[stay] - off, self.lost + off

    def survivors(self, least: int) -> np.ndarray:
        """All keys whose count may be ``least``; for every key of such a count, if ``lost`` is below ``least``."""
        return self.keys[self.counts + self.lost >= least]


def _parts(mass: int) -> int:
    """Hash partitions for a mass: a power of two."""
    return min(MOST_PARTS, 1 << max(0, (mass - 1).bit_length() - (PART_RUNS.bit_length() - 1)))


def summaries(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for every slice and hash partition: the distinct keys, those seen once first, and the others' counts."""
    bits = parts.bit_length() - 1 + KEY_BITS
    for runs in _slices(batches):
        runs.words = []
        value = np.concatenate([v for _, _, v in runs.all()])
        value >>= np.uint64(64 - bits)
        value.sort()
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, dtype=np.int64)
        keys, counts = value[first], np.diff(np.append(first, len(value)))
        del value
        part = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
        edge = np.searchsorted(part, np.arange(parts + 1))
        keys = keys.astype(np.uint32)
        out = []
        for p, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist())):
            if a < b:
                one = counts[a:b] == 1
                out.append((p, int(one.sum()), keys[a:b][one].tobytes() + keys[a:b][~one].tobytes(), counts[a:b][~one].astype(np.uint32).tobytes()))
        if out:
            p, ones, raw, several = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(ones, pa.int64()), pa.array(raw, pa.binary()), pa.array(several, pa.binary())], names=["part", "ones", "keys", "counts"])


def surviving(batches: Iterator[pa.RecordBatch], mass: np.ndarray, least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for every hash partition, whose summaries come together: its ``bits`` bits of the filter."""

    def closed() -> pa.RecordBatch:
        if held:
            summary.merge(*(np.concatenate(c) for c in zip(*held)))
        keys = summary.survivors(least)
        marks = np.zeros(bits, dtype=np.uint8)
        marks[(keys * bits) >> KEY_BITS] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    part, summary, held, size = None, None, [], 0
    for batch in batches:
        for p, ones, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "ones", "keys", "counts"))):
            if p != part:
                if part is not None:
                    yield closed()
                part, summary, held, size = p, Summary(int(mass[p]) // least + 1), [], 0
            keys = np.frombuffer(keys, dtype=np.uint32).astype(np.int64)
            held.append((keys, np.concatenate([np.ones(ones, dtype=np.int64), np.frombuffer(counts, dtype=np.uint32).astype(np.int64)])))
            size += len(keys)
            if size > max(2 * summary.capacity, 1 << 16):
                summary.merge(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
    if part is not None:
        yield closed()


def frequent(texts: DataFrame, mass: np.ndarray, least: int) -> DataFrame:
    """``lang, phrase, words, n``: the exact count of every run of words that occurs ``least`` times in its language."""
    sc = texts.sparkSession.sparkContext
    parts = _parts(int(mass.sum()))
    own = mass.reshape(parts, -1).sum(axis=1)
    bits = FILTER_BITS // parts
    shared_mass = sc.broadcast(own)
    dealt = texts.mapInArrow(lambda b: summaries(b, parts), "part int, ones long, keys binary, counts binary").repartition(parts, "part").sortWithinPartitions("part")
    rows = dealt.mapInArrow(lambda b: surviving(b, shared_mass.value, least, bits), "part int, bits binary").toArrow()
    marks = np.zeros((parts, bits // 8), dtype=np.uint8)  # FILTER_BITS in all, whatever the input
    for p, raw in zip(rows.column("part").to_pylist(), rows.column("bits").to_pylist()):
        marks[p] = np.frombuffer(raw, dtype=np.uint8)
    shared = sc.broadcast(marks.reshape(-1))
    shift = np.uint64(64 - (FILTER_BITS.bit_length() - 1))

    part_shift = np.uint64(64 - (parts.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every slice, hash partition and language: its phrases, one a line, and their counts."""
        for runs in _slices(batches):
            found = []
            for n, at, value in runs.all():
                # A partition's bits stand in the order of its keys, so the first bits of a hash are its place.
                place = value >> shift
                stay = (shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                value, first, times = np.unique(value[stay], return_index=True, return_counts=True)
                found.append((value >> part_shift if parts > 1 else value * np.uint64(0), at[stay][first], np.full(len(first), n), times))
            part, at, n, times = (np.concatenate(c) for c in zip(*found))
            group = part.astype(np.int64) * len(runs.langs) + runs.lang[at]
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
            out = []
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                own = order[a:b]
                lines = b"\n".join([b" ".join(runs.words[i: i + k]) for i, k in zip(at[own].tolist(), n[own].tolist())])
                out.append((int(part[own[0]]), runs.langs[int(runs.lang[at[own[0]]])], lines, times[own].astype(np.int64).tobytes()))
            if out:
                part, lang, lines, times = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(lang), pa.array(lines, pa.binary()), pa.array(times, pa.binary())], names=["part", "lang", "lines", "times"])

    counted = texts.mapInArrow(count, "part int, lang string, lines binary, times binary").repartition(parts, "part").sortWithinPartitions("part", "lang")
    return counted.mapInArrow(lambda b: added(b, least), "lang string, phrase string, words int, n long")


def added(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The phrases of a hash partition and language, whose rows come together, that occur ``least`` times in all.

    What is held is little more than the frequent phrases of a partition: its mass over ``least``.
    """

    def closed() -> pa.RecordBatch:
        often = [(phrase, n) for phrase, n in held.items() if n >= least]
        phrases = [phrase for phrase, _ in often]
        return pa.RecordBatch.from_arrays([pa.array([key[1]] * len(often), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                                           pa.array([phrase.count(b" ") + 1 for phrase in phrases], pa.int32()), pa.array([n for _, n in often], pa.int64())], names=["lang", "phrase", "words", "n"])

    key, held = None, {}
    for batch in batches:
        for part, lang, lines, times in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "lines", "times"))):
            if (part, lang) != key:
                if key is not None:
                    yield closed()
                key, held = (part, lang), {}
            for phrase, n in zip(lines.split(b"\n"), np.frombuffer(times, dtype=np.int64).tolist()):
                held[phrase] = held.get(phrase, 0) + n
    if key is not None:
        yield closed()


def _joined(words: Column, first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """Lang, rank, phrase, a, l, r, n and score of every language's best phrases."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("binary").alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    n_words, mass = masses(texts)
    shape = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not n_words:
        return spark.createDataFrame([], shape)
    counts, _ = store(frequent(texts, mass, least))
    candidates = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    # Every part of two words or more of a candidate, with the greatest count of a longer candidate around it.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _joined(F.col("w"), i, m))))
    inner = candidates.filter("words >= 3").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = attach(candidates, inner, ["lang", "phrase"]).filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))

    # Parts of a candidate are as frequent as it is, so their counts are there.
    cuts = alone.select("lang", "phrase", "words", "w", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("w"), F.lit(1), F.col("k")).alias("head"), _joined(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    known = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    cuts = attach(cuts, known, ["lang", "head"], "inner")
    cuts = attach(cuts, known.select("lang", F.col("head").alias("tail"), F.col("l").alias("r")), ["lang", "tail"], "inner")
    totals = F.create_map(*[F.lit(x) for pair in n_words.items() for x in pair])  # one entry a language
    cuts = cuts.withColumn("n", F.element_at(totals, F.col("lang")).cast("long"))
    scored = cuts.withColumn("score", F.expr("cast((cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    fewer = top_k_by(flat.withColumn("lane", F.pmod(F.xxhash64("phrase"), F.lit(LANES))), ["lang", "lane"], order, top, "place")
    ranked = top_k_by(fewer, ["lang"], order, top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All runs of one to five words as text, counted.
ORACLE = f"""
with docs as (select doc_id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as p from docs),
listed as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from listed group by lang),
runs as (select lang, m, i, w from (select lang, w, m, unnest(range(0, greatest(len(w) - m + 1, 0))) as i from listed, (select unnest(range(1, {LONGEST + 1})) as m))),
counts as (select lang, m, array_to_string(w[i + 1: i + m], ' ') as phrase, cast(count(*) as bigint) as f from runs group by all having count(*) >= {LEAST_COUNT}),
candidates as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from counts where m >= 2),
spans as (select lang, a, w, k, unnest(range(0, m - k + 1)) as i from (select *, unnest(range(2, m)) as k from candidates)),
inside as (select lang, array_to_string(w[i + 1: i + k], ' ') as phrase, max(a) as longer from spans group by all),
alone as (select c.* from candidates c left join inside s on s.lang = c.lang and s.phrase = c.phrase where longer is null or 100 * longer < 100 * a),
cuts as (select lang, phrase, a, k, array_to_string(w[1: k], ' ') as head, array_to_string(w[k + 1: m], ' ') as tail from (select *, unnest(range(1, m)) as k from alone)),
scored as (select c.lang, c.phrase, c.a, c.k, h.f as l, t.f as r, n, cast((cast(1000 as hugeint) * c.a * n) // (cast(h.f as hugeint) * t.f) as bigint) as score
  from cuts c join counts h on h.lang = c.lang and h.phrase = c.head join counts t on t.lang = c.lang and t.phrase = c.tail join totals x on x.lang = c.lang),
lowest as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as nth from scored) where nth = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from lowest)
select lang, cast(rank as bigint) as rank, phrase, a, l, r, n, score from ranked where rank <= {TOP}
"""

QUERIES = {"op11_phrases": op11_phrases}
ORACLES = {"op11_phrases": ORACLE}
