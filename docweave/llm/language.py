"""Language identification with a linear-chain conditional random field over words.

Every word gets a language from its affixes and character n-grams (grams that touch a word's edge are its affixes), a
lexicon of words that are frequent in one language, and learned transitions between neighbouring words. Forward-backward
gives each word's marginals; a text's language is the one with the greatest sum of marginals over its words, and the
score is its share. A chain is a run of up to CHAIN words, so that all chains of a batch are worked on together.

Training reads texts and their languages only, on a sample of at most SAMPLE_TEXTS texts for a language and
SAMPLE_WORDS words for each, in one task. Words start with the language of their text; after the first passes, words that
the model is sure belong to another language are relabelled, which is where transitions between languages come from.

Result by case: `und` with score 0 for a null text, one without a letter, or where nothing could be learned; a null id
is never learned from; long texts are read whole; equal texts get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweave.operators.keyed import top_k_by

from .common import fresh, keeping, slices, table

UNKNOWN = "und"
CHAIN, GRAMS, BUCKETS = 64, 4, 1 << 16
SAMPLE_TEXTS, SAMPLE_WORDS = 500, 100_000
PASSES, RATE, DECAY, STAY = 4, 0.3, 1e-6, 0.95
LEXICON_COUNT, LEXICON_SHARE, SURE = 5, 0.9, 0.1
#: A text whose best language has less than this is in no language.
LEAST_SCORE = 0.5
#: Pieces of text kept in a worker's cache, and bytes of text whose chains are worked on together.
CACHE_PIECES, SLICE_BYTES = 600_000, 2 << 20

_LETTERS = re.compile(r"[^\W\d_]+")
_taggers: dict[str, "Tagger"] = {}


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the grams of all words, one after another, and where each word's begin."""
    marked = ["^" + w + "$" for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(chars))
    features, owner = [], []
    state = np.zeros(len(chars), dtype=np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    for n in range(1, GRAMS + 1):
        state = state[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1:] + np.uint64(n)
        inside = room[: len(state)] >= n
        mixed = state[inside] * np.uint64(0xD6E8FEB86659FD93)
        features.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word[: len(state)][inside])
    every, whose = np.concatenate(features), np.concatenate(owner)
    order = np.argsort(whose, kind="stable")
    return every[order], np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(words)))])


def chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' words in rows of CHAIN places: word index (0 where there is none) and which places are real."""
    rows_of = -(-counts // CHAIN)
    text = np.repeat(np.arange(len(counts)), rows_of)
    nth = np.arange(len(text)) - (np.cumsum(rows_of) - rows_of)[text]
    at = (np.cumsum(counts) - counts)[text][:, None] + nth[:, None] * CHAIN + np.arange(CHAIN)
    real = nth[:, None] * CHAIN + np.arange(CHAIN) < counts[text][:, None]
    return np.where(real, at, 0), real


def marginals(scores: np.ndarray, real: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on all chains: word marginals (chain, place, label) and expected transitions summed up."""
    shifted = scores - scores.max(axis=2, keepdims=True)
    potential = np.where(real[:, :, None], np.exp(shifted), 1.0)
    step = np.exp(transition - transition.max())
    forward = np.empty_like(potential)
    forward[:, 0] = potential[:, 0] / potential[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, scores.shape[1]):
        now = (forward[:, t - 1] @ step) * potential[:, t]
        forward[:, t] = now / now.sum(axis=1, keepdims=True)
    backward = np.ones_like(forward[:, 0])
    out = np.empty_like(potential)
    out[:, -1] = forward[:, -1]
    pairs = np.zeros_like(step)
    for t in range(scores.shape[1] - 2, -1, -1):
        ahead = potential[:, t + 1] * backward
        joint = forward[:, t][:, :, None] * step[None] * ahead[:, None, :]
        both = real[:, t + 1]
        pairs += (joint[both] / joint[both].sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward = np.where(both[:, None], ahead @ step.T, 1.0)
        backward /= backward.sum(axis=1, keepdims=True)
        now = forward[:, t] * backward
        out[:, t] = now / now.sum(axis=1, keepdims=True)
    return out, pairs


def letters(piece: str) -> str:
    """The letters of a piece of text, in one word."""
    return "".join(_LETTERS.findall(piece))


def fit(texts: list[str], labels: list[str]) -> dict:
    """Languages, gram weights, lexicon weights and transitions learned from labelled texts."""
    languages = sorted(set(labels))
    size = len(languages)
    sequences, truth, used = [], [], Counter()
    for text, label in zip(texts, labels):
        words = [w for w in map(letters, text.lower().split()) if w][: SAMPLE_WORDS - used[label]]
        if words:
            sequences.append(words)
            truth.append(np.full(len(words), languages.index(label)))
            used[label] += len(words)
    if not sequences:
        return {"languages": [], "grams": np.zeros((BUCKETS, 0), dtype=np.float32), "entry": np.zeros((0, 0)), "lexicon": {}, "transition": np.zeros((0, 0))}
    counts = np.array([len(s) for s in sequences], dtype=np.int64)
    flat = [w for s in sequences for w in s]
    label = np.concatenate([np.zeros(0, dtype=np.int64), *truth])
    vocabulary = sorted(set(flat))
    number = {w: i for i, w in enumerate(vocabulary)}
    word = np.fromiter((number[w] for w in flat), dtype=np.int64, count=len(flat))

    tally = np.zeros((len(vocabulary), size))
    np.add.at(tally, (word, label), 1)
    often = (tally.sum(axis=1) >= LEXICON_COUNT) & (tally.max(axis=1) >= LEXICON_SHARE * tally.sum(axis=1))
    lexicon = {vocabulary[i]: int(tally[i].argmax()) for i in np.flatnonzero(often)}
    feature, at = gram_features(vocabulary)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(at))
    member = np.full(len(vocabulary), -1)
    for w, language in lexicon.items():
        member[number[w]] = language

    grams, entry = np.zeros((BUCKETS, size)), np.zeros((size, size))
    transition = np.full((size, size), np.log((1 - STAY) / max(1, size - 1)))
    np.fill_diagonal(transition, np.log(STAY))
    seen = [np.full_like(a, 1e-2) for a in (grams, entry, transition)]
    place, real = chains(counts)
    rng = np.random.default_rng(0)

    def emissions() -> np.ndarray:
        out = np.add.reduceat(grams[feature], at[:-1], axis=0)
        out[member >= 0] += entry[member[member >= 0]]
        return out

    for turn in range(PASSES):
        if turn == PASSES // 2:  # words that are surely of another language than their text
            every, _ = marginals(emissions()[word[place]], real, transition)
            sure = every.max(axis=2) > 1 - SURE
            label = label.copy()
            label[place[real & sure]] = every.argmax(axis=2)[real & sure]
        for rows in np.array_split(rng.permutation(len(place)), max(1, len(place) // 256)):
            used, where = np.unique(word[place[rows]], return_inverse=True)
            part = np.concatenate([np.arange(at[u], at[u + 1]) for u in used])
            local = np.repeat(np.arange(len(used)), at[used + 1] - at[used])
            score = np.zeros((len(used), size))
            for k in range(size):
                score[:, k] = np.bincount(local, weights=grams[feature[part], k], minlength=len(used))
            known = member[used] >= 0
            score[known] += entry[member[used[known]]]
            mask = real[rows]
            found, pairs = marginals(score[where.reshape(mask.shape)], mask, transition)
            wanted = label[place[rows]]
            gap = found
            gap[np.arange(len(rows))[:, None], np.arange(CHAIN)[None, :], wanted] -= 1
            gap[~mask] = 0
            total = mask.sum()
            by_word = np.stack([np.bincount(where.ravel(), weights=gap[:, :, k].ravel(), minlength=len(used)) for k in range(size)], axis=1)
            together = mask[:, 1:]
            np.add.at(pairs, (wanted[:, :-1][together], wanted[:, 1:][together]), -1)
            by_gram = np.stack([np.bincount(feature[part], weights=by_word[local, k], minlength=BUCKETS) for k in range(size)], axis=1)
            by_entry = np.zeros_like(entry)
            np.add.at(by_entry, member[used[known]], by_word[known])
            for weights, slope, past in zip((grams, entry, transition), (by_gram, by_entry, pairs), seen):
                slope = slope / total + DECAY * weights
                past += slope * slope
                weights -= RATE * slope / np.sqrt(past)
    return {"languages": languages, "grams": grams.astype(np.float32), "entry": entry, "lexicon": lexicon, "transition": transition}


class Tagger(dict):
    """Piece of text -> row of its scores; row 0 stands for pieces without letters."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.size = model, len(model["languages"])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.word_row: dict[str, int] = {}
        self.table = np.zeros((1, self.size), dtype=np.float32)

    def __missing__(self, piece: str) -> int:
        word = letters(piece)
        row = 0
        if word:
            row = self.word_row.get(word, 0)
            if not row:
                self.new.append(word)
                row = self.word_row[word] = len(self.table) + len(self.new) - 1
        self[piece] = row
        return row

    def learn(self) -> None:
        feature, at = gram_features(self.new)
        scores = np.add.reduceat(self.model["grams"][feature], at[:-1], axis=0)
        for i, word in enumerate(self.new):
            language = self.model["lexicon"].get(word)
            if language is not None:
                scores[i] += self.model["entry"][language]
        self.table = np.concatenate([self.table, scores])
        self.new = []

    def label(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if len(self) > CACHE_PIECES:
            self.forget()
        rows = [np.fromiter(map(self.__getitem__, p), dtype=np.int64, count=len(p)) for p in ((t or "").lower().split() for t in texts)]
        if self.new:
            self.learn()
        rows = [r[r > 0] for r in rows]
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *rows])
        mass = np.zeros((len(texts), self.size))
        if len(flat) and self.size:
            place, real = chains(counts)
            found, _ = marginals(self.table[flat[place]].astype(np.float64), real, self.model["transition"])
            sums = np.where(real[:, :, None], found, 0.0).sum(axis=1)
            np.add.at(mass, np.repeat(np.arange(len(texts)), -(-counts // CHAIN)), sums)
        total = mass.sum(axis=1)
        known = total > 0
        best = mass.argmax(axis=1) if self.size else np.zeros(len(texts), dtype=np.int64)
        score = np.divide(mass.max(axis=1, initial=0), total, out=np.zeros(len(texts)), where=known)
        return [self.model["languages"][b] if k else UNKNOWN for b, k in zip(best, known)], np.clip(score, 0, 1)


def held_out(id_col: str) -> Column:
    """The fifth of the ids that nothing is learned from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """A model from a sample of the rows that are not held out."""
    rows = docs.filter(~held_out(id_col)).filter(F.col(lang_col).isNotNull())
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    named = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), order.alias("h"))
    # Ids alone are ranked; texts are read for those picked, SAMPLE_TEXTS for a language.
    chosen = top_k_by(named.distinct(), ["lang"], [F.col("h"), F.col("id")], SAMPLE_TEXTS).select("id", "lang", "h")
    texts = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = texts.join(F.broadcast(chosen), ["id", "lang"])  # at most SAMPLE_TEXTS ids for each language

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("h", "lang", "text"))))
        model = fit([text for _, _, text in sample], [lang for _, lang, _ in sample])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # One task sees the sample, of a bounded number of texts, and gives one row.
    row = picked.select("h", "lang", "text").repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(row["model"]) if row else fit([], [])


def _labelled(docs: DataFrame, model: dict, text_col: str, pred: str, score: str) -> DataFrame:
    """``docs`` with the predicted language and its score."""
    spark = docs.sparkSession
    name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(model)  # bounded by buckets times languages
    schema = docs.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeping(__name__, _taggers.clear)
        if name not in _taggers:
            _taggers.clear()
            _taggers[name] = Tagger(shared.value)
        tagger = _taggers[name]
        for whole in batches:
            for batch in slices(whole, text_col, SLICE_BYTES):
                languages, scores = tagger.label(batch.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores)], names=[*batch.schema.names, pred, score])

    return docs.mapInArrow(label, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Id, held_out, lang_pred and score of every row."""
    model = train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return _labelled(rows, model, "_text", "lang_pred", "score").drop("_text")


def accepted(docs: DataFrame, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` in which one language holds at least ``least_score`` of the words; `und` goes."""
    pred, score = fresh(docs, "lang_pred", "score")
    labelled = _labelled(docs, train(docs, id_col, text_col, lang_col), text_col, pred, score)
    return labelled.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least_score)).select(*docs.columns)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language": op3_language}
