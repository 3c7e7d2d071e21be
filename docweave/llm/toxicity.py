"""Toxicity as ordinal regression: severity grades by cumulative links over sparse text features.

The grades 0, 1, ... share one weight per feature and differ by ordered thresholds: P(grade <= k) is the logistic
function of threshold k less the text's score, and a text's severity is its expected grade. A text's features are its
distinct words and the words' beginnings of PREFIXES letters, counted once for each distinct word. The classifier is
fitted on a sample of at most SAMPLE_TEXTS labelled texts per grade, weighted to stand for all labelled texts. Of the
sample's words, the FEATURES whose share among grades above 0 and grade 0 differs most (likelihood ratio) are kept; the
weights are fitted in one task, which sees of each text its kept features only.

A labelled text's grade is 0 if it is not toxic, 1 if it is toxic and otherwise of good quality, 2 if it is of neither.

Result by case: a null or empty text has the severity of a text without features; where no text is labelled, or all have
one grade, the severity is 0, or that grade; a text labelled more than once has its highest grade; a null id joins no
label; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docweave.operators.keyed import top_k_by

from .common import slices, store, table

GRADES, PREFIXES = 3, (4, 5, 6)
FEATURES, LEAST_TEXTS, SAMPLE_TEXTS = 4096, 5, 8000
STEPS, RATE, DECAY = 400, 0.1, 1e-4
CACHE_PIECES = 1_000_000

_LETTERS = re.compile(r"[^\W\d_]+")
_scorers: dict[str, "Scorer"] = {}


def features_of(word: str) -> list[str]:
    """The word, and its beginnings, marked as such."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


def grade_table(labels: DataFrame, id_col: str, toxic_col: str, quality_col: str) -> DataFrame:
    toxic = F.when(F.col(toxic_col) == 0, 0).when(F.col(toxic_col) == 1, F.when(F.col(quality_col) == 0, 2).otherwise(1))
    return labels.select(F.col(id_col).alias("id"), toxic.alias("grade")).filter("id is not null and grade is not null").groupBy("id").agg(F.max("grade").alias("grade"))


def choose_features(graded: DataFrame) -> list[str]:
    """The features of ``graded(text, grade)`` that tell grades above 0 from grade 0; at most FEATURES of them."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                counts = (Counter(), Counter())
                for text, grade in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist()):
                    counts[grade > 0].update(words_of(text))
                every = list(counts[0].keys() | counts[1].keys())
                if every:
                    yield pa.RecordBatch.from_arrays([pa.array(every), *(pa.array([c[w] for w in every], pa.int64()) for c in counts)], names=["word", "clean", "toxic"])

    words = graded.mapInArrow(tally, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    starts = [F.when(F.char_length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES]
    parts = words.select(F.explode(F.array_compact(F.array(F.col("word"), *starts))).alias("feature"), "clean", "toxic")
    counted, _ = store(parts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= LEAST_TEXTS))
    total = counted.agg(F.sum("clean").alias("all_clean"), F.sum("toxic").alias("all_toxic"))
    both, share = F.col("clean") + F.col("toxic"), F.col("all_toxic") / (F.col("all_clean") + F.col("all_toxic"))

    def part(seen, wanted):
        return F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)

    ratio = part(F.col("toxic"), both * share) + part(F.col("clean"), both * (1 - share))
    best = counted.join(F.broadcast(total)).filter("all_toxic > 0 and all_clean > 0").orderBy(ratio.desc(), "feature").limit(FEATURES)
    return [r[0] for r in best.select("feature").collect()]


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, then positive steps."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss(raw: np.ndarray, scores: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted negative log-likelihood and its slopes by score and by raw threshold."""
    cuts = np.concatenate([[-np.inf], thresholds(raw), [np.inf]])
    upper, lower = _logistic(cuts[grade + 1] - scores), _logistic(cuts[grade] - scores)
    upper[grade == len(raw)], lower[grade == 0] = 1.0, 0.0
    chance = np.maximum(upper - lower, 1e-12)
    by_score = -weight * (upper + lower - 1)
    by_cut = np.zeros(len(raw) + 2)
    np.add.at(by_cut, grade + 1, -weight * upper * (1 - upper) / chance)
    np.add.at(by_cut, grade, weight * lower * (1 - lower) / chance)
    by_cut = by_cut[1:-1]
    by_raw = np.cumsum(by_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
    return float(-(weight * np.log(chance)).sum()), by_score, by_raw


def fit(text: np.ndarray, feature: np.ndarray, count: np.ndarray, grade: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and raw thresholds from triples (text, feature, count), by Adam on the whole sample."""
    weight = weight / weight.sum()
    parameters = np.zeros(size + GRADES - 1)
    share = float((weight * (grade == 0)).sum())
    parameters[size] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, STEPS + 1):
        scores = np.bincount(text, weights=parameters[feature] * count, minlength=len(grade))
        _, by_score, by_raw = loss(parameters[size:], scores, grade, weight)
        slope = np.concatenate([np.bincount(feature, weights=by_score[text] * count, minlength=size), by_raw]) + DECAY * parameters
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        parameters -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return parameters[:size], parameters[size:]


class Scorer(dict):
    """Piece of text -> its words; only words that weigh something are kept."""

    def __init__(self, model: dict):
        super().__init__()
        self.weights, self.of_word = model["weights"], {}
        self.cuts = thresholds(model["thresholds"])

    def __missing__(self, piece: str) -> tuple[str, ...]:
        words = []
        for word in set(_LETTERS.findall(piece)):
            value = self.of_word.get(word)
            if value is None:
                value = sum(self.weights.get(f, 0.0) for f in features_of(word))
                if value:
                    self.of_word[word] = value
            if value:
                words.append(word)
        self[piece] = found = tuple(words)
        return found

    def chances(self, texts: list[str | None]) -> np.ndarray:
        """P(grade) of every text."""
        if len(self) > CACHE_PIECES:
            self.clear()
            self.of_word.clear()
        pieces = [set((t or "").lower().split()) for t in texts]
        words = [set(chain.from_iterable(map(self.__getitem__, p))) for p in pieces]
        scores = np.array([sum(map(self.of_word.__getitem__, sorted(w))) for w in words])
        below = np.concatenate([np.zeros((len(texts), 1)), _logistic(self.cuts[None, :] - scores[:, None]), np.ones((len(texts), 1))], axis=1)
        return np.diff(below, axis=1)


def train(docs: DataFrame, grades: DataFrame, id_col: str, text_col: str) -> dict:
    """A model from a sample of the labelled rows of ``docs``."""
    present = grades.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    sizes = {r["grade"]: r["n"] for r in present.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:  # nothing to tell apart
        only = max(sizes, default=0)
        return {"weights": {}, "thresholds": np.array([-40.0 if only > 0 else 40.0, *([-40.0 if only > 1 else np.log(80.0)] * (GRADES - 2))])}
    # Ids alone are ranked; texts are read for those picked, at most SAMPLE_TEXTS for a grade, without a shuffle.
    chosen = top_k_by(present.withColumn("h", F.xxhash64("id", F.lit("sample"))), ["grade"], [F.col("h"), F.col("id")], SAMPLE_TEXTS)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample, _ = store(texts.join(F.broadcast(chosen), "id").select("h", "grade", "text"))
    vocabulary = choose_features(sample)
    number = {f: i for i, f in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [Counter(number[f] for w in words_of(t) for f in features_of(w) if f in number) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("grade"), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                                                 names=["h", "grade", "feature", "count"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((h, g, f, n) for b in batches for h, g, f, n in zip(*(b.column(c).to_pylist() for c in ("h", "grade", "feature", "count")))), key=lambda r: r[:2])
        grade = np.array([r[1] for r in rows])
        text = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        feature, times = (np.array([x for r in rows for x in r[k]], dtype=np.int64) for k in (2, 3))
        sampled = Counter(grade.tolist())
        weight = np.array([sizes[g] / sampled[g] for g in grade.tolist()])
        weights, raw = fit(text, feature, times, grade, weight, len(vocabulary))
        model = {"weights": {f: float(w) for f, w in zip(vocabulary, weights)}, "thresholds": raw}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    counted = sample.mapInArrow(count, "h long, grade int, feature array<int>, count array<int>")
    return pickle.loads(counted.repartition(1).mapInArrow(learn, "model binary").first()["model"])


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", quality_col: str = "quality") -> DataFrame:
    """Id, expected grade, most likely grade, whether a grade above 0 is likelier than not, and its chance, of every row."""
    spark = docs.sparkSession
    grades, _ = store(grade_table(labels, id_col, toxic_col, quality_col))
    model = train(docs, grades, id_col, text_col)
    name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(model)  # at most FEATURES weights
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                chance = _scorers[name].chances(batch.column("text").to_pylist())
                above = 1 - chance[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(chance @ np.arange(GRADES)), pa.array(chance.argmax(axis=1), pa.int32()), pa.array(above > 0.5), pa.array(above)],
                                                 names=[id_col, "severity", "grade", "toxic", "p_toxic"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"`{id_col}` {kind}, severity double, grade int, toxic boolean, p_toxic double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
