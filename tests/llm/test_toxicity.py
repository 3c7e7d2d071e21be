from __future__ import annotations

import random

import numpy as np

from docweave.llm import toxicity as T


def test_slopes():
    rng = np.random.default_rng(0)
    raw, scores, grade, weight = np.array([0.3, -0.2]), rng.normal(size=12), rng.integers(0, 3, size=12), rng.random(12)
    value, by_score, by_raw = T.loss(raw, scores, grade, weight)
    for i in range(12):
        moved = scores.copy()
        moved[i] += 1e-6
        assert np.isclose((T.loss(raw, moved, grade, weight)[0] - value) / 1e-6, by_score[i], atol=1e-4)
    for i in range(2):
        moved = raw.copy()
        moved[i] += 1e-6
        assert np.isclose((T.loss(moved, scores, grade, weight)[0] - value) / 1e-6, by_raw[i], atol=1e-4)


def corpus():
    rnd = random.Random(1)
    rows, grades = [], []
    for i in range(1500):
        words = [f"word{rnd.choice('abcdefgh')}{rnd.randrange(50)}" for _ in range(rnd.choice([20, 100]))]
        grade = rnd.choices([0, 1, 2], [8, 2, 1])[0]
        words += rnd.choices(["foulan", "foulish", "foulest", "foulium"], k=grade * 3) + ["awful."] * (grade == 2)
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        grades.append(grade)
    return rows, grades


def test_grades_of_unlabelled_texts(spark):
    rows, grades = corpus()
    extra = [(5000, None), (5001, ""), (None, "wordA1 foulish foulan foulest"), (5002, "worda1 " * 20_000), rows[0]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows + extra], "doc_id long, text string, grade int")  # a clashing extra column
    labels = spark.createDataFrame([(i, int(g < 2), int(g > 0)) for i, g in enumerate(grades) if i % 3] + [(1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = T.severity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    new = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.doc_id % 3 == 0]
    assert np.mean([r.toxic == (grades[r.doc_id] > 0) for r in new]) > 0.99
    assert np.mean([r.grade == grades[r.doc_id] for r in new]) > 0.95
    assert all(0 <= r.severity <= 2 for r in got)
    odd = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 5000}
    assert odd[None].toxic and not odd[5000].toxic and odd[5000].severity == odd[5001].severity and not odd[5002].toxic
    assert T.severity(docs.limit(0), labels).collect() == []


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.severity < 1e-9 for r in T.severity(docs, labels.limit(0)).collect()] == [True, True]
    assert [round(r.severity, 6) for r in T.severity(docs, labels).collect()] == [1, 1]
