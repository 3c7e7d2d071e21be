from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from docweave.llm import language as L


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    scores, transition = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    real = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], dtype=bool)
    found, pairs = L.marginals(scores, real, transition)
    want_pairs = np.zeros((3, 3))
    for c in range(3):
        n = int(real[c].sum())
        paths = list(itertools.product(range(3), repeat=n))
        weight = np.array([np.exp(sum(scores[c, t, p[t]] for t in range(n)) + sum(transition[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        for t in range(n):
            for k in range(3):
                assert np.isclose(found[c, t, k], sum(w for w, p in zip(weight, paths) if p[t] == k))
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    assert np.allclose(pairs, want_pairs)


def test_grams_are_those_of_each_word():
    alone = [sorted(L.gram_features([w])[0].tolist()) for w in ("abc", "é", "", "wörter")]
    feature, at = L.gram_features(["abc", "é", "", "wörter"])
    assert [sorted(feature[a:b].tolist()) for a, b in zip(at, at[1:])] == alone


def make(rnd, kind, n):
    parts = {"xx": ["ka", "ro", "mi"], "yy": ["sch", "ung", "ver"]}[kind]
    return " ".join("".join(rnd.choices(parts, k=3)) for _ in range(n))


def test_languages(spark):
    rnd = random.Random(0)
    rows = [(i, make(rnd, k, rnd.choice([20, 200])) + rnd.choice([" 12 !!", ""]), k, 1) for i, k in enumerate(rnd.choices(["xx", "yy"], k=300))]
    rows += [(900, None, "xx", 1), (901, "", None, 1), (902, "12 !? 3", "yy", 1), (None, make(rnd, "xx", 30), "yy", 1), (903, make(rnd, "yy", 5000), None, 1), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")  # a clashing extra column
    got = L.identify(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows if i is not None}
    truth = {i: k for i, _, k, _ in rows[:300]}
    assert all(r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1 for r in got if r.doc_id in truth)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id not in truth}
    assert odd[900] == odd[901] == odd[902] == ("und", 0.0) and odd[None][0] == "xx" and odd[903][0] == "yy"
    assert L.identify(docs.limit(0)).collect() == []
    nothing = docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("false").union(docs.filter("lang is null"))
    assert {r.lang_pred for r in L.identify(nothing).collect()} == {"und"}


def test_code_switched_words():
    rnd = random.Random(4)
    texts = [make(rnd, k, 80) for k in ("xx", "yy") * 40] + [make(rnd, "xx", 30) + " " + make(rnd, "yy", 20) for _ in range(20)]
    model = L.fit(texts, ["xx", "yy"] * 40 + ["xx"] * 20)
    tagger = L.Tagger(model)
    lang, score = tagger.label([make(rnd, "xx", 30) + " " + make(rnd, "yy", 20)])
    assert lang == ["xx"] and abs(score[0] - 0.6) < 0.05
