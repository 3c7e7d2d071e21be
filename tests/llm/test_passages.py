from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from docweave.llm import passages as P


def plain(docs):
    """Rows (id, text) in order of id -> words, removed, digest by a set of all windows seen so far."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - P.WINDOW + 1):
            w = tuple(words[s:s + P.WINDOW])
            if w in seen:
                gone[s:s + P.WINDOW] = [True] * P.WINDOW
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=5, many=60):
    rnd = random.Random(seed)
    words = [f"wörd{i}" for i in range(300)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    shared = [prose(n) for n in (6, 12, 19, 20, 21, 26, 60)]
    docs = [prose(rnd.choice([3, 19, 20, 60, 200])) for _ in range(many)]
    docs += docs[:10]
    for d in docs[:many // 2]:  # near copies
        w = d.split()
        for _ in range(len(w) // 30):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        docs.append("\t\n ".join(w))
    docs += [prose(rnd.choice([0, 5, 40])) + " " + rnd.choice(shared) + " " + prose(20) for _ in range(2 * many)]
    # Two words only: seeds repeat everywhere, with ties.
    docs += [" ".join(rnd.choices("ab", k=60)) for _ in range(20)]
    docs += ["a " * 200, "a " * 19, "a " * 20, None, "", " \n", " ".join([shared[6]] * 5), "same line here \n" * 50]
    rnd.shuffle(docs)
    return list(enumerate(docs))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_the_set_of_windows(spark):
    docs = corpus() + [(None, corpus()[3][1]), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, at int, h string").repartition(5)  # clashing extra columns
    assert rows(P.remove_passages(frame)) == plain(docs)


def test_every_seed_hot(spark, monkeypatch):
    docs = corpus(6, 20)
    monkeypatch.setattr(P, "hot_seeds", lambda rows: np.sort(np.array([r["h"] for r in rows.mapInArrow(P.find, "h long, whole long, id long, at long").filter("h != 0").collect()], dtype=np.int64))[::2])
    assert rows(P.remove_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == plain(docs)


def test_hot_line_with_different_surroundings(spark):
    """One line of 25 words in every document: the first keeps it, all others lose just it."""
    rnd = random.Random(1)
    line = " ".join(f"l{i}" for i in range(25))
    docs = [(i, " ".join(f"{rnd.random()}" for _ in range(30)) + f" {line} " + " ".join(f"{rnd.random()}" for _ in range(30))) for i in range(400)]
    got = P.remove_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert sorted((r["doc_id"], r["n_removed"]) for r in got.collect()) == [(i, 25 if i else 0) for i in range(400)]


def test_long_texts_in_pieces(spark, monkeypatch):
    rnd = random.Random(3)
    half = " ".join(rnd.choices("abcdefgh", k=4000))
    docs = [(1, f"{half} x {half}"), (2, f"y {half[:5000]}"), (3, "z" * 30_000)]
    want = plain(docs)
    chunks = P.word_chunks
    monkeypatch.setattr(P, "HASH_BYTES", 500)
    monkeypatch.setattr(P, "word_chunks", lambda data, most=300: chunks(data, most))
    for i, text in docs:
        words, ends, _, base = P.word_blocks([text.encode()])
        block, _, _, first, last, _ = P.occurrences(words, ends)
        shift = (base - ends[:-1])[block]
        starts = [s for a, b in zip((first + shift).tolist(), (last + shift).tolist()) for s in range(a, b + 1)]
        assert sorted(starts) == list(range(max(0, len(text.split()) - P.WINDOW + 1)))  # every window once
        assert len(ends) > 10 or i > 1
    none = np.zeros(0, dtype=np.int64)
    assert [P.kept_words(t.encode(), none, none)[0] for _, t in docs] == [w[1] for w in want]
    monkeypatch.undo()
    assert rows(P.remove_passages(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_repeated_rows_and_other_ids(spark):
    text = " ".join(map(str, range(40)))
    got = rows(P.remove_passages(spark.createDataFrame([(1, text), (1, text), (1, text + " x"), (0, "")], "doc_id int, text string").repartition(3)))
    assert [r[:3] for r in got][0] == (0, 0, 0)
    assert sorted(r[2] for r in got if r[1] == 40) in ([0, 0], [40, 40])  # equal rows with equal ids are one text
    assert P.remove_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(TypeError):
        P.remove_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
