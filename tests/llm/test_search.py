from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docweave.llm import search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    """(item, rank, id, score) by scoring every document."""
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, words = len(held), sum(n for _, _, n in held)
    seen = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 50 + 50 * n * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * seen[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i, s))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(200)] + ["Über", "ÉTÉ", "a b", "naïve", "X9"]
    often = [1 / (i + 1) for i in range(len(words))]
    prose = lambda n: " ".join(rnd.choices(words, often, k=n))
    docs = [prose(rnd.choice([1, 5, 40, 200])) for _ in range(300)]
    docs += docs[:40] + [None, "", " .,;\n", "w1-w2_W3\x00w4", "w0 " * 500, prose(5000)]
    items = [(i, prose(rnd.choice([1, 8, 30]))) for i in range(30)] + [(30, None), (31, "?!"), (32, "unseen term"), (3, "w1 w1 W1"), (None, "w2 w5")]
    return list(enumerate(docs)), items


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("top", [1, 7, 1000])
def test_equals_scoring_all(spark, monkeypatch, top):
    docs, items = corpus()
    docs += [(None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, query int").repartition(3)  # clashing extra columns
    bench = spark.createDataFrame(items, "item_id int, text string")
    assert rows(S.ranked(frame, bench, top=top)) == plain(docs, items, top)


def test_search_of_many_small_shards():
    """The best are carried from shard to shard; ties go by id."""
    docs, items = corpus()
    queries = S.Queries([(i, t or "") for i, t in items])
    docs = [(i, (t or "").encode()) for i, t in docs]
    random.Random(1).shuffle(docs)
    best, want = S.Best(len(items), 5), {}
    for at in range(0, len(docs), 37):
        part = docs[at: at + 37]
        lengths, term, doc, often = queries.postings([t for _, t in part])
        score = (term % 5 + 1) * often
        S.search(S.Shard(term, doc, score, len(part)), np.array([i for i, _ in part]), queries.terms, best)
        for q, own in enumerate(queries.terms):
            for t, d, s in zip(term.tolist(), doc.tolist(), score.tolist()):
                if t in own:
                    want[q, part[d][0]] = want.get((q, part[d][0]), 0) + s
    expected = [(q, s, i) for q in range(len(items)) for s, i in sorted(((s, i) for (x, i), s in want.items() if x == q), key=lambda x: (-x[0], x[1]))[:5]]
    assert list(zip(best.query.tolist(), best.score.tolist(), best.id.tolist())) == expected


def test_range_maximum():
    rnd = np.random.default_rng(0)
    term = np.sort(rnd.integers(0, 6, 200))
    doc = np.concatenate([np.sort(rnd.choice(300, n, replace=False)) for n in np.bincount(term)])
    score = rnd.integers(1, 50, 200)
    shard = S.Shard(term, doc, score, 300)
    begin = np.searchsorted(term, np.arange(7))
    low, high = zip(*((a + x, a + y) for a, b in zip(begin, begin[1:]) for x in range(b - a) for y in range(x + 1, b - a + 1)))
    got = shard.greatest(np.array(low), np.array(high))
    assert score[got].tolist() == [score[a:b].max() for a, b in zip(low, high)]
    assert all(a <= g < b for g, a, b in zip(got.tolist(), low, high))


def test_pieces_empty_tables_and_other_ids(spark, monkeypatch):
    some = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    none, bench = some.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(S.ranked(none, bench)) == [] and rows(S.ranked(some, bench.limit(0))) == []
    assert [r[:3] for r in rows(S.ranked(some, bench))] == [(1, 1, 1)]
    with pytest.raises(TypeError):
        S.ranked(some.withColumn("doc_id", some["text"]), bench)
    chunks = S.word_chunks
    monkeypatch.setattr(S, "word_chunks", lambda data, most: chunks(data, 7))
    assert [t for part in S.terms("Ab cd-EF ghi é x 12".encode()) for t in part] == [t.encode() for t in plain_terms("Ab cd-EF ghi é x 12")]
