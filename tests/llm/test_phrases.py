from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docweave.llm import phrases as P


def plain(docs, least, top):
    """Rows by counting every run of one to five words."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 6):
                counts[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, held in counts.items():
        often = {w: a for w, a in held.items() if a >= least}
        inside = {w[i:i + n] for w, a in often.items() for n in range(2, len(w)) for i in range(len(w) - n + 1) if a >= often[w[i:i + n]]}
        rows = []
        for w, a in often.items():
            if len(w) < 2 or w in inside:
                continue
            score, _, left, right = min((1000 * a * total[lang] // (often[w[:k]] * often[w[k:]]), k, often[w[:k]], often[w[k:]]) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, rank, phrase.decode(), -a, left, right, total[lang], -s) for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus():
    rnd = random.Random(4)
    words = ["New", "york", "of", "THE", "é", "ÉCOLE", "a-b", "x\x00y", "city", "z"] + [f"w{i}" for i in range(60)]
    often = [1 / (i + 1) for i in range(len(words))]
    marks = [" "] * 30 + [". ", "\n", ", ", "\t", "  ", "!", "\r\n", "\x0b"]
    prose = lambda n: "".join(w + rnd.choice(marks) for w in rnd.choices(words, often, k=n))
    docs = [(prose(rnd.choice([1, 30, 120])) + rnd.choice(["", " in New York City today", " one two three four five six"]), rnd.choice(["en", "en", "de", None])) for _ in range(200)]
    return docs + [(None, "en"), ("", "fr"), (" .,\n", "es"), ("ha " * 300, "en"), (prose(4000), "de"), ("same line here\n" * 50, None)]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least, top", [(20, 2000), (7, 5)])
def test_equals_counting_all(spark, least, top):
    docs = corpus()
    frame = spark.createDataFrame([(t, g, 1, 2) for t, g in docs], "text string, lang string, n int, phrase int").repartition(5)  # clashing extra columns
    got, want = rows(P.collocations(frame, least=least, top=top)), plain(docs, least, top)
    assert len(want) > 10 and got == want


def test_empty(spark):
    frame = spark.createDataFrame([(None, "en"), ("", None)], "text string, lang string")
    assert rows(P.collocations(frame)) == [] and rows(P.collocations(frame.limit(0))) == []
    assert rows(P.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string"))) == []


def test_summary_keeps_its_guarantee():
    """Whatever the order and cuts: lower bounds are right, the loss is within mass / (capacity + 1), frequent keys survive."""
    rnd = np.random.default_rng(1)
    for trial in range(30):
        keys = np.concatenate([rnd.integers(0, 5000, 20_000), np.repeat(rnd.integers(0, 5000, 20), 100)])
        rnd.shuffle(keys)
        least = 60
        summary = P.Summary(len(keys) // least + 1)
        for part in np.array_split(keys, rnd.integers(1, 40)):
            summary.merge(*np.unique(part, return_counts=True))
        true = Counter(keys.tolist())
        assert len(summary.keys) <= summary.capacity and summary.lost <= len(keys) // (summary.capacity + 1) < least
        assert all(true[k] - summary.lost <= c <= true[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))
        assert {k for k, n in true.items() if n >= least} <= set(summary.survivors(least).tolist())


def test_many_partitions_agree(spark, monkeypatch):
    """The number of hash partitions changes nothing."""
    docs = corpus()[:80]
    texts = spark.createDataFrame([((t or "").encode(), g or "und") for t, g in docs], "text binary, lang string")
    _, mass = P.masses(texts)
    one = rows(P.frequent(texts, mass, 10))
    monkeypatch.setattr(P, "PART_RUNS", 1 << 10)
    assert P._parts(int(mass.sum())) > 8
    assert rows(P.frequent(texts, mass, 10)) == one != []


def test_long_texts_in_pieces(monkeypatch):
    text = ("Ab cd. Ef gh " * 50).encode()
    whole = [w for part in P.words_of(text) for w in part]
    monkeypatch.setattr(P, "SLICE_BYTES", 40)
    parts = list(P.words_of(text))
    assert len(parts) > 5 and [w for part in parts for w in part] == whole
