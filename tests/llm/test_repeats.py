from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from docweave.llm import repeats as R
from docweave.llm.run_index import RunIndex
from docweave.llm.windows import chosen_places


def plain(docs):
    """Rows (id, text) in order of id -> removed, spans, digest by a set of all strings seen so far."""
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: -10**9 if d[0] is None else d[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=np.int8)
        for s in range(len(raw) - 99):
            w = raw[s:s + 100]
            if w in seen:
                gone[s:s + 100] = 1
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(5)
    words = [f"wörd{i}" for i in range(400)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    shared = [prose(30) for _ in range(5)]
    docs = [prose(rnd.choice([3, 60, 200])) for _ in range(60)]
    docs += docs[:10] + [d[:len(d) // 2] + "#" + d[len(d) // 2:] for d in docs[:20]]
    docs += [prose(40) + " " + rnd.choice(shared) + " " + prose(20) for _ in range(60)]
    docs += ["ab" * 400, "x" * 99, "x" * 100, "x" * 1000, None, "", " ".join([shared[0]] * 5), prose(4000), "same line here \n" * 50]
    rnd.shuffle(docs)
    return list(enumerate(docs))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_the_set_of_strings(spark):
    docs = corpus() + [(None, corpus()[3][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, at int")  # a clashing extra column
    assert rows(R.remove_repeats(frame)) == plain(docs)
    assert R.remove_repeats(frame.limit(0)).collect() == []


def test_hot_places_and_small_chunks(spark, monkeypatch):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(R.remove_repeats(frame, hot_runs=2)) == plain(docs)


def test_long_texts_in_blocks():
    rnd = random.Random(1)
    text = bytes(rnd.choices(b"abcdefgh", k=5000))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text], pa.binary())], names=["row", "raw"])
    covered = {}
    for block in (700, 1 << 20):
        R.HASH_BYTES, old = block, R.HASH_BYTES
        starts = sorted(s for _, _, a, b, _ in R._blocks(batch) for x, y in zip(a.tolist(), b.tolist()) for s in range(x, y + 1))
        covered[block], R.HASH_BYTES = starts, old
    assert covered[700] == covered[1 << 20] == list(range(len(text) - 99))


def test_rows_with_equal_ids(spark):
    text = "".join(random.Random(2).choices("abcdef ", k=400))
    frame = spark.createDataFrame([(1, text), (1, text), (1, text + "!"), (2, text)], "doc_id long, text string")
    got = rows(R.remove_repeats(frame))
    assert len(got) == 4 and got[3][2] == 400 and sorted(r[2] for r in got[:3]) in ([0, 0, 400], [0, 400, 400], [0, 399, 399])


def test_places_depend_on_the_string_alone():
    rnd = np.random.default_rng(0)
    middle = rnd.integers(97, 101, size=300, dtype=np.uint8)
    picks = []
    for left in (0, 57, 1000):
        raw = np.concatenate([rnd.integers(97, 101, size=left, dtype=np.uint8), middle])
        _, h, a, b = chosen_places(raw, np.array([0, len(raw)]))
        picks.append({s - left: v for v, x, y in zip(h.tolist(), a.tolist(), b.tolist()) for s in range(x, y + 1) if s >= left})
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 201


def test_run_index_against_sets():
    rnd = random.Random(0)
    for trial in range(150):
        size = rnd.choice([3, 5, 20])
        texts = [bytes(rnd.choices(b"ab" if trial % 2 else b"abc", k=rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 8))]
        texts += [texts[0], texts[0][:-1] + b"z"] if trial % 3 == 0 else []
        made = RunIndex(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]), 45)
        got, seen = made.seen_before(size), set()
        for text, begin in zip(texts, made.start):
            for i in range(len(text)):
                w = text[i:i + size]
                assert got[begin + i] == (len(w) == size and w in seen)
                if len(w) == size:
                    seen.add(w)
