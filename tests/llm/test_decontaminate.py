from __future__ import annotations

import itertools
import random

import numpy as np

from pyspark.sql import functions as F

from docweave.llm import decontaminate as D


def plain_longest(same):
    best = (0, 0, 0)
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            if 100 * sum(same[a:b]) >= round(100 * D.SHARE) * (b - a) and b - a > best[1]:
                best = (a, b - a, int(sum(same[a:b])))
    return best


def test_longest_stretch():
    rng = np.random.default_rng(0)
    for _ in range(300):
        same = rng.random(rng.integers(1, 30)) < rng.choice([0.3, 0.7, 0.9])
        got, want = D.longest(same), plain_longest(same)
        assert got[1] == want[1] and 100 * got[2] >= 80 * got[1] and got[2] == same[got[0]:got[0] + got[1]].sum()


def words(rnd, n):
    return [f"w{rnd.randrange(4000)}" for _ in range(n)]


def data():
    rnd = random.Random(3)
    items = [(i, words(rnd, rnd.choice([12, 20, 45]))) for i in range(25)] + [(25, words(rnd, 7)), (26, ["a", "b"]), (27, words(rnd, 5))]
    docs = []
    for i in range(300):
        body, truth = words(rnd, rnd.choice([0, 5, 60, 400])), None
        if i % 3 == 0:
            truth, passage = rnd.choice(items[:25])
            passage = list(passage)
            for place in range(4, len(passage), 9):
                passage[place] = "other"
            at = rnd.randrange(len(body) + 1)
            body = body[:at] + passage + body[at:]
        docs.append((i, " ".join(body).upper().replace(" W1", ", (w1"), truth))
    return [(i, " ".join(w)) for i, w in items], docs


def seeded(differ, size, masks):
    return any(not differ & {at + i for i, bit in enumerate(m) if bit == "1"} for m in masks for at in range(size - len(m) + 1))


def test_every_placement_of_differences_has_a_seed():
    for size in range(D.MIN_WORDS, 2 * D.MIN_WORDS):
        for differ in itertools.combinations(range(size), size - -(-4 * size // 5)):
            assert seeded(set(differ), size, D.MASKS)
    for size in range(1, D.MIN_WORDS):
        masks = D.short_masks(size)
        assert {len(m) for m in masks} == {size} and all(m.count("1") >= min(size, D.SHORT_WEIGHT) for m in masks)
        for differ in itertools.combinations(range(size), size - -(-4 * size // 5)):
            assert seeded(set(differ), size, masks)


def plain_stretches(same, least):
    a, size, agree = plain_longest(same)
    if size < max(least, 1):
        return []
    left, right = plain_stretches(same[:a], least), plain_stretches(same[a + size:], least)
    return [(a, size, agree)] + left + [(a + size + x, n, k) for x, n, k in right]


def plain_matches(items, docs):
    """All alignments of all documents and items, words compared one by one."""
    out = []
    for doc_id, text in docs:
        body = (text or "").lower().split()
        for item_id, passage in {(i, tuple((t or "").lower().split())) for i, t in items}:
            every = []
            for shift in range(-len(passage) + 1, len(body)):
                low, high = max(shift, 0), min(shift + len(passage), len(body))
                same = [body[x] == passage[x - shift] for x in range(low, high)]
                every += [(-n, -k, low + a) for a, n, k in plain_stretches(same, min(10, len(passage)))] if passage else []
            used = set()
            for n, k, start in sorted(every):
                if not used & set(range(start, start - n)):
                    used |= set(range(start, start - n))
                    out.append((doc_id, item_id, start, -n, -k))
    return sorted(out, key=repr)


def test_all_rows_against_all_alignments(spark):
    rnd = random.Random(11)
    some = lambda n: [f"v{rnd.randrange(40)}" for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 18, 25, 33])]
    docs = []
    for i in range(150):
        body = some(rnd.choice([0, 4, 30]))
        for _ in range(rnd.choice([0, 1, 2])):  # passages held twice are two rows
            passage = list(rnd.choice(items)[1])
            for at in rnd.sample(range(len(passage)), min(len(passage), rnd.choice([0, 1, 2, 3, 5]))):
                passage[at] = "changed"
            body += passage + some(rnd.choice([0, 3]))
        docs.append((i, " ".join(body)))
    docs += [(900, None), (901, ""), docs[3]]
    asked = [(i, " ".join(w)) for i, w in items]
    asked += [(70, asked[9][1].upper()), (71, asked[12][1]), asked[12], (72, None), (73, "")]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    bench = spark.createDataFrame(asked, "item_id int, text string")
    rows = D.matches(frame, bench)
    assert [f.dataType.simpleString() for f in rows.schema] == ["int", "int", "bigint", "bigint", "bigint"]
    got = sorted((tuple(r) for r in rows.collect()), key=repr)

    def tied(found):
        # Of stretches of equal length in one alignment any may be taken: compare what ties can't change.
        return sorted({(d, i, n) for d, i, _, n, _ in found if n == max(m for e, j, _, m, _ in found if (e, j) == (d, i))})

    want = plain_matches(asked, docs)
    assert tied(got) == tied(want) and {r[:2] for r in got} == {r[:2] for r in want}
    own, hold = {d: (t or "").lower().split() for d, t in docs}, dict(asked)
    for d, i, start, n, k in got:
        assert any(sum(x == y for x, y in zip(own[d][start:start + n], hold[i].lower().split()[at:at + n])) == k for at in range(len(hold[i].split()) - n + 1)) and 5 * k >= 4 * n


def test_planted_passages_are_found_and_others_left(spark):
    items, docs = data()
    bench = spark.createDataFrame(items + [(90, items[0][1]), (91, None), (92, "")], "item_id long, text string")
    short, five = items[25][1], items[27][1].split()
    extra = [(500, None, None), (501, "", None), (None, items[3][1], None), (502, short + " tail", None), (503, " ".join(short.split()[:6]), None), (504, "a b", None), (505, items[7][1] + " x" * 50_000, None),
             (506, "so a b it goes", None), (507, "x " + " ".join(five[:2] + ["other"] + five[3:]) + " y", None), (508, " ".join(five[:2] + ["one", "two"] + five[4:]), None)]
    frame = spark.createDataFrame([(i, t, 1) for i, t, _ in docs + extra], "doc_id long, text string, start int")  # a clashing extra column
    got = {(r.doc_id, r.item_id) for r in D.matches(frame, bench).collect()}
    sure = {(i, t) for i, _, t in docs if t is not None} | {(None, 3), (502, 25), (505, 7), (507, 27), (504, 26)}
    assert got == sure | {(506, 26)} | {(i, 90) for i, t in sure if t == 0}
    kept = D.clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in docs + extra} - {i for i, _ in sure}
    assert D.matches(frame.limit(0), bench).collect() == [] and D.matches(frame, bench.limit(0)).collect() == []
    named = D.matches(frame.withColumn("doc_id", F.col("doc_id").cast("string")), bench.withColumn("item_id", F.col("item_id").cast("string")))
    assert {(r.doc_id and int(r.doc_id), int(r.item_id)) for r in named.collect()} == got


def test_blocks_give_the_same(spark, monkeypatch):
    items, docs = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    one = sorted(map(tuple, D.matches(frame, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 1000)
    assert sorted(map(tuple, D.matches(frame, bench).collect())) == one


def test_a_task_drops_what_other_modules_left_in_its_worker():
    from docweave.llm import common

    one, two = {"a": 1}, {"b": 2}
    common.keeping("one", one.clear)
    common.keeping("one", one.clear)
    assert one
    common.keeping("two", two.clear)
    assert not one and two
    common.keeping("three", dict)
    assert not two
