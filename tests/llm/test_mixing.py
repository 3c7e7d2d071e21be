from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.llm import mixing as M


def plain_targets(sizes):
    """Sources in order -> targets, reshared until none is above three times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)


def rows():
    rnd = random.Random(2)
    out = []
    for i in range(1200):
        source = rnd.choice(["a", "b", "é", None, "c", "hot", "hot", "hot", "hot"])
        out.append((i, " \t".join(["w"] * rnd.choice([1, 2, 5, 30, 200])), source, 5))
    return out + [(None, "x y", "a", 1), (2000, None, "a", 1), (2001, "", "only empty", 1), (7, out[7][1], out[7][2], 5)] + [(3000 + i, "same size here", "c", 1) for i in range(400)]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 16)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size int")  # a clashing extra column
    got = M.source_mix(docs).collect()
    assert len(got) == len(data)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in data]
    total = {s: sum(n for n, d in zip(size, data) if d[2] == s) for s in {d[2] for d in data}}
    target = plain_targets(total)
    source = {i: s for i, _, s, _ in data}
    taken = {}
    for r in got:
        s = "a" if r.doc_id is None else source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in total)
    assert sorted(map(str, got)) == sorted(map(str, M.source_mix(docs.repartition(7)).collect()))
    mixed = M.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.select("text").collect()) == sum(taken.values())
    assert M.source_mix(docs.limit(0)).collect() == [] and M.mixed_rows(docs.limit(0)).collect() == []


def test_two_margins(spark):
    cells = spark.createDataFrame([("=a", "=x", 100.0), ("=a", "=y", 50.0), ("=b", "=x", 30.0), ("=b", "=y", 20.0)], "source string, lang string, tokens double")
    targets = {"source": spark.createDataFrame([("=a", 120.0), ("=b", 80.0)], "source string, target double"), "lang": spark.createDataFrame([("=x", 90.0), ("=y", 110.0)], "lang string, target double")}
    got = M.entropy_rates(cells, targets)
    for margin, wanted in targets.items():
        sums = {r[0]: r[1] for r in got.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("rate"))).collect()}
        assert sums == {r[0]: pytest.approx(r[1], rel=1e-6) for r in wanted.collect()}
    rate = {(r.source, r.lang): r.rate for r in got.collect()}
    assert rate["=a", "=x"] * rate["=b", "=y"] == pytest.approx(rate["=a", "=y"] * rate["=b", "=x"], rel=1e-6)  # an exponential tilt


def test_contradicting_margins(spark):
    cells = spark.createDataFrame([("=a", "=x", 10.0)], "source string, lang string, tokens double")
    targets = {"source": spark.createDataFrame([("=a", 12.0)], "source string, target double"), "lang": spark.createDataFrame([("=x", 9.0)], "lang string, target double")}
    with pytest.MonkeyPatch.context() as patch, pytest.raises(ValueError):
        patch.setattr(M, "MAX_STEPS", 4)
        M.entropy_rates(cells, targets)
