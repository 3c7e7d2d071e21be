from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from docweave.llm import simhash as S
from docweave.llm.components import components


def plain_print(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """Union-find over all pairs of distinct fingerprints; smallest id of each group."""
    fps = sorted({f for _, f in prints})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 2 and root(a) != root(b):
                up[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted((-1 if i is None else i, f"{f:016x}", least.get(root(f))) for i, f in prints)


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def texts():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.choice([3, 5, 40, 200]))) for _ in range(40)]
    out = base + [b.upper() for b in base[:5]] + [None, "", " \n", "É one", "one", "one two", "ONE TWO", "a\x1cb c\x85d e"]
    for b in base * 3:
        w = b.split()
        w[rnd.randrange(len(w))] = "x"
        out.append(" ".join(w))
    return out


def test_groups(spark):
    cases = [(i, t) for i, t in enumerate(texts())] + [(3, texts()[3]), (None, "one two"), (None, "alone here now then"), (7, texts()[7])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in cases], "doc_id long, text string, fp int")
    want = plain_groups([(i, plain_print(t)) for i, t in cases])
    assert rows(S.simhash_groups(docs)) == want
    assert S.simhash_groups(docs.limit(0)).collect() == []
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {(f, c) for _, f, c in want}
    assert kept.count() == len({c for _, c in groups if c is not None}) + len({f for f, c in groups if c is None})
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c for _, c in groups if c is not None}


def test_links_of_near_words_over_blocks(spark):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for f in fps[:30] * 4:
        fps.append(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps += [0, 1, 3, 7, 2**64 - 1, 2**63]
    signed = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    prints = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {}
    for block_rows in (1, 8192):
        links = components(S.near_links(prints.select("fp").distinct(), 2, block_rows)).collect()
        roots = {r.node: r.root for r in links}
        got[block_rows] = sorted(tuple(sorted(i for i, f in signed if roots.get(f, f) == r)) for r in {roots.get(f, f) for _, f in signed})
    want = {}
    for i, _, c in plain_groups(list(enumerate(fps))):
        want.setdefault(c, []).append(i)
    assert got[1] == got[8192] == sorted(tuple(v) for v in want.values())


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(5, 5)]
    up = list(range(300))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = sorted(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == sorted((n, root(n)) for n in {x for a, b in links if a != b for x in (a, b)})


def test_long_runs_are_cut():
    rnd = np.random.default_rng(0)
    counts = np.array([3, 0, 150_000, 1])
    hashes = rnd.integers(0, 2**64, size=int(counts.sum()), dtype=np.uint64) & rnd.integers(0, 2**64, dtype=np.uint64) | np.uint64(5)
    ends = np.cumsum(counts)
    want = [sum(1 << b for b in range(64) if 2 * int(((hashes[e - n:e] >> np.uint64(b)) & np.uint64(1)).sum()) > n) for e, n in zip(ends, counts)]
    assert S.majority(hashes, counts).tolist() == want
