from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from docweave.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts():
    rnd = random.Random(5)
    out = [None, "", " \t\n", "a", "w " * 8, "w " * 9, "é# $%\n é\n é#\n\n\x0b x", "a b c d e f g h a b c d e f g h i", "日本 \xa0x " * 30]
    for _ in range(60):
        out.append(" ".join(rnd.choice(["a", "b", "cc", "\n", "#d"]) for _ in range(rnd.choice([10, 30, 90]))))
    for _ in range(400):
        out.append(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) + rnd.choice(["", "", "", "%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%"]))
    return out


def test_base_columns(spark):
    rows = [(i, t, "en", 1) for i, t in enumerate(texts())] + [(None, "a b", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")  # a clashing extra column
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(0, 0)], "doc_id long, quality int")
    got = {r.doc_id: tuple(r)[1:7] for r in Q.quality_rules(docs, labels).collect()}
    assert got == {i: plain(t) for i, t, _, _ in rows}
    none = Q.quality_rules(docs.limit(0), labels.limit(0))
    assert none.collect() == []


def test_tail(spark):
    cases = [(0, 1), (0, 900), (3, 1000), (5, 1000), (40, 9000), (400, 90000), (2, 100)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", Q.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).collect()
    for r in got:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.005) + (r.n - j) * math.log(0.995)) for j in range(r.k + 1)) if r.k <= r.n * 0.005 else 1
        assert math.isclose(r.p, want, rel_tol=1e-9)


def test_path_is_nested():
    assert sorted(Q.STEPS) == sorted((rule, cut) for rule, (_, cuts) in Q.RULES.items() for cut in cuts)
    for rule, (_, cuts) in Q.RULES.items():
        at = [cut for cut in Q.settings(rule) if cut is not None]
        assert at == sorted(at, reverse=True) and at[-1] == cuts[0]


MEASURED = "id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def plain_cutoffs(rows, alpha=Q.ALPHA, delta=Q.DELTA):
    """Setting of each stratum by walking the path."""
    strata = {}
    for r in rows:
        strata.setdefault(r[1], []).append({"symbols": r[4] / max(r[3], 1), "dup_lines": r[6] / max(r[5], 1), "repeats": r[7] / max(r[2], 1), "long_words": r[3] / max(r[2], 1)})
    out = {}
    for stratum, texts in strata.items():
        at = {}
        for rule, cut in Q.STEPS:
            tried = {**at, rule: cut}
            k, n = sum(any(m[r] > c for r, c in tried.items()) for m in texts), len(texts)
            if sum(math.comb(n, j) * alpha ** j * (1 - alpha) ** (n - j) for j in range(k + 1)) > delta / len(strata):
                break
            at = tried
        if at:
            out[stratum] = tuple(at.get(rule) for rule in Q.RULES)
    return out


def test_cutoffs_follow_the_path(spark):
    rnd = random.Random(9)
    rows = []
    for stratum, n, symbols, chars in [("=a", 230, 0, 550), ("=b", 600, 0.004, 550), ("=c", 900, 0.05, 550), ("=d", 100, 0, 550), ("", 400, 0, 950)]:
        for _ in range(n):
            rows.append((len(rows), stratum, 100, chars, int(rnd.random() < symbols) * rnd.choice([30, 200, 400]), 10, rnd.choice([0, 0, 0, 1]) if stratum == "=b" else 0, 0, False))
    measured = spark.createDataFrame(rows + [(len(rows), "=a", 1, 9, 9, 9, 9, 9, True)], MEASURED)
    labels = spark.createDataFrame([(i, 1) for i in range(len(rows) + 1)], "doc_id long, quality int")
    got = {r[0]: tuple(r)[1:] for r in Q.cutoffs(measured, labels).collect()}
    assert got == plain_cutoffs(rows)
    # Few labels give none; 230 without a hit go through the whole path; a hit group ends it early.
    assert "=d" not in got and got["=a"] == tuple(min(cuts) if rule != "long_words" else 6.0 for rule, (_, cuts) in Q.RULES.items())
    assert got[""][3] == 10.0 and got["=b"][1] >= 0.1


def test_labels_that_contradict_are_not_good(spark):
    rows = [(i, "=a", 100, 550, 0, 10, 0, 0, False) for i in range(230)]
    labels = spark.createDataFrame([(i, 1) for i in range(230)] + [(i, 0) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    assert Q.cutoffs(spark.createDataFrame(rows, MEASURED), labels).collect() == []


def test_bound_holds_on_fresh_texts(spark):
    """Over many draws of labels, the true share of good texts rejected is above the bound at most a share DELTA of the time."""
    rnd, rows = random.Random(3), []
    share = {10.0: 0.001, 9.0: 0.019, 8.0: 0.021, 7.0: 0.3}  # true share of good texts above a mean word length
    for draw in range(60):
        for _ in range(600):
            u = rnd.random()
            chars = next((int(cut * 100) + 1 for cut, p in share.items() if u < p), 500)
            rows.append((len(rows), f"={draw}", 100, chars, 0, 10, 0, 0, False))
    labels = spark.createDataFrame([(i, 1) for i in range(len(rows))], "doc_id long, quality int")
    got = Q.cutoffs(spark.createDataFrame(rows, MEASURED), labels, delta=0.05 * 60).collect()
    assert len(got) == 60 and sum((r.long_words or 99) <= 8.0 for r in got) <= 6
