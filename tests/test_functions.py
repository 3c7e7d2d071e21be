"""Literal cases of the shared expressions."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docweave.functions import codes, dates, revision, text
from docweave.operators import cleaning as C
from docweave.plans.allocation import diagnosis, register_outcome
from docweave.operators.evidence import classify_outcome
from docweave.sources.catalogs import comment_merge, path_extract


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


CASES = [
    (text.norm, ["  São–Paulo  x ", "áb", None, "ß"], ["SAO-PAULO X", "AB", "", "SS"]),
    (text.canon_key, ["de - 01 . a _ b", " x-1"], ["DE-01.A_B", "X-1"]),
    (text.loose_key, ["DE-01.a/b"], ["DE01AB"]),
    (text.canonical_tag, ["TK-0007 a", "000", "P-10"], ["TK7A", "0", "P10"]),
    (text.punct_tag, ["nt-V/001_a", " -M--1- "], ["V-001-A", "M-1"]),
    (revision.normal_revision, ["Rev. B", "revisão Y", " a z "], ["B", "Y", "AZ"]),
    (lambda c: revision.revision_rank(revision.normal_revision(c)), ["0", "A", "Z", "AA", "H", "J", "A3", "I", "", "1"], [0, 1000, 24000, 25000, 8000, 9000, 1003, -1, -1, -1]),
    (revision.revision_next, ["0", "A", "H", "N", "Z", "AZ", "ZZ", "A1", "I"], ["A", "B", "J", "P", "AA", "BA", "AAA", "", ""]),
    (revision.status_kind, ["Em Análise", "Sem comentários", "x"], ["analysis", "advance", "unknown"]),
    (dates.date_text, ["31/12/99", "31/02/2024", "2024-02-29", "45292", "x", "1/2/2024 10:00"], ["2099-12-31", "", "2024-02-29", "2024-01-01", "", "2024-02-01"]),
    (codes.wbs_norm, ["code 03.04.21.1 x", "7", None], ["3.4.21.1", "", ""]),
    (codes.path_key, ["Unit | Edecucao|x"], ["UNIT|EXECUCAO|X"]),
    (codes.path_complete, ["a|b|c", "a||b", "a|b"], [True, False, False]),
    (codes.sequence_tail, ["RL-CIV-0042.pdf", "x"], [42, None]),
    (C.strip_errors, ["#N/D", "a #REF! | b", "| x |"], ["", "a | b", "x"]),
    (C.title_clean, ["Título (nota (x)) –  fim", "#N/A"], ["TITULO - FIM", ""]),
    (path_extract, ["Rev.B (U|B|C|D) e (a|b|c)", "a|b", "x"], ["U|B|C|D", "a|b", "x"]),
    (lambda c: classify_outcome(c, F.lit("")), ["NÃO ALOCADO", "Alocado", "em análise", "?"], ["rejected", "accepted", "pending", "unknown"]),
    (register_outcome, ["Não Alocado", "alocado", "x", ""], ["not_allocated", "accepted", "unknown", "empty"]),
    (lambda c: comment_merge([c, F.lit("Ok"), F.lit("2024-01-01"), F.lit("-"), F.lit("OK ")]), ["a"], ["a | Ok"]),
    (lambda c: C.proposed_file_name(c, F.lit("RL-1"), F.lit("B")), ["x.PDF", "x"], ["RL-1_B.pdf", "RL-1_B.pdf"]),
    (lambda c: C.claimed_revision(c, F.lit("RL-1")), ["rl-1_rev_b.pdf", "RL-1_C1.pdf", "RL-1.pdf"], ["B", "C1", ""]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_literals(spark, case):
    fn, values, wanted = CASES[case]
    assert apply(spark, fn, values) == wanted


def test_revision_sequence_is_ordered(spark):
    seq = ["0"]
    for _ in range(60):
        seq += apply(spark, revision.revision_next, [seq[-1]]) if len(seq) < 4 else []
    ranks = apply(spark, revision.revision_rank, ["0", "A", "B", "Z", "AA", "AB", "ZZ", "AAA"])
    assert ranks == sorted(ranks) and seq[:4] == ["0", "A", "B", "C"]


def test_diagnosis_table(spark):
    row = spark.range(1).select(
        diagnosis(F.lit("pending"), F.lit(False), F.lit(True), F.lit(True), F.lit(False)).alias("a"),
        diagnosis(F.lit("not_allocated"), F.lit(True), F.lit(True), F.lit(False), F.lit(True)).alias("b"),
        diagnosis(F.lit("empty"), F.lit(False), F.lit(True), F.lit(False), F.lit(False)).alias("c"),
    )
    assert tuple(row.collect()[0]) == ("pending_external", "not_allocated_control", "new_planned")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30).filter(lambda s: "\x00" not in s and all(not 0xD800 <= ord(c) < 0xE000 for c in s)), min_size=1, max_size=20))
def test_normalisers_are_idempotent(spark, values):
    for fn in (text.norm, text.canon_key, text.loose_key, text.punct_tag):
        once = apply(spark, fn, values)
        assert apply(spark, fn, once) == once or fn is text.punct_tag
