"""Work per row: what is worked out once, and in code the JVM compiles."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import functions as F

from docweave.functions import dates, revision
from docweave.operators import evidence as E, matching as M
from docweave.plans import relations
from docweave.session import in_methods

REGISTER = ["document", "revision", "status", "posting_status", "dispatch", "effective_date", "title", "allocation_status", "allocation", "path"]


def longest_method(df) -> int:
    """Bytes of the longest generated method of a plan."""
    spark = df.sparkSession
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_in_methods_changes_no_value(spark):
    rows = [(1, "a", [1, 2]), (2, None, None), (None, "", [])]
    df = spark.createDataFrame(rows, "n long, v string, l array<int>")
    for c in df.columns:
        out = in_methods(df, c)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        assert [tuple(r) for r in out.collect()] == rows


def test_bounds_of_conflicts_are_compiled(spark):
    rows = spark.range(10).select(*[F.concat(F.lit(f"{c} "), F.col("id").cast("string")).alias(c) for c in REGISTER])
    assert longest_method(E._bounds(rows, "document", "technical", hashed=True)) <= 8000


def test_spellings_are_distinct_before_they_are_normalised(spark):
    rows = spark.createDataFrame([("RL-1 _ a",), ("rl-1_A",), ("rl-1_A",), (None,), (" ",), ("RL-2 ",), ("RL-2",)], "code string")
    out = M.longest_spellings(rows, "code")
    assert {tuple(r) for r in out.collect()} == {("RL-1_A", "RL-1 _ a"), ("RL-2", "RL-2")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "upper(" not in plan[plan.rindex("Aggregate ["):]


def test_values_of_conflicts_send_a_row_once(spark):
    technical = spark.createDataFrame([("a", "A", "", "x", "g", "", "T", "", "", ""), ("a", "A", "", "x", "h", "", "t", "", "", "p"), ("b", "B", "", "y", "g", "", "", "", "", "")], REGISTER).withColumn("id", F.concat(F.lit("t"), F.col("dispatch")))
    history = spark.createDataFrame([("a", "Rev. A", "y", "h1"), ("a", "A", "", "h2"), ("a", "B", "x", "h3"), ("b", "A", "z", "h4")], ["document", "revision", "status", "id"]).withColumn("posting_status", F.lit(""))
    conflicts = spark.createDataFrame([("a", "technical", "", "dispatch"), ("a", "technical", "", "title"), ("a", "cross", "A", "status"), ("a", "history", "A", "status"), ("c", "technical", "", "title")], ["document", "scope", "rev", "field"])
    out = E.conflict_values(technical, history, conflicts, "id")
    assert out.columns == ["document", "scope", "rev", "field", "value", "kind", "id"]
    assert sorted(map(tuple, out.collect())) == sorted([
        ("a", "technical", "", "dispatch", "G", "technical", "tg"), ("a", "technical", "", "dispatch", "H", "technical", "th"),
        ("a", "technical", "", "title", "T", "technical", "tg"), ("a", "technical", "", "title", "T", "technical", "th"),
        ("a", "cross", "A", "status", "X", "technical", "tg"), ("a", "cross", "A", "status", "X", "technical", "th"),
        ("a", "cross", "A", "status", "Y", "history", "h1"), ("a", "history", "A", "status", "Y", "history", "h1")])
    assert len(re.findall(r"\bGenerate\b", out._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_rank_of_every_short_revision(spark):
    values = [chr(i) for i in range(32, 127)] + ["", "AA", "AZ", "A1", "Z9", "A0", "I1", "IO", "00", "Ç", None]
    letters = {a: 1000 * (i + 1) for i, a in enumerate(revision.ALPHABET)}
    more = {"0": 0, "AA": 25000, "AZ": 48000, "A1": 1001, "Z9": 24009}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r["v"]: r["k"] for r in df.select("v", revision.revision_rank(F.col("v")).alias("k")).collect()} == {v: {**letters, **more}.get(v, -1) for v in values}


def test_dates_in_every_style(spark):
    day = datetime.date
    want = {"05/01/2024": day(2024, 1, 5), "5/1/24": day(2024, 1, 5), " 05/01/2024 ": day(2024, 1, 5), "05/01/2024 10:00": day(2024, 1, 5), "05/01/24 x": day(2024, 1, 5), "31/02/2024": None,
            "2024-01-05": day(2024, 1, 5), "2024-01-05T10:00": day(2024, 1, 5), "2024-02-31": None, "2024-01-05x": None, "45000": day(2023, 3, 15), "a/b-c": None, "05/01/20245": None, "": None, None: None}
    df = spark.createDataFrame([(v,) for v in want], "v string")
    assert {r["v"]: r["d"] for r in df.select("v", dates.parse_date("v").alias("d")).collect()} == want


def test_relation_takes_the_newest_row(spark):
    cols = [*REGISTER, "discipline", "document_type", "purpose", "comment", "modified", "included", "sheet", "row_no", "source", "source_ts"]
    blank = dict.fromkeys(cols, "")
    row = lambda **v: tuple({**blank, "row_no": 1, "source_ts": 1, **v}[c] for c in cols)
    kinds = ", ".join(f"{c} {'long' if c in ('row_no', 'source_ts') else 'string'}" for c in cols)
    technical = spark.createDataFrame([row(document="a", revision="A", title=" T ", path="p", sheet="ET", row_no=1), row(document="a", revision="A", title="t", purpose="q", sheet="CV", row_no=2)], kinds)
    names = ["document", "revision", "status", "posting_status", "modified", "included", "sheet", "row_no", "source", "source_ts"]
    history = spark.createDataFrame([("a", "B", "Em Análise", "", "2024-01-01", "", "HIST", 1, "h", 1), ("b", "A", "Em Análise", "", "", "", "HIST", 2, "h", 2)], names)
    pick = ["document", "sheet", "title", "current_revision", "posting_status", "technical_status", "path", "purpose", "conflict"]
    got = {tuple(r) for r in relations.relation_rows(technical, history).select(*pick).collect()}
    assert got == {("a", "CV", "t", "B", "Em Análise", "", "p", "q", False)}
    both = {tuple(r) for r in relations.relation_rows(technical, history, history_only=True).select(*pick).collect()}
    assert both == got | {("b", "HIST", "", "A", "Em Análise", "Em Análise", "", "", False)}
