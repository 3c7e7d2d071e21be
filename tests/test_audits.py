"""Path audit and its catalog choice against plain forms."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import evidence as E, similarity as S
from docweave.plans import audits as U, changes as X

HOT = ["inspecao", "montagem", "pintura"]
RARE = [f"palavra{chr(97 + i)}" for i in range(20)]


def plain_choice(targets, catalog):
    """All targets against all entries of their kind."""
    kind = lambda x: next((k for k in ("PLANO", "PROCEDIMENTO", "RELATORIO") if k in x.upper().split()), "")
    tokens = lambda x: {w for w in x.upper().split() if len(w) >= 3}
    merged = {}
    for i, description, notes, path in catalog:
        merged[(description, notes, path)] = min(i, merged.get((description, notes, path), i))
    out = {}
    for key, title, discipline in targets:
        paths = {}
        for (description, notes, path), i in merged.items():
            whole = f"{description} {notes}"
            if not kind(title) or kind(whole) != kind(title) or path.count("|") < 2:
                continue
            a, b = tokens(title), tokens(whole)
            named = discipline != "" and discipline.upper() in f"{whole} {path}".upper()
            score = 65 + 24 * named + min(28, 4 * len(a & b)) + int(len(a & b) / max(len(a), len(b), 1) * 28 + 0.5)
            paths[path.upper()] = max(paths.get(path.upper(), (0, 0, "")), (score, -i, path))
        best = sorted(paths.values(), reverse=True)[:2]
        if not best or best[0][0] < 76:
            out[key] = ("none", "", "none")
        elif len(best) > 1 and best[0][0] - best[1][0] < 10:
            out[key] = ("conflict", "", "none")
        else:
            out[key] = ("found", best[0][2], "high" if best[0][0] >= 100 else "medium")
    return out


def draw(rnd, kinds, rare):
    words = [rnd.choice(kinds)] + rnd.sample(HOT, rnd.randint(0, 3)) + rnd.sample(RARE[:rare], rnd.randint(0, 3))
    rnd.shuffle(words)
    return " ".join(words)


def test_catalog_choice_is_that_of_all_pairs(spark):
    rnd = random.Random(7)
    kinds, disciplines = ["plano", "procedimento", "relatorio", "relatorio", "outro"], ["", "civil", "tubos", "solda"]
    targets = [(i, draw(rnd, kinds, 20), rnd.choice(disciplines)) for i in range(400)]
    catalog = [(i, draw(rnd, kinds, 14), rnd.choice(["", "", "civil"]), f"U|{rnd.choice(['Civil', 'Tubos', 'Geral'])}|P{rnd.randrange(9)}") for i in range(90)]
    catalog += [(90, "relatorio", "", "U|curto"), (91, "", "", "A|B|C"), (92, catalog[0][1], catalog[0][2], catalog[0][3])]
    t = spark.createDataFrame(targets + [(900, None, None), (901, "", "civil")], "key int, title string, discipline string")
    c = spark.createDataFrame(catalog, "entry_id int, description string, notes string, path string")
    got = {r[0]: tuple(r)[1:] for r in S.catalog_score_audit(t, "key", c).collect()}
    want = plain_choice(targets, catalog) | {900: ("none", "", "none"), 901: ("none", "", "none")}
    assert got == want
    assert min(Counter(v[0] for v in want.values()).values()) >= 10
    assert {r.outcome for r in S.catalog_score_audit(t, "key", c.limit(0)).collect()} == {"none"}
    assert S.catalog_score_audit(t.limit(0), "key", c).collect() == []


def inputs(spark):
    records = spark.createDataFrame(
        [(1, ""), (2, "U|B|X"), (3, "U|B|Y"), (4, "U | B"), (5, "U|B|Z"), (6, None), (7, "U|B|X"), (8, "")], "document int, path string")
    peers = spark.createDataFrame([(1, "U|B|X", "B", 3, 3), (3, "U|B|X", "E", 3, 3), (4, "U|B|Q", "E", 3, 3), (6, "U|B|P", "E", 3, 3)], "document int, voted string, context string, support long, total long")
    mapped = spark.createDataFrame([(1, "found", "u|b|x", "high"), (4, "found", "U|B|X", "medium"), (5, "found", "U|B|Z", "medium"), (8, "conflict", "", "none")], "document int, outcome string, path string, confidence string")
    catalog = spark.createDataFrame([("U|B|X",), ("U|B",)], "path string")
    return records, "document", peers, catalog, mapped


def test_path_audit_infers_where_no_controlled_source_is_given(spark):
    conflicts = spark.createDataFrame([(7,), (7,)], "document int")
    got = {r[0]: tuple(r)[1:] for r in U.path_audit(*inputs(spark), conflicts=conflicts).collect()}
    assert got == {
        1: ("missing", "suggestion", "u|b|x", "high", "catalog", "pending"),
        2: ("ok", "ok", "", "high", "none", "pending"),
        3: ("divergent", "insufficient", "", "none", "peers", "pending"),
        4: ("missing", "insufficient", "", "none", "conflict", "pending"),
        5: ("ok", "ok", "", "medium", "catalog", "pending"),
        6: ("missing", "suggestion", "U|B|P", "low", "peers", "pending"),
        7: ("conflict", "insufficient", "", "none", "conflict", "pending"),
        8: ("missing", "insufficient", "", "none", "conflict", "pending"),
    }


def test_controlled_sources_settle_incomplete_paths_and_end_inference(spark):
    controlled = spark.createDataFrame([(1, "found", "U|B|R"), (2, "found", "U|B|R"), (4, "wrong_year_only", ""), (6, "not_found", ""), (8, "allocation_missing", "")], "document int, path_status string, path string")
    got = {r[0]: tuple(r)[1:] for r in U.path_audit(*inputs(spark), controlled=controlled).collect()}
    assert got[1] == ("missing", "confirmed_error", "U|B|R", "high", "controlled", "approved")
    assert got[2] == ("ok", "ok", "", "high", "none", "pending")  # a complete path is never replaced
    assert got[3] == got[5] == ("unconfirmed", "insufficient", "", "none", "none", "pending")
    assert got[4] == got[8] == ("missing", "insufficient", "", "none", "conflict", "pending")
    assert got[6] == ("missing", "insufficient", "", "none", "none", "pending")


def test_pending_items_of_all_jobs(spark):
    paths = spark.createDataFrame(
        [("a", "missing", "suggestion", "U|B|X", "catalog", "pending"), ("b", "missing", "suggestion", "u|b|x", "catalog", "pending"), ("c", "missing", "confirmed_error", "U|B|R", "controlled", "approved"),
         ("d", "conflict", "insufficient", "", "conflict", "pending"), ("e", "ok", "ok", "", "none", "pending"), ("f", "missing", "suggestion", "U|P", "peers", "pending")],
        "document string, issue string, classification string, proposed string, source string, decision string")
    titles = spark.createDataFrame([("a", "empty", "confirmed_error", "T", "priority 1"), ("b", "format", "suggestion", None, "current title")],
                                   "document string, issue string, classification string, proposed string, description_source string")
    relation = spark.createDataFrame([("a", True, "title"), ("b", False, "")], "document string, conflict boolean, conflict_fields string")
    asked = spark.createDataFrame([("zz", "missing"), ("a", "match")], "document string, outcome string")
    analysis = spark.createDataFrame([("a", "review", "technical_conflict"), ("b", "review", "not_found"), ("c", "ready", "new")], "document_key string, decision string, diagnosis string")
    files = spark.createDataFrame([("x.pdf", "y.pdf", "duplicate", "blocked"), ("w.pdf", "v.pdf", "identifier_review", "review"), ("ok.pdf", "k.pdf", "ready", "ready")],
                                  "name string, final_name string, code string, status string")
    parts = X.path_items(paths), X.title_items(titles), X.relation_items(relation, asked), X.allocation_items(analysis), X.rename_items(files, "name")
    rows = X.pending_queue(*parts).collect()
    got = {(r.module, r.document): (r.issue, r.origin, r.risk, r.approvable) for r in rows}
    assert got == {
        ("paths", "a"): ("missing", "catalog", "suggestion", True), ("paths", "b"): ("missing", "catalog", "suggestion", True), ("paths", "f"): ("missing", "history", "suggestion", True),
        ("paths", "d"): ("conflict", "register", "error", False), ("titles", "a"): ("empty", "descriptions", "error", True), ("titles", "b"): ("format", "register", "warning", False),
        ("relations", "a"): ("conflict", "register", "error", False), ("relations", "zz"): ("not_found", "register", "error", False),
        ("allocation", "a"): ("technical_conflict", "control", "error", False), ("allocation", "b"): ("not_found", "control", "warning", False),
        ("renames", "x.pdf"): ("duplicate", "file", "error", False), ("renames", "w.pdf"): ("identifier_review", "file", "warning", False),
    }
    key = {(r.module, r.document): r.group_key for r in rows}
    assert key["paths", "a"] == key["paths", "b"] != key["paths", "f"] and key["paths", "d"] == ""
    assert X.pending_queue(*[p.limit(0) for p in parts]).collect() == []


def test_title_audit_modes_and_possible_identifier(spark):
    tags = [("T1", "M-01"), ("T2", "M-02"), ("T3", "M-03"), ("T4", "M-04"), ("T5", "M-05"), ("T6", "M-06"), ("T7", "M-07"), ("T8", "M-77")]
    rec = spark.createDataFrame([(k, f"Relatório - obra nova {'M-77' if k == 'T8' else ''}", tag, "RL") for k, tag in tags] + [("T9", "", "M-99", "XX")], "document string, title string, tag string, type string")
    rec = rec.withColumn("discipline", F.lit("X"))
    given = [
        ("M1", 1, "Válvula", True, False), ("M1", 2, "Bomba", True, False), ("M1", 3, "Bomba azul", True, False), ("M2", 2, "Bomba", True, False), ("M2", 3, "Sala norte", True, False),
        ("M3", 2, "Bomba", True, True), ("M3", 3, "Sala norte", True, False), ("M4", 9, "Escopo", False, False), ("M5", 4, "Base", True, False), ("M6", 2, "", True, False),
    ]
    desc = spark.createDataFrame(given, "tag_key string, priority int, description string, trusted boolean, manual_review boolean")
    rows = {mode: {r["document"]: r for r in U.title_audit(rec, "document", {"RL": "Relatório"}, desc, F.col("tag"), F.col("type"), mode=mode).collect()} for mode in U.MODES}
    source = {mode: [rows[mode][f"T{i}"]["description_source"] for i in range(1, 8)] for mode in rows}
    assert source["auto"] == ["priority 1", "priority 2 + 3", "priority 2", "priority 9", "priority 4", "current title", "current title"]
    assert source["component_only"] == ["priority 2", "priority 2", "priority 2", "current title", "priority 4", "current title", "current title"]
    assert source["appendix_only"] == ["priority 3", "priority 3", "priority 3", "current title", "priority 4", "current title", "current title"]
    auto = rows["auto"]
    assert [auto[f"T{i}"]["issue"] for i in range(1, 10)] == ["missing_tag"] * 6 + ["possible_identifier", "ok", "empty"]
    assert "BOMBA" in auto["T2"]["proposed"] and "SALA NORTE" in auto["T2"]["proposed"]
    # a tag no source knows proves nothing: no proposal, and an empty title stays without one that is certain
    assert (auto["T7"]["classification"], auto["T7"]["proposed"], auto["T7"]["confidence"]) == ("insufficient", "", "none")
    assert auto["T9"]["classification"] == "insufficient" and auto["T3"]["classification"] == "insufficient"


def test_titles_without_a_tag_are_dealt_over_the_tasks(spark):
    rec = spark.range(400).select(F.concat(F.lit("D-"), F.col("id").cast("string")).alias("document"), F.lit("Relatório X").alias("title"), F.lit("").alias("discipline"), F.lit("RL").alias("type"))
    desc = spark.createDataFrame([("M1", 2, "Bomba", True, False)], "tag_key string, priority int, description string, trusted boolean, manual_review boolean")
    given = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {name: spark.conf.get(name) for name in given}
    for name, value in given.items():
        spark.conf.set(name, value)
    try:
        tag = F.when(F.col("document") == "D-7", "M-01").otherwise("")
        out = U.title_audit(rec, "document", {"RL": "Relatório"}, desc, tag, F.col("type"))
        tasks = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
        seven = out.filter("document = 'D-7'").collect()
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert sum(r["count"] for r in tasks) == 400 and max(r["count"] for r in tasks) < 200
    assert [(r["issue"], r["description_source"]) for r in seven] == [("missing_tag", "priority 2")]


def test_conflicts_of_named_fields_only(spark):
    columns = ["document", "revision", "status", "posting_status", "dispatch", "effective_date", "title", "allocation_status", "allocation", "path"]
    rows = spark.createDataFrame([("a", "A", "x", "", "", "", "T", "", "", "p"), ("a", "B", "y", "", "", "", "t ", "", "", "q"), ("b", "A", "x", "", "", "", "T", "", "", ""), ("b", "A", "x", "", "", "", "U", "", "", "")], columns)
    found = E.conflict_detect(rows, None, fields=["title"])
    assert [tuple(r) for r in found.collect()] == [("b", "technical", "", "title", "T", "U")]
    assert {(r["document"], r["field"]) for r in E.conflict_detect(rows, None).collect()} == {("a", "revision"), ("a", "path"), ("b", "title")}


@pytest.mark.parametrize("blank", ["\u00a0", "\u2003", "\t", "\u3000", "\ufeff", "  "])
def test_texts_are_trimmed_without_a_pattern(spark, blank):
    df = spark.createDataFrame([(f"{blank}Ção{blank}{blank}é\u0301 –b{blank}",)], "v string")
    out = df.select(text.text("v").alias("t"), text.norm("v").alias("n"))
    row = out.collect()[0]
    assert (row["t"], row["n"]) == (f"Ção{blank}{blank}é\u0301 –b", "CAO E -B")
    assert "regexp" not in out.select("t")._jdf.queryExecution().optimizedPlan().toString()


def test_conflicts_normalise_each_row_once(spark):
    columns = ["document", "revision", "status", "posting_status", "dispatch", "effective_date", "title", "allocation_status", "allocation", "path"]
    technical = spark.createDataFrame([("a", "A", "", "x", "", "", "T", "", "", "p"), ("a", "A", "", "x", "", "", "U", "", "", "p")], columns)
    history = spark.createDataFrame([("a", "Rev. A", "y"), ("a", "A", "z")], ["document", "revision", "status"]).withColumn("posting_status", F.lit(""))
    out = E.conflict_detect(technical, history)
    assert "upper(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["scope"], r["rev"], r["field"], r["first_value"], r["last_value"]) for r in out.collect()} == {
        ("technical", "", "title", "T", "U"), ("history", "A", "status", "Y", "Z"), ("cross", "A", "status", "X", "Z")}


def test_conflict_detect_of_named_fields_with_a_history(spark):
    technical = spark.createDataFrame(
        [("a", "A", "x", "t1", "p1"), ("a", "A", "y", "t2", "p2"), ("b", "B", "x", "", "p1")], "document string, revision string, status string, title string, path string"
    ).withColumn("posting_status", F.lit(""))
    history = spark.createDataFrame([("a", "A", "x", ""), ("a", "A", "z", " z "), ("b", "B", "w", "")], "document string, revision string, status string, posting_status string")
    fields = ["status", "title"]
    whole = E.conflict_detect(technical, history)
    named = E.conflict_detect(technical, history, fields=fields)
    assert sorted(named.collect()) == sorted(whole.filter(F.col("field").isin(*fields)).collect())
    assert named.filter("field = 'path'").count() == 0 and whole.filter("field = 'path'").count() > 0
