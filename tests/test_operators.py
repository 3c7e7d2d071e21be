"""Operators on small fixtures, checked by hand or against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import codes, text
from docweave.operators import cleaning as C, evidence as E, keyed, matching as M, ranking as R, similarity as S, titles as T
from docweave.plans import audits as U, changes as X
from docweave.sources import catalogs as K, grids as G, sinks


def test_attach_splits_a_hot_key(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    settings = {**dict.fromkeys(old, "-1"), "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(300000).repartition(8).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("k"), "id")
        facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        out = keyed.attach(rows, facts, ["k"], "inner").agg(F.sum("n").alias("s"), F.count("id").alias("c"))
        got = out.collect()[0]
        counts = {k: n for k, n in facts.collect()}
        assert got["c"] == 300000 and got["s"] == sum(n * n for n in counts.values())
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_running_and_carry_cross_blocks(spark):
    rows = [(g, i, 1 if i % 3 == 0 else 0, str(i) if i % 7 == 0 else None) for g in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v int, s string")
    run = keyed.running_by_block(df, ["g"], "i", F.col("v"), "total", block_rows=8)
    assert all(r["total"] == r["i"] // 3 + 1 for r in run.collect())
    fwd = keyed.carry_forward(df, ["g"], "i", F.col("s"), "last", block_rows=8)
    assert all(r["last"] == str(r["i"] // 7 * 7) for r in fwd.collect())


def test_enumerate_is_dense_and_ordered(spark):
    names = [f"file {n}.pdf" for n in (10, 9, 100, 1, 2, 20)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    out = R.natural_sort_enumerate(df, "n", "i").orderBy("sequence").collect()
    assert [r["n"] for r in out] == [f"file {n}.pdf" for n in (1, 2, 9, 10, 20, 100)] and [r["sequence"] for r in out] == list(range(1, 7))


def norm_key(s):
    return " ".join(s.upper().split())


def brute_match(request, docs):
    key = norm_key(request)
    for ext in (".PDF", ".DOC"):
        key = key.removesuffix(ext)
    loose = lambda s: "".join(c for c in s if c.isalnum())
    if key in docs:
        return 1, {key}
    def bounded(d):
        at = key.find(d)
        while at >= 0:
            if (at == 0 or not key[at - 1].isalnum()) and (at + len(d) == len(key) or not key[at + len(d)].isalnum()):
                return True
            at = key.find(d, at + 1)
        return False

    stages = [(2, {d for d in docs if bounded(d)}), (3, {d for d in docs if loose(d) == loose(key)}), (4, {d for d in docs if loose(d) in loose(key)})]
    for stage, hits in stages:
        if hits:
            keep = {c for c in hits if not any(o != c and (len(o) > len(c) or len(loose(o)) > len(loose(c))) and (c in o or loose(c) in loose(o)) for o in hits)}
            return stage, keep
    return 0, set()


def test_staged_match_against_brute_force(spark):
    rnd = random.Random(5)
    docs = sorted({"-".join(rnd.choice(["AB", "C1", "C12", "X", "900"]) for _ in range(rnd.randint(1, 4))) for _ in range(40)})
    wrap = ["{}", "{}.pdf", "copy {} v1", "x{}", "{}9", "{} and {}", "zz"]
    asked = [rnd.choice(wrap).format(rnd.choice(docs), rnd.choice(docs)) for _ in range(150)]
    asked += [a.replace("-", "") for a in asked[:40]]
    index = M.document_index(spark.createDataFrame([(d,) for d in docs], "document string"))
    req = spark.createDataFrame(list(enumerate(asked)), "i int, raw string")
    got = {r["i"]: r for r in M.staged_key_match(req, "i", "raw", index).collect()}
    for i, a in enumerate(asked):
        stage, keep = brute_match(a, set(docs))
        assert (got[i]["stage"], got[i]["candidates"]) == (stage, len(keep)), a
        if len(keep) == 1:
            assert got[i]["document_key"] == next(iter(keep))


def test_token_similarity_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["PAINEL", "MOTOR", "CABO", "LEITO", "VASO", "TANQUE", "COMUM"]
    sets = [sorted({"COMUM"} | set(rnd.sample(words, rnd.randint(1, 5)))) for _ in range(60)]
    left, right = sets[:30], sets[30:]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "t0 array<string>")
    got = {(r["left_sig"], r["right_sig"]) for r in S.token_similarity_join(frame(left), frame(right), "t0", 60).collect()}
    want = {(S.SIG.join(a), S.SIG.join(b)) for a, b in itertools.product(left, right) if len(set(a) & set(b)) * 100 >= 60 * max(len(a), len(b))}
    assert got == want


def test_conflicts_by_scope(spark):
    cols = "document string, revision string, status string, posting_status string, title string, dispatch string, effective_date string, allocation_status string, allocation string, path string"
    tech = spark.createDataFrame([("D", "A", "", "Em Análise", "T", "G1", "", "", "", ""), ("D", "Rev. A", "", "em analise", "t ", "G2", "", "", "", "")], cols)
    hist = spark.createDataFrame([("D", "A", "Recusado", "", "", "", "", "", "", "")], cols)
    got = {(r["scope"], r["rev"], r["field"]) for r in E.conflict_detect(tech, hist).collect()}
    assert got == {("technical", "", "dispatch"), ("cross", "A", "dispatch"), ("cross", "A", "status")}
    hashed = {(r["scope"], r["rev"], r["field"]) for r in E.conflict_detect(tech, hist, hashed=True).collect()}
    assert hashed == got


def test_header_far_down_and_far_right(spark):
    head = lambda pos, n: [""] * pos + ["DOCUMENTO"] + [""] * n
    rows = [("s1", "A", i, ["t"]) for i in range(1, 30)] + [("s1", "A", 30, head(0, 1))] + [("s1", "A", 31 + i, [f"RL-00000{i}", ""]) for i in range(40)]
    rows += [("s1", "B", 1, head(90, 0))] + [("s1", "B", 2 + i, [""] * 90 + [f"XX-00000{i}"]) for i in range(30)] + [("s1", "C", 1, ["nothing"])]
    grid = spark.createDataFrame(rows, "source string, sheet string, row_no int, cells array<string>")
    kept, coverage = G.register_ingest(grid)
    assert kept.count() == 70
    assert {(r["sheet"], r["outcome"]) for r in coverage.collect()} == {("A", "read"), ("B", "read"), ("C", "no_header")}


def test_title_compose(spark):
    rows = [("Relatório de Montagem", "montagem de bomba (x)", ""), ("Relatório de inspeção", "Relatório de inspeção de válvula", "V-1"),
            ("Relatório", "M 01 - motor", "M-01"), ("Plano", "", "T-9"), ("Relatório de montagem do transformador", "montagem de transformador", "")]
    out = T.title_compose(spark.createDataFrame(rows, "k string, d string, t string"), "k", "d", "t").collect()
    assert [r["composed_title"] for r in out] == [
        "RELATORIO DE MONTAGEM - BOMBA", "RELATORIO DE INSPECAO - VALVULA - V-1", "RELATORIO - MOTOR - M-01", "PLANO - T-9", "RELATORIO DE MONTAGEM DO TRANSFORMADOR",
    ]


def test_title_audit_order_of_issues(spark):
    rows = [("a", "", "RL"), ("b", "Relatório - bomba M-99", "RL"), ("c", "Bomba M-01", "RL"), ("d", "Relatório - bomba azul", "RL"), ("e", "Relatório - bomba azul M-01", "RL")]
    rec = spark.createDataFrame(rows, "document string, title string, type string").withColumn("discipline", F.lit("X"))
    desc = spark.createDataFrame([("M1", 1, "Bomba azul", True, False)], "tag_key string, priority int, description string, trusted boolean, manual_review boolean")
    out = U.title_audit(rec, "document", {"RL": "Relatório"}, desc, F.lit("M-01"), F.col("type"))
    got = {r["document"]: (r["issue"], r["proposed"]) for r in out.collect()}
    title = "RELATORIO - BOMBA AZUL - M-01"
    assert got == {"a": ("empty", title), "b": ("wrong_tag", title), "c": ("document_type", title), "d": ("missing_tag", title), "e": ("ok", "")}


def test_change_set_refusals_and_apply(spark):
    reg = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, v string")
    approved = spark.createDataFrame([(1, "a", "A"), (2, "x", "B"), (3, "c", ""), (4, "d", "1"), (4, "d", "2"), (9, "", "Z")], "k int, current string, proposed string")
    plan = X.change_set_plan(approved, reg, ["k"], "v")
    assert {(r["k"], r["refused"]) for r in plan.collect()} == {(1, ""), (2, "changed_since"), (3, "value_missing"), (4, "duplicate_cell"), (9, "row_missing")}
    assert sorted(tuple(r) for r in X.change_set_apply(reg, plan, ["k"], "v").collect()) == [(1, "A"), (2, "b"), (3, "c"), (4, "d")]


def test_latest_does_not_depend_on_row_order(spark):
    rows = [(i % 5, i, i * 7 % 13) for i in range(60)]
    schema = "k int, a int, b int"
    one = keyed.latest_by(spark.createDataFrame(rows, schema), ["k"], ["b", "a"], ["a"])
    random.Random(1).shuffle(rows)
    two = keyed.latest_by(spark.createDataFrame(rows, schema).repartition(7), ["k"], ["b", "a"], ["a"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_partitioned_catalog_reads_only_needed_folders(spark, tmp_path):
    cat = spark.createDataFrame([(i, "CIV" if i % 2 else "ELE", f"t{i}") for i in range(20)], "entry_id int, discipline string, tag string")
    K.write_partitioned(K.catalog_build(cat, ["tag", "discipline"], "entry_id"), str(tmp_path / "c"), "discipline")
    read = spark.read.parquet(str(tmp_path / "c")).filter("discipline = 'CIV'")
    assert len(read.inputFiles()) > 0 and read.count() == 10
    assert "PartitionFilters: [isnotnull(discipline" in read._jdf.queryExecution().executedPlan().toString()


def test_csv_cells_have_no_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([('a "q"', "x\ny")], "p string, q string")
    sinks.csv_export(df, ["p", "q"], str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['"a ""q""";"x y"']


def test_tag_conference_statuses(spark):
    ref = spark.createDataFrame([("TK-1",), ("V-1A",), ("V1-A",)], "tag string")
    asked = ["TK-1", "TK_1.pdf", "nt-TK-1", "NT-XX-9", "XX-8", "V_1_A", "bad"]
    out = X.tag_conference(spark.createDataFrame(list(enumerate(asked)), "i int, c string"), "i", "c", ref, "tag")
    got = {r["i"]: (r["status"], r["corrected_code"]) for r in out.collect()}
    assert got[0] == ("confirmed", "TK-1") and got[1] == ("confirmed", "TK-1") and got[2] == ("remove_marker", "TK-1")
    assert got[3] == ("non_tagged", "nt-XX-9") and got[4] == ("add_marker", "nt-XX-8") and got[5][0] == "review" and got[6][0] == "review"


def test_normal_text_of_both_sides_agrees(spark):
    got = spark.createDataFrame([("a b́",)], "v string").select(text.norm("v")).collect()[0][0]
    assert got == "A B"


def test_stream_state_survives_a_restart_and_a_replay(spark, tmp_path):
    from docweave.streaming import twins

    source, folder = tmp_path / "in", str(tmp_path / "state")

    def arrive(n, rows):
        spark.createDataFrame(rows, "k int, n int, v string").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        """A new driver: nothing but the folders is known."""
        state = twins.BucketState(spark, folder, "k", 8)
        rows = spark.readStream.schema("k int, n int, v string").option("maxFilesPerTrigger", 1).parquet(str(source))
        job = twins.stream_latest_record(rows, "k", ["n"], ["v"], state)
        job.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        return {r["k"]: r["v"] for r in state.read().collect()}

    want = {}
    for n in range(6):
        rows = [(k, n, f"{k}-{n}") for k in range(10) if (k + n) % 3]
        arrive(n, rows)
        want.update({k: v for k, _, v in rows})
        assert run() == want
    state = twins.BucketState(spark, folder, "k", 8)
    last = max(state.manifest().values())
    batch = spark.createDataFrame(rows, "k int, n int, v string").withColumn("_bucket", state.bucket())
    touched = [r[0] for r in batch.select("_bucket").distinct().collect()]
    before = state.read(last, touched).withColumn("_bucket", state.bucket())
    state.write(keyed.latest_by(before.unionByName(batch), ["_bucket", "k"], ["n"], ["n", "v"]), touched, last)  # the last batch again
    assert {r["k"]: r["v"] for r in state.read().collect()} == want


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    from docweave.streaming import twins

    state = twins.BucketState(spark, str(tmp_path / "state"), "k", 32)
    source = tmp_path / "in"

    def run():
        rows = spark.readStream.schema("k int, n int, v string").parquet(str(source))
        twins.stream_latest_record(rows, "k", ["n"], ["v"], state).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([(k, 0, "a") for k in range(500)], "k int, n int, v string").write.parquet(str(source))
    run()
    first = state.manifest()
    assert len(first) == 32
    spark.createDataFrame([(7, 1, "b"), (900, 1, "c")], "k int, n int, v string").coalesce(1).write.mode("append").parquet(str(source))
    run()
    changed = {b for b, n in state.manifest().items() if n != first.get(b)}
    assert 1 <= len(changed) <= 2
    written = [p for p in (tmp_path / "state" / f"batch={max(state.manifest().values())}").iterdir() if p.name.startswith("_bucket=")]
    assert len(written) == len(changed)
    assert {r["k"]: r["v"] for r in state.read().collect()} == {**{k: "a" for k in range(500)}, 7: "b", 900: "c"}
    # A batch that was cut short before its manifest is not seen.
    spark.createDataFrame([(7, 9, "x", 1)], "k int, n int, v string, _bucket int").write.partitionBy("_bucket").parquet(str(tmp_path / "state" / "batch=99"))
    assert {r["v"] for r in state.read().collect()} == {"a", "b", "c"}


def test_title_wordings(spark):
    from docweave.operators import cleaning

    cases = {
        "TAG: Bomba": "Bomba",
        "Placa de Identificação de bomba": "Placa DE bomba",
        "placa DE IDENTIFICACAO DOS motores": "placa DOS motores",
        "Identificação de cabos": "cabos",
        "Relatório de de inspeção": "Relatório DE inspeção",
        "Identificação": "",
        '7" flange': "7 flange",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", cleaning.title_part("t").alias("p"))
    assert {r["t"]: r["p"].strip() for r in df.collect()} == cases


def test_nothing_is_cut_by_depth_length_or_count(spark):
    from docweave.operators import cleaning, filters, ranking as R, titles as T

    deep = spark.createDataFrame([("a " + "(" * 9 + "x" + ")" * 9 + " b (c) (",)], "t string").select(cleaning.without_parentheses(F.col("t")).alias("v"))
    assert deep.first()["v"] == "a b ("
    numbers = spark.createDataFrame([(i, f"n{'9' * k}") for i, k in enumerate((30, 19, 25, 1))], "i int, n string")
    assert [r["n"] for r in R.natural_sort_enumerate(numbers, "n", "i").orderBy("sequence").collect()] == [f"n{'9' * k}" for k in (1, 19, 25, 30)]
    wording = " ".join(f"W{i}" for i in range(20))
    titles = spark.createDataFrame([(1, wording + " rest"), (2, ""), (3, "W0 W1")], "k int, t string")
    known = spark.createDataFrame([(wording,)], "w string")
    got = {r["k"]: (r["prefix_words"], r["stripped_title"]) for r in T.normative_prefix_strip(titles, "k", "t", known, "w").collect()}
    assert got == {1: (20, "REST"), 2: (0, ""), 3: (0, "W0 W1")}
    spans = cleaning.span_keys(spark.createDataFrame([(" ".join(f"T{i}" for i in range(20)) + " end",)], "r string"), "r")
    assert "".join(f"T{i}" for i in range(20)) in {r["span"] for r in spans.collect()}
    paths = spark.createDataFrame([("|".join(str(i) for i in range(12)),)], "path string")
    assert filters.relation_project(paths, "databook").first()["levels"] == [str(i) for i in range(12)]


def test_written_tables_are_dropped(spark):
    from docweave import session

    kept = session.cut_lineage(spark.range(5))
    assert kept.count() == 5 and session.WRITTEN
    folder = session.WRITTEN[-1]
    session.drop_written(spark)
    assert not session.WRITTEN
    import os

    assert not os.path.exists(folder.removeprefix("file:"))


def test_containment_with_short_codes_and_edges(spark):
    """Codes shorter than an anchor, codes that begin or end with a separator, several places in a text, long texts."""
    rnd = random.Random(8)
    docs = ["A", "AB1", "AB-1", "X-000000012345", "X-000000012345-A", "-Q7", "Q7-", "ZZ", "Y.55.66", "--"]
    texts = ["a", "xa a", "ab1 ab-1", "copy x-000000012345-a", "x-0000000123456", "r-q7", "r -q7", "q7-", "q7-z", "zzz zz", "y.55.667 y.55.66", "nothing", "--", "", None]
    texts += [" ".join(rnd.choices(docs, k=300))]
    index = M.document_index(spark.createDataFrame([(d,) for d in docs], "document string"))
    asked = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    keys = sorted(r["document_key"] for r in index.collect())
    inside = lambda text, code: any((p == 0 or not text[p - 1].isalnum()) and not text[p + len(code):p + len(code) + 1].isalnum() for p in range(len(text)) if text.startswith(code, p))
    loose = lambda x: "".join(c for c in x if c.isalnum())
    want = set()
    for i, t in asked.select("i", codes.request_key("raw")).collect():
        held = [k for k in keys if loose(k) and inside(t, k)]
        want |= {(i, a) for a in held if not any(b != a and loose(a) in loose(b) and (len(loose(b)) > len(loose(a)) or len(b) > len(a)) for b in held)}
    assert {tuple(r) for r in M.containment_match(asked, "i", "raw", index).collect()} == want
    short = spark.createDataFrame([("x-0000",), ("0000000123",), ("x-000000012345",), ("55.66",), ("000000012345-a",)], "raw string")
    got = {tuple(r) for r in M.reverse_containment_match(short, "raw", index).collect()}
    assert got == {("X-000000012345", "X-000000012345"), ("55.66", "Y.55.66"), ("000000012345-A", "X-000000012345-A")}
    assert M.containment_match(asked, "i", "raw", index.limit(0)).collect() == []


def test_a_text_offers_no_more_than_its_length(spark):
    index = M.document_index(spark.createDataFrame([(f"CODE-{i:012d}-{'AB' * (i % 5)}",) for i in range(50)], "document string"))
    value = "CODE-000000000007-ABAB AND " * 30
    offered = M.offers(spark.createDataFrame([(value,)], "v string"), F.col("v"), index)
    assert offered.count() <= len(value)


def test_only_partitions_the_codes_ask_for_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"P{i % 6}") for i in range(60)], "entry int, kind string")
    catalog = K.partitioned_catalog(rows.coalesce(1), str(tmp_path / "catalog"), "kind")
    rules, known = [("_CVL_", ["P1", "P4"]), ("_ELE_", ["P2"])], [f"P{i}" for i in range(6)]
    frame = lambda *xs: spark.createDataFrame([(x,) for x in xs], "code string")
    prune = lambda *xs: K.partition_prune_by_code(catalog, "kind", frame(*xs), "code", rules, known)
    some = prune("a_cvl_1", None, "", "x")
    assert sorted({r["kind"] for r in some.collect()}) == ["P1", "P4"] and some.count() == 20
    plan = some._jdf.queryExecution()
    assert "dynamicpruning" in plan.optimizedPlan().toString().lower()
    read = [m for m in _metrics(plan.executedPlan()) if "staticFilesNum" in m]
    assert [(m["staticFilesNum"], m["numFiles"], m["numPartitions"]) for m in read] == [(6, 2, 2)]
    assert sorted({r["kind"] for r in prune("nothing").collect()}) == known  # no rule fires: all of them
    assert prune().count() == 60


def _metrics(plan):
    """The metrics of every node of an executed plan."""
    kind, held = plan.nodeName(), {}
    names = plan.metrics().keys().iterator()
    while names.hasNext():
        name = names.next()
        held[name] = plan.metrics().apply(name).value()
    below = [plan.executedPlan()] if "AdaptiveSparkPlan" in kind else [plan.plan()] if "QueryStage" in kind else [plan.children().apply(i) for i in range(plan.children().size())]
    return [held, *(m for p in below for m in _metrics(p))]


def test_identifiers_by_line_rules(spark):
    label = r"(?:CERTIFICADO|CERTIFICATE|CERT\.?)"
    pages = {
        1: "Certificado Nº: AB-1/1 emitido", 2: "cert. emitido em obra sob NÚMERO 77-2.", 3: "x\n Certificado do lote \n\n  X3.9 \nfim", 4: "Lote de certificado final  5A4\n12/05/2024",
        5: "(Etiqueta) T-5; certificado ZZ9", 6: "certificado 12/05/2024", 7: None, 8: "", 9: "certificado N 12 certificado 99", 10: "CERTIFICADO\nsem numero",
    }
    df = spark.createDataFrame([(i, 1, t) for i, t in pages.items()], "doc int, page int, content string")
    rules = T.label_rules(label, "(Etiqueta)")
    got = {r["doc"]: (r["value"], r["score"], r["candidates"], r["confidence"]) for r in T.identifier_extract_ranked(df, ["doc"], "page", "content", rules, label).collect()}
    assert got == {
        1: ("AB-1/1", 100, 1, "high"), 2: ("77-2", 92, 1, "high"), 3: ("X3.9", 82, 1, "review"), 4: ("5A4", 88, 1, "high"),
        5: ("T-5", 110, 2, "high"), 9: ("12", 100, 2, "review"),
    }
    assert T.label_rules(label) == T.label_rules(label, "  ")


def test_pages_hold_every_row_once_and_read_one_folder(spark):
    from docweave.operators import filters

    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(30)]), rnd.choice(["a", "b", None]), i // 2) for i in range(2000)]  # repeated rows and ties
    frame = spark.createDataFrame(rows, "k int, v string, n int")
    pages = filters.Pages(frame, [F.desc("k")], 5)
    got = [tuple(r) for number in (1, 2, 3, 4) for r in pages.page(number, 600).collect()]
    by_rest = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2]))
    assert got == sorted(by_rest, key=lambda r: (r[0] is None, -(r[0] or 0))) and pages.rows == 2000
    assert [tuple(r) for r in pages.page(1500, 1).collect()] == [got[1499]]
    assert len(pages.folders) > 1 and sum(first < 1500 and end > 1499 for _, first, end in pages.folders) == 1
    pages.stored = pages.stored.filter("_folder <> 0")  # a page past the first folder doesn't need it
    assert [tuple(r) for r in pages.page(1500, 1).collect()] == [got[1499]]
    assert pages.page(5, 600).collect() == [] and filters.Pages(frame.limit(0), [F.asc("k")]).page(1, 10).collect() == []


def test_prefix_support_against_brute_force(spark):
    rnd = random.Random(2)
    grains = [["d"], ["t", "s"], ["t"]]
    rows = [(i, rnd.choice("pqrs"), rnd.choice(["x", "y", None]), rnd.choice("mn"), rnd.choice(["", None, "A", "B", "BB", "C"])) for i in range(60)] + [(99, "alone", "z", "m", "A")]
    frame = spark.createDataFrame(rows, "i int, d string, t string, s string, prefix string")
    at = {"d": 1, "t": 2, "s": 3}

    def chosen(row):
        for grain in grains:
            key = [row[at[k]] for k in grain]
            counts = {}
            for other in rows:
                if other is not row and other[4] and None not in key and [other[at[k]] for k in grain] == key:
                    counts[other[4]] = counts.get(other[4], 0) + 1
            if counts:
                return max((n, len(p), p) for p, n in counts.items())
        return (0, 0, "")

    got = {r["i"]: (r["support"], len(r["pattern"]), r["pattern"]) for r in T.prefix_pattern_support(frame, "i", grains, "prefix").collect()}
    assert got == {row[0]: chosen(row) for row in rows}


def test_days_of_several_streams_close_behind_the_slowest(spark, tmp_path):
    from docweave.streaming import twins

    kinds = {"runs": {"ready": F.col("kind") == "ok", "failed": F.col("kind") == "bad"}, "orders": {"orders": F.lit(True)}, "notes": {"notes": F.col("kind").isNotNull()}}
    schema = "at timestamp, kind string"

    def put(name, batch, rows):
        frame = spark.createDataFrame([(t, k) for t, k in rows], "t string, kind string").select(F.to_timestamp("t").alias("at"), "kind")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        sources = {n: (spark.readStream.schema(schema).parquet(str(tmp_path / n)), "at", c, "1 day") for n, c in kinds.items()}
        per = twins.stream_daily_comparison(sources, start="2024-01-02")
        job = per.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={i}")))
        job.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()

    day = lambda n, hour=5: f"2024-01-{n:02d} {hour:02d}:00:00"
    put("runs", 0, [(day(1), "ok"), (day(2), "ok"), (day(9), "bad"), (None, "ok")])
    put("orders", 0, [(day(2), "a"), (day(9), None)])
    put("notes", 0, [(day(3), "n")])
    run()
    # Late for its own stream, but the notes are not past that day: counted.
    put("runs", 1, [(day(3, 23), "bad"), (day(3), "ok")])
    put("notes", 1, [(day(8), None), (day(8), "n")])
    run()
    batch = X.daily_comparison({n: (spark.read.schema(schema).parquet(str(tmp_path / n)), "at", c) for n, c in kinds.items()}, "2024-01-02", "2024-12-31")
    read = lambda: {r["day"]: tuple(r["m"])[1:] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("day").agg(F.max(F.struct("batch", "ready", "failed", "orders", "notes")).alias("m")).collect()}
    want = {r["day"]: (r["ready"], r["failed"], r["orders"], r["notes"]) for r in batch.collect()}
    assert read() == want and set(want) == {f"2024-01-{n:02d}" for n in (2, 3, 8, 9)}
    # Behind all three watermarks, one batch after they moved: the day is final.
    for name, kind in (("runs", "other"), ("orders", "b"), ("notes", None)):
        put(name, 2, [(day(9), kind)])
    run()
    put("orders", 3, [(day(2), "late"), (day(9), "b")])
    run()
    assert read() == want | {"2024-01-09": (0, 1, 3, 0)}
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    try:
        with pytest.raises(ValueError):
            run()
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")


def test_catalog_rank_deals_entries_evenly(spark):
    words = ["RED", "BLUE", "BOLT", "GEAR"]
    entries = [(i, " ".join(w for j, w in enumerate(words) if i >> j & 1), "note" if i % 3 else "RED NOTE", f"UNIT|{words[i % 4]}") for i in range(64)]
    catalog = spark.createDataFrame(entries * 2, "entry_id int, description string, notes string, path string")
    queries = spark.createDataFrame([("ZZ", "red bolt gear"), ("ZZ", "red bolt gear"), ("GEAR-BOLT", ""), ("ZZ", None), (None, "red")], "code string, title string")
    out = S.catalog_rank_topk(queries, catalog, {"BRAND": ["PROMO"]}, k=3)
    # entries meet the queries in tasks of their own, and no table of distinct pairs stands before the scores
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "HashAggregate" not in plan
    got = sorted((r["code"], r["title"], r["place"], r["entry_id"], r["score"], r["title_hits"]) for r in out.collect())
    firsts = {}
    for i, d, n, p in sorted(entries):
        firsts.setdefault((d, n, p), i)
    want = []
    for (d, n, p), i in firsts.items():
        d, n, p = (f" {' '.join(v.upper().replace('|', ' ').split())} " for v in (d, n, p))
        pts = [9 if f" {w} " in d else 7 if f" {w} " in n else 4 if f" {w} " in p else 0 for w in ("RED", "BOLT", "GEAR")]
        hits = sum(v > 0 for v in pts)
        phrases = sum(15 if w in d else 10 if w in n else 0 for w in ("RED BOLT", "BOLT GEAR"))
        score = sum(pts) + phrases + (80 if "RED BOLT GEAR" in d else 0) + (18 if hits >= 2 else 0)
        want.append((score, hits / 3, -i, hits))
    best = sorted([w for w in want if w[0] >= 12 and w[3]], reverse=True)[:3]
    assert [g for g in got if g[0] == "ZZ"] == [("ZZ", "red bolt gear", k + 1, -w[2], w[0], w[3]) for k, w in enumerate(best)]
    assert {g[0] for g in got} <= {"ZZ", "GEAR-BOLT"}


def test_catalog_score_best_deals_entries_evenly(spark):
    entries = [(i, f"VALVULA RED PART {i % 7}", "MOTOR" if i % 2 else "", f"UNIT|BOOK|{i % 3}") for i in range(40)]
    catalog = spark.createDataFrame(entries * 2, "entry_id int, description string, notes string, path string")
    targets = spark.createDataFrame([(1, "valvula red motor", "x"), (2, "red part", "x"), (3, "nothing alike", "x"), (4, None, None)], "doc int, title string, discipline string")
    out = S.catalog_score_best(targets, "doc", catalog, [("VALVULA", "VALVULA")], [("MOTOR", "MOTOR")])
    # entries meet the profiles in tasks of their own; a pair that meets on several ways is scored once
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    got = {r["doc"]: (r["outcome"], r["score"], r["runner_score"]) for r in out.collect()}
    # kind 65, three shared tokens 12, three of three (PART is the fourth) tokens 21, subject 58
    assert got[1] == ("conflict", 156, 156) and got[3] == ("none", 0, 0) and got[4] == ("none", 0, 0)
    assert got[2][0] == "none"


def test_title_compose_rewrites_each_part_once(spark):
    rows = spark.createDataFrame([("Relatório de  inspeção", 'TAG: "x (a (b) c) - - y', "M-01"), ("n/a", "#REF! | a", None), (None, "(", " - "), ('"', '""', "")], "k string, d string, t string")
    nested = rows.select(*[C.title_part(c).alias(c) for c in "kdt"])
    assert C.title_parts(rows, {f"{c}1": c for c in "kdt"}).select("k1", "d1", "t1").collect() == nested.collect()
    plan = T.title_compose(rows, "k", "d", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("IDENTIFICA") <= 15  # five patterns name it for each of the three parts


def test_family_vote_deals_documents_without_a_supporter(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kinds = "document string, family string, kind string, subjects array<string>, tokens array<string>, discipline string, seq long"
        records = spark.createDataFrame([(f"d{i}", f"f{i % 40}", "K", [], ["w"], "", i) for i in range(400)], kinds)
        evidence = spark.createDataFrame([("d0", "a|b|c"), ("d40", "a|b|c")], "document string, path string")
        out = E.family_evidence_vote(records, evidence, "document")
        sizes = [n for _, n in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
        assert sum(sizes) == 400 and max(sizes) < 200  # in one task before, as all of them look up null
        got = {r["document"]: (r["verdict"], r["support"], r["total"]) for r in out.collect()}
        assert got["d80"] == ("accepted", 2, 2) and got["d1"] == ("none", 0, 0) and got["d0"][1:] == (1, 1)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
