"""Votes, conflicts and priorities over evidence rows. Every vote counts per (key, value) first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes, dates, revision, text
from ..session import cut_lineage, in_methods
from .keyed import attach, first_by, latest_by, top_k_by


def source_priority_coalesce(base: DataFrame, key: str, sources: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """First non-blank value in source order, with the name of the source; each source has one row per key."""
    out = base
    for i, (_, src) in enumerate(sources):
        out = out.join(src.select(key, F.struct(F.col(value).alias("v")).alias(f"_s{i}")), key, "left")
    found = [F.when(text.text(F.col(f"_s{i}.v")) != "", F.struct(F.col(f"_s{i}.v").alias("v"), F.lit(name).alias("s"))) for i, (name, _) in enumerate(sources)]
    out = out.withColumn("_p", F.coalesce(*found))
    return out.select(*base.columns, F.coalesce("_p.v", F.lit("")).alias(value), F.coalesce("_p.s", F.lit("none")).alias("provenance"))


def classify_outcome(status: Column | str, comment: Column | str) -> Column:
    """rejected, accepted, pending or unknown of status and comment; rejection is tested first."""
    joined = F.trim(F.concat_ws(" ", text.norm(status), text.norm(comment)))
    # The wordings of each outcome.
    rejected = (
        r"\b(RECUSAD[OA]?|REJEITAD[OA]?|NAO ALOCAD[OA]?|DEVOLVID[OA]?|NAO ACEIT[OA]?|PENDENTE DE CORRECAO|CORRIGIR|AJUSTAR"
        r"|REENVIAR|REFAZER|FAVOR VERIFICAR|DIVERGENCIA)\b"
    )
    accepted = r"\b(ALOCAD[OA]?|ACEIT[OA]?|APROVAD[OA]?|CONCLUID[OA]?|CONFIRMAD[OA]?|OK)\b"
    negated = r"\bNAO\s+(ALOCAD|ACEIT|APROVAD|CONCLUID|CONFIRMAD)"
    pending = r"\b(PENDENTE|EM ANALISE|AGUARDANDO|EM TRATAMENTO|EM ANDAMENTO)\b"
    return text.let(joined, lambda j: F.when(j.rlike(rejected), "rejected").when(j.rlike(accepted) & ~j.rlike(negated), "accepted")
                    .when(j.rlike(pending), "pending").otherwise("unknown"))


def latest_evidence(df: DataFrame, key: str, prefix: str, cols: list[str]) -> DataFrame:
    """Best evidence per document by batch, return date, file time and row; equal ranks that disagree are a conflict."""
    rank = F.struct(
        (F.coalesce(codes.batch_year("allocation", prefix), F.lit(0)).cast("bigint") * 100000 + F.coalesce(codes.batch_sequence("allocation", prefix), F.lit(0))).alias("a"),
        dates.day_number("return_date").alias("b"), F.col("source_modified").alias("c"), F.col("source_row").alias("d"),
    )
    rows = df.withColumn("_rank", rank).withColumn("outcome", classify_outcome("status", "comment"))
    # rank and outcome together are one row per key, rank and outcome; the conflict test needs no more
    per = rows.groupBy(key, "_rank", "outcome").agg(F.max(F.struct(*cols)).alias("_row"))
    top = per.groupBy(key).agg(F.max("_rank").alias("_rank"))
    best = per.join(top, [key, "_rank"]).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_row").alias("_row"), F.max("outcome").alias("outcome")
    )
    conflict = F.col("_n") > 1
    return best.select(
        key, conflict.alias("conflict"), F.when(conflict, "conflict").otherwise(F.col("outcome")).alias("outcome"), "_row.*"
    )


def exact_then_other_year(docs: DataFrame, evidence: DataFrame, prefix: str) -> DataFrame:
    """Path of (document, batch): confirmations before allocations, several paths are a conflict, else other years.

    ``docs`` has document_key and allocation; ``evidence`` document_key, allocation, kind, path, date
    columns. Evidence is reduced per (document, batch, kind, path) before it is joined.
    """
    seq, year = codes.batch_sequence("allocation", prefix), codes.batch_year("allocation", prefix)
    ev = evidence.withColumn("s", seq).withColumn("y", year).withColumn("pk", codes.path_key("path")).filter("s is not null and pk <> ''")
    per_path = ev.groupBy("document_key", "s", "y", "kind", "pk").agg(
        F.max(F.struct(dates.day_number("return_date").alias("a"), F.col("source_modified").alias("b"), F.col("source_row").alias("c"), "path")).alias("r"),
        F.count(F.lit(1)).alias("n"),
    )
    per_kind = per_path.groupBy("document_key", "s", "y", "kind").agg(
        F.count(F.lit(1)).alias("paths"), F.max("r").alias("r"), F.sum("n").alias("support")
    )
    place = F.when(F.col("kind") == "confirmation", 0).otherwise(1)
    best = per_kind.groupBy("document_key", "s", "y").agg(F.min(F.struct(place.alias("p"), "kind", "paths", F.col("r.path").alias("path"), "support")).alias("b"))
    other = per_kind.groupBy("document_key", "s").agg(F.collect_set("y").alias("years"))
    asked = docs.withColumn("s", seq).withColumn("y", year)
    out = asked.join(best, ["document_key", "s", "y"], "left").join(other, ["document_key", "s"], "left")
    years = F.array_sort(F.filter(F.coalesce("years", F.array().cast("array<int>")), lambda v: v != F.col("y")))
    status = (
        F.when(F.col("s").isNull(), "allocation_missing")
        .when(F.col("b").isNotNull() & (F.col("b.paths") > 1), "conflict")
        .when(F.col("b").isNotNull(), "found")
        .when(F.size(years) > 0, "wrong_year_only")
        .otherwise("not_found")
    )
    return out.select(
        *docs.columns, status.alias("path_status"), F.coalesce("b.kind", F.lit("")).alias("path_kind"),
        F.when(status == "found", F.col("b.path")).otherwise(F.lit("")).alias("path"),
        F.coalesce("b.support", F.lit(0)).alias("support"),
        F.when(status == "wrong_year_only", F.array_join(years.cast("array<string>"), ", ")).otherwise(F.lit("")).alias("other_years"),
    )


def majority_vote(df: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Most frequent level vector per key; on equal counts the smaller signature wins."""
    sig = F.concat_ws("|", *[text.norm(c) for c in levels])
    has = text.any_of([text.text(c) != "" for c in levels])
    counts = df.filter(has).groupBy(*keys, sig.alias("_sig")).agg(
        F.count(F.lit(1)).alias("votes"), *[F.min(text.text(c)).alias(c) for c in levels]
    )
    return first_by(counts, keys, [-F.col("votes"), "_sig"], ["votes", *levels])


def backoff_vote(df: DataFrame, key: str, contexts: list[tuple[str, list[Column], int, int]], value: str) -> DataFrame:
    """Value for every row from its most specific context that agrees well enough.

    A context is ``(name, parts, minimum, share in percent)`` and is skipped when a part is empty. The
    top value needs the minimum count, the share, and a lead of 2 unless its share reaches 86 percent.
    Votes are reduced to one verdict per context key before rows see them.
    """
    value_key = text.norm(value)
    def ctx(name: str, parts: list[Column]) -> Column:
        blank = text.any_of([F.coalesce(p, F.lit("")) == "" for p in parts])
        return F.when(~blank, F.concat_ws("\u0001", F.lit(name), *parts))

    keyed = df.select(key, text.text(value).alias("_v"), value_key.alias("_k"), *[ctx(n, p).alias(f"_c{i}") for i, (n, p, _, _) in enumerate(contexts)])
    long = keyed.filter("_k <> ''").select("_v", "_k", F.explode(F.array_compact(F.array(*[F.col(f"_c{i}") for i in range(len(contexts))]))).alias("_c"))
    votes = long.groupBy("_c", "_k").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("v"))
    top = votes.groupBy("_c").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("t"), F.count(F.lit(1)).alias("values"))
    runner = votes.join(top.select("_c", F.col("t.v").alias("_tv")), "_c").filter("v <> _tv").groupBy("_c").agg(F.max("n").alias("second"))
    name = F.split("_c", "\u0001").getItem(0)
    minimum = F.create_map(*[x for n, _, m, _ in contexts for x in (F.lit(n), F.lit(m))])
    share = F.create_map(*[x for n, _, _, s in contexts for x in (F.lit(n), F.lit(s))])
    count = -F.col("t.m")
    verdict = top.join(runner, "_c", "left").withColumn("name", name).withColumn("count", count)
    lead = F.col("count") - F.coalesce("second", F.lit(0))
    verdict = verdict.filter(
        (F.col("count") >= minimum[F.col("name")])
        & (F.col("count") * 100 >= F.col("total") * share[F.col("name")])
        & ~(F.col("second").isNotNull() & (lead < 2) & (F.col("count") * 100 < F.col("total") * 86))
    ).select("_c", F.struct(F.col("t.v").alias("v"), "count", "total", "name").alias("r"))
    out = keyed
    for i in range(len(contexts)):
        out = attach(out, verdict.select(F.col("_c").alias(f"_c{i}"), F.col("r").alias(f"_r{i}")), [f"_c{i}"])
    chosen = F.coalesce(*[F.col(f"_r{i}") for i in range(len(contexts))])
    out = out.withColumn("_r", chosen)
    return out.select(
        key, F.coalesce("_r.v", F.lit("")).alias("voted"), F.coalesce("_r.name", F.lit("")).alias("context"),
        F.coalesce("_r.count", F.lit(0)).alias("support"), F.coalesce("_r.total", F.lit(0)).alias("total"),
    )


def vote_confidence(context: Column, support: Column, total: Column) -> Column:
    exact = context.isin("A", "D") & (support >= 3) & (support * 100 >= total * 82)
    return F.when(context == "", "none").when(exact, "high").when(context == "E", "low").otherwise("medium")


def profile_evidence_vote(df: DataFrame, keys: list[str], document: str, path: str, minimum: int = 3, percent: int = 80) -> DataFrame:
    """Path most documents of a profile use, if enough of them and a large enough share do."""
    rows = df.select(*keys, codes.path_key(path).alias("pk"), text.text(path).alias("p"), F.col(document).alias("d")).filter("pk <> ''")
    docs = rows.groupBy(*keys, "pk", "d").agg(F.min("p").alias("p"))
    per = docs.groupBy(*keys, "pk").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("p"))
    top = per.groupBy(*keys).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "p")).alias("t"), F.count(F.lit(1)).alias("paths"))
    n = -F.col("t.m")
    ok = (n >= minimum) & (n * 100 >= F.col("total") * percent)
    verdict = F.when(ok, "accepted").when(F.col("paths") > 1, "conflict").otherwise("none")
    return top.select(*keys, verdict.alias("verdict"), F.when(ok, F.col("t.p")).otherwise(F.lit("")).alias("path"), n.alias("support"), "total")


FIELDS = ["revision", "status", "dispatch", "effective_date", "title", "allocation_status", "allocation", "path"]
HISTORY_FIELDS = FIELDS[1:]
CROSS_FIELDS = ["status", "dispatch", "effective_date", "allocation_status", "allocation", "path"]


def _values(df: DataFrame, kind: str) -> dict[str, Column]:
    """Normal value of every field of technical or history rows."""
    posted = text.text("posting_status")
    values = {f: text.norm(f) if f in df.columns else F.lit("") for f in FIELDS}
    values["revision"] = revision.normal_revision("revision")
    # outer blanks do not outlive norm, so that it reads the columns themselves, each once
    values["status"] = text.norm("posting_status") if kind == "technical" else F.when(posted != "", text.norm("posting_status")).otherwise(text.norm("status"))
    return values


def _bounds(df: DataFrame, key: str, kind: str, hashed: bool = False, fields: list[str] = FIELDS, per_revision: bool = True) -> DataFrame:
    """Smallest and greatest non-blank value (or its hash) of every field per document and, unless told otherwise, revision."""
    values = _values(df, kind)
    named = in_methods(df.select(key, *[values[f].alias(f) for f in dict.fromkeys([*fields, *(["revision"] if per_revision else [])])]), fields[0])
    shown = lambda f: F.when(F.col(f) != "", F.xxhash64(f) if hashed else F.col(f)).alias(f)
    rev = [F.col("revision").alias("rev")] if per_revision else []
    named = named.select(key, *rev, *[shown(f) for f in fields])
    return named.groupBy(key, *(["rev"] if per_revision else [])).agg(
        *[F.min(f).alias(f"lo_{f}") for f in fields], *[F.max(f).alias(f"hi_{f}") for f in fields]
    ).withColumn("kind", F.lit(kind))


def _differences(df: DataFrame, key: str, scope: str, fields: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"lo_{f}").alias("first_value"), F.col(f"hi_{f}").alias("last_value")) for f in fields])
    return df.select(key, F.lit(scope).alias("scope"), "rev", F.inline(F.filter(rows, lambda r: r["first_value"] != r["last_value"])))


def conflict_detect(technical: DataFrame, history: DataFrame | None = None, key: str = "document", hashed: bool = False,
                    fields: list[str] = FIELDS) -> DataFrame:
    """Fields whose non-blank values differ: among technical rows, in the history per revision, and across both.

    Two values differ exactly when the smallest and the greatest do, so one aggregation per document and
    revision carries everything; the three scopes are read off its result. ``hashed`` compares 64 bit
    hashes of the values: enough to name the fields, and the aggregation holds numbers only. Without a history
    revisions play no part. ``fields`` may name the only fields that matter.
    """
    if history is None:
        whole = _bounds(technical, key, "technical", hashed, fields, per_revision=False).withColumn("rev", F.lit(""))
        return _differences(whole, key, "technical", fields)
    bounds = lambda: [F.min(f"lo_{f}").alias(f"lo_{f}") for f in fields] + [F.max(f"hi_{f}").alias(f"hi_{f}") for f in fields]
    # both sides are read twice; stored, so that the rows are normalised once
    t = cut_lineage(_bounds(technical, key, "technical", hashed, fields))
    whole = t.groupBy(key).agg(*bounds()).withColumn("rev", F.lit(""))
    out = _differences(whole, key, "technical", fields)
    h = cut_lineage(_bounds(history, key, "history", hashed, fields))
    both = t.unionByName(h).filter("rev <> ''").groupBy(key, "rev").agg(*bounds(), F.countDistinct("kind").alias("kinds")).filter("kinds = 2")
    of = lambda scope: [f for f in scope if f in fields]
    for rows, scope, named in ((h, "history", of(HISTORY_FIELDS)), (both, "cross", of(CROSS_FIELDS))):
        out = out.unionByName(_differences(rows, key, scope, named)) if named else out
    return out


def conflict_values(technical: DataFrame, history: DataFrame, conflicts: DataFrame, row_id: str, key: str = "document") -> DataFrame:
    """Every value of every conflict with the row it stands in: ``key, scope, rev, field, value, kind, row_id``.

    A row is sent once, with the values of all its fields, and meets the conflicts of its document; a conflict takes the
    rows of its scope and revision. A document's rows may be many, so the join is one that can be split.
    """
    def offered(df: DataFrame, kind: str) -> DataFrame:
        values = [F.when(v != "", v).alias(f"_v_{f}") for f, v in _values(df, kind).items()]
        return in_methods(df.select(key, revision.normal_revision("revision").alias("_own"), F.lit(kind).alias("kind"), F.col(row_id).alias(row_id), *values), "_v_status")

    rows = offered(technical, "technical").unionByName(offered(history, "history"))
    met = attach(rows, conflicts.groupBy(key).agg(F.collect_list(F.struct("scope", "rev", "field")).alias("_in")), [key], "inner")
    met = met.select(key, "kind", row_id, "_own", *[f"_v_{f}" for f in FIELDS], F.inline("_in"))
    whole = (F.col("scope") == "technical") & (F.col("kind") == "technical")
    same = (F.col("rev") == F.col("_own")) & ((F.col("scope") == "cross") | ((F.col("scope") == "history") & (F.col("kind") == "history")))
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(f"_v_{f}")) for f in FIELDS])
    return met.filter(whole | same).select(key, "scope", "rev", "field", value.alias("value"), "kind", row_id).filter("value is not null")


def conflict_resolve_history(history: DataFrame, choices: DataFrame, key: str, row_id: str) -> DataFrame:
    """Keep only the chosen row of a document's revision somebody decided on; other revisions stay.

    ``choices(key, row_id, rev)`` names a history row and its normal revision.
    """
    staged = history.withColumn("_rev", revision.normal_revision("revision"))
    out = attach(staged, choices.select(key, F.col("rev").alias("_rev"), F.col(row_id).alias("_chosen")), [key, "_rev"])
    return out.filter(F.col("_chosen").isNull() | (F.col(row_id) == F.col("_chosen"))).drop("_chosen", "_rev")


def conflict_summary(conflicts: DataFrame, key: str = "document") -> DataFrame:
    """One row per document: the conflicting fields, and whether any but the allocation fields conflict."""
    blocking = F.max(F.when(~F.col("field").isin("allocation", "allocation_status"), 1).otherwise(0))
    return conflicts.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("conflict_fields"), (blocking == 1).alias("blocking")
    )


def conflict_resolve(rows: DataFrame, choices: DataFrame, key: str, row_id: str) -> DataFrame:
    """Keep only the chosen row of documents somebody decided on."""
    out = attach(rows, choices.select(key, F.col(row_id).alias("_chosen")), [key])
    return out.filter(F.col("_chosen").isNull() | (F.col(row_id) == F.col("_chosen"))).drop("_chosen")


def consensus_value(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per field the value all non-blank rows agree on, else ''."""
    out = []
    for f in fields:
        n = F.when(text.norm(f) != "", text.norm(f))
        out.append(F.when(F.min(n) == F.max(n), F.min(F.when(text.norm(f) != "", text.text(f)))).otherwise(F.lit("")).alias(f))
    return df.groupBy(*keys).agg(*out)


def merge_duplicates(df: DataFrame, key: str, fields: list[str], confidence: str, source: str) -> DataFrame:
    """One row per key; a field whose values differ is blanked and marks the row; the worst confidence stays."""
    aggs = []
    for f in fields:
        n = F.when(text.norm(f) != "", text.norm(f))
        same = F.min(n) == F.max(n)
        aggs += [F.when(same, F.min(F.when(text.norm(f) != "", text.text(f)))).otherwise(F.lit("")).alias(f),
                 F.coalesce(F.min(n) != F.max(n), F.lit(False)).alias(f"{f}_ambiguous")]
    worst = F.min(F.when(F.col(confidence) == "low", 0).when(F.col(confidence) == "medium", 1).otherwise(2))
    out = df.groupBy(key).agg(
        *aggs, worst.alias("_w"), F.array_join(F.array_sort(F.collect_set(source)), " · ").alias("sources"), F.count(F.lit(1)).alias("merged_rows")
    )
    manual = text.any_of([F.col(f"{f}_ambiguous") for f in fields])
    return out.withColumn("confidence", F.when(F.col("_w") == 0, "low").when(F.col("_w") == 1, "medium").otherwise("high")).withColumn(
        "manual_review", manual
    ).drop("_w")


def grouped_reference(df: DataFrame, keys: list[str], description: str, trusted: Column) -> DataFrame:
    """The one trusted description per key, '' when there are none or several."""
    n = F.when(trusted & (text.norm(description) != ""), text.norm(description))
    d = F.when(trusted & (text.norm(description) != ""), text.text(description))
    return df.groupBy(*keys).agg(
        F.when(F.min(n) == F.max(n), F.min(d)).otherwise(F.lit("")).alias("reference_description"),
        F.countDistinct(n).alias("descriptions"),
    )


def description_preference(df: DataFrame, keys: list[str], score: Column, description: str, order: str) -> DataFrame:
    """Best description per key by score, then length, then text."""
    rows = df.withColumn("score", score.cast("bigint")).filter(text.text(description) != "")
    best = first_by(rows, keys, [-F.col("score"), -F.length(description), description, order], ["score", description])
    return best


def evidence_chain(base: DataFrame, key: str, sources: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """First source with a value; the first conflict met on the way travels along.

    Every source is a table ``key, value, conflict`` with one row per key.
    """
    out = base.select(key)
    for i, (_, s) in enumerate(sources):
        out = out.join(s.select(key, F.struct(F.col(value).alias("v"), F.col("conflict").alias("c")).alias(f"_s{i}")), key, "left")
    ok = [F.when(~F.col(f"_s{i}.c") & (text.text(F.col(f"_s{i}.v")) != ""), F.struct(F.col(f"_s{i}.v").alias("v"), F.lit(n).alias("s"), F.lit(i).alias("i"))) for i, (n, _) in enumerate(sources)]
    bad = [F.when(F.col(f"_s{i}.c"), F.struct(F.lit(n).alias("s"), F.lit(i).alias("i"))) for i, (n, _) in enumerate(sources)]
    out = out.withColumn("_ok", F.coalesce(*ok)).withColumn("_bad", F.coalesce(*bad))
    prior = F.when(F.col("_bad").isNotNull() & (F.col("_ok").isNull() | (F.col("_bad.i") < F.col("_ok.i"))), F.col("_bad.s")).otherwise(F.lit(""))
    return out.select(
        key, F.coalesce("_ok.v", F.lit("")).alias(value), F.coalesce("_ok.s", F.lit("none")).alias("evidence_source"), prior.alias("prior_conflict")
    )


def status_distribution(df: DataFrame, status: str) -> DataFrame:
    """Rows per normal status with one label, most frequent first."""
    return df.groupBy(text.norm(status).alias("status_key")).agg(F.min(status).alias("label"), F.count(F.lit(1)).alias("row_count")).orderBy(
        F.desc("row_count"), "status_key"
    )


def decision_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def signature_groups(df: DataFrame, fields: list[str], approvable: str) -> DataFrame:
    """Pending suggestions with identical evidence; a group can be approved at once when it has two and more."""
    sig = F.sha2(F.concat_ws("\u0001", *[text.norm(f) for f in fields]), 256)
    return df.filter(F.col(approvable)).groupBy(sig.alias("signature")).agg(
        F.count(F.lit(1)).alias("items"), *[F.min(f).alias(f) for f in fields]
    ).withColumn("group_approvable", F.col("items") > 1)


def duplicate_targets(df: DataFrame, target: str) -> DataFrame:
    """Targets that occur more than once."""
    return df.groupBy(F.upper(text.text(target)).alias("target_key")).agg(F.count(F.lit(1)).alias("uses"), F.min(target).alias("target")).filter(
        (F.col("uses") > 1) & (F.col("target_key") != "")
    )


def common_affix_pattern(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Longest common prefix and suffix of the names of a group.

    The common prefix of a set is the one of its smallest and greatest member; the suffix is the same on
    reversed names. Both are plain aggregates.
    """
    stem = F.regexp_replace(F.col(name), r"\.[^.]+$", "")
    g = df.withColumn("_s", stem).groupBy(*keys).agg(
        F.min("_s").alias("a"), F.max("_s").alias("b"), F.min(F.reverse("_s")).alias("ra"), F.max(F.reverse("_s")).alias("rb"),
        F.min(F.length("_s")).alias("shortest"), F.countDistinct("_s").alias("names"),
    )
    def lcp(x: str, y: str) -> Column:
        n = F.least(F.length(x), F.length(y))
        upto = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(F.col(x), F.lit(1), i) == F.substring(F.col(y), F.lit(1), i))
        return F.array_max(upto)

    g = g.withColumn("p", lcp("a", "b")).withColumn("q", lcp("ra", "rb"))
    g = g.withColumn("q", F.least(F.col("q"), F.col("shortest") - F.col("p")))
    return g.select(
        *keys, "names", F.substring(F.col("a"), F.lit(1), F.col("p")).alias("prefix"),
        F.reverse(F.substring(F.col("ra"), F.lit(1), F.col("q"))).alias("suffix"), F.col("p").alias("prefix_length"),
    )


def affix_template(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """File name template of a group: common prefix, a variable part (a sequence when all parts are numbers), suffix."""
    pattern = common_affix_pattern(df, keys, name)
    stem = F.regexp_replace(F.col(name), r"\.[^.]+$", "")
    joined = attach(df.withColumn("_s", stem).select(*keys, "_s"), pattern, keys, "inner")
    middle = F.substring(F.col("_s"), F.col("prefix_length") + 1, F.length("_s") - F.col("prefix_length") - F.length("suffix"))
    digits = F.regexp_extract("prefix", r"(\d*)$", 1)
    numeric = joined.groupBy(*keys).agg(F.min((F.concat(digits, middle).rlike(r"^\d+$")).cast("int")).alias("numeric"))
    out = pattern.join(numeric, keys)
    head = F.when(F.col("numeric") == 1, F.regexp_replace("prefix", r"\d+$", "")).otherwise(F.col("prefix"))
    token = F.when(F.col("numeric") == 1, F.lit("{sequence}")).otherwise(F.lit("{certificate}"))
    return out.withColumn("template", F.when(F.col("names") == 1, F.lit("{original}")).otherwise(F.concat(head, token, F.col("suffix"))))


def catalog_stats(df: DataFrame, keys: list[str], tag: str, wbs: str, cancelled: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct(F.when(text.norm(tag) != "", text.norm(tag))).alias("tags"),
        F.countDistinct(wbs).alias("work_codes"), F.count_if(~cancelled).alias("active"), F.count_if(cancelled).alias("cancelled"),
    )


def samples_per_group(df: DataFrame, keys: list[str], value: str, order: str, k: int = 8) -> DataFrame:
    """First k distinct values per key in input order."""
    first = df.filter(text.norm(value) != "").groupBy(*keys, text.norm(value).alias("_n")).agg(F.min(F.struct(order, value)).alias("f"))
    return top_k_by(first.select(*keys, "f.*"), keys, [F.col(order), F.col(value)], k, "sample_no")


def family_evidence_vote(records: DataFrame, evidence: DataFrame, key: str, source: str = "history") -> DataFrame:
    """Path the documents of the same family support: accepted, conflict or none per document.

    ``records`` has one row per document: key, family, kind, subjects (array), tokens (array), discipline,
    seq. ``evidence`` has key and path. A candidate counts when its path is complete, the kinds are equal
    or one is unknown, the subjects meet where the target has any, and kind or a third of the words match.

    Documents of one family are never paired. Titles are compared inside their family. Supporters are counted per (family, kind, subjects, path),
    and where words decide per distinct word set, so equal documents are one row; a document's own vote is
    taken off again. Order among equally supported paths never changes the verdict, because such paths
    cannot reach the share, so totals are only formed for a single supporting document.
    """
    from .similarity import SIG, token_similarity_join

    join = lambda c: F.array_join(F.array_sort(c), SIG)
    r = records.select(key, "family", F.coalesce("kind", F.lit("")).alias("kind"), join("subjects").alias("subj"), F.array_sort(F.array_distinct("tokens")).alias("tok"),
                       text.norm("discipline").alias("disc"), "seq").withColumn("sig", F.array_join("tok", SIG)).filter("family <> ''")
    # Records and candidates are read many times below; each is made once.
    r = cut_lineage(r)
    ev = evidence.filter(codes.path_complete("path")).groupBy(key, codes.path_key("path").alias("pk")).agg(F.min(text.text("path")).alias("path"))
    ev = cut_lineage(ev)
    c = cut_lineage(ev.join(r, key))
    facts = [F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.min("path").alias("path")]
    split = lambda c_: F.filter(F.split(c_, SIG), lambda s: s != "")
    meets = (F.col("subj") == "") | F.arrays_overlap(split(F.col("subj")), split(F.col("c_subj")))
    # candidates of the same known kind
    same = c.filter("kind <> ''").groupBy("family", "kind", F.col("subj").alias("c_subj"), "pk").agg(*facts)
    profiles = cut_lineage(r.select("family", "kind", "subj", "sig", "tok").distinct())
    wide = profiles.filter("kind <> ''").select("family", "kind", "subj").distinct().join(same, ["family", "kind"]).filter(meets)
    wide = wide.groupBy("family", "kind", "subj", "pk").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("path").alias("path"))
    part1 = profiles.filter("kind <> ''").join(wide, ["family", "kind", "subj"]).select("family", "kind", "subj", "sig", "pk", "n", "lo", "hi", "path", F.col("n").alias("kn"))
    # one side of unknown kind: the words decide
    by_sig = c.groupBy("family", F.col("kind").alias("c_kind"), F.col("subj").alias("c_subj"), F.col("sig").alias("c_sig"), "pk").agg(*facts)
    # Either the target's kind is unknown, or the candidate's; only these meet, inside their family.
    sets = lambda rows, known: rows.filter(F.col("kind") != "" if known else F.col("kind") == "").select("family", F.col("tok").alias("t0"))

    def alike(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = token_similarity_join(left, right, "t0", 32, ["family"])
        return pairs.select("family", F.col("left_sig").alias("sig"), F.col("right_sig").alias("c_sig"))

    unknown = profiles.filter("kind = ''").drop("tok").join(alike(sets(profiles, False), c.select("family", F.col("tok").alias("t0"))), ["family", "sig"]).join(by_sig, ["family", "c_sig"])
    known = profiles.filter("kind <> ''").drop("tok").join(alike(sets(profiles, True), sets(c, False)), ["family", "sig"]).join(by_sig.filter("c_kind = ''"), ["family", "c_sig"])
    part2 = unknown.unionByName(known).filter(meets)
    part2 = part2.select("family", "kind", "subj", "sig", "pk", "n", "lo", "hi", "path", F.lit(0).cast("bigint").alias("kn"))
    who = ["family", "kind", "subj", "sig"]
    support = part1.unionByName(part2).groupBy(*who, "pk").agg(
        F.sum("n").alias("n"), F.sum("kn").alias("kn"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("path").alias("path")
    )
    # targets with the same profile and the same own paths share one verdict
    own = ev.groupBy(key).agg(join(F.collect_set("pk")).alias("own"))
    t = r.join(own, key, "left").withColumn("own", F.coalesce("own", F.lit("")))
    counts_itself = (F.col("kind") != "") | (F.col("sig") != "")
    t = t.withColumn("own", F.when(counts_itself, F.col("own")).otherwise(F.lit("")))
    groups = t.select(*who, "own").distinct()
    mine = F.array_contains(split(F.col("own")), F.col("pk")).cast("int")
    g = groups.join(support, who).withColumn("m", F.col("n") - mine).withColumn("km", F.col("kn") - F.when(F.col("kind") != "", mine).otherwise(F.lit(0))).filter("m > 0")
    total = g.groupBy(*who, "own").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("paths"), F.max(F.struct("m", "km", "pk", "path", "lo", "hi")).alias("top"))
    out = attach(t, total, [*who, "own"])
    n, all_ = F.col("top.m"), F.col("total")
    need = lambda pct: F.ceil(n * pct / 100)
    kinds_ok = lambda pct: (F.col("kind") == "") | (F.col("top.km") >= need(pct))
    blurred = (F.col("subj") == "") & (F.col("paths") > 1) & (n * 100 < all_ * (90 if source == "history" else 93))
    if source == "history":
        strong = (n >= 2) & (n * 100 >= all_ * 60) & kinds_ok(60)
    else:
        strong = (n >= 2) & (n * 100 >= all_ * 72) & kinds_ok(70)
    # a single supporter: its score decides, and it is the one of the two bounds that is not the target
    out = out.withColumn("_one", F.when(F.col("top.lo") == F.col(key), F.col("top.hi")).otherwise(F.col("top.lo")))
    other = r.select(F.col(key).alias("_one"), F.col("kind").alias("o_kind"), F.col("subj").alias("o_subj"), F.col("tok").alias("o_tok"), F.col("disc").alias("o_disc"), F.col("seq").alias("o_seq"))
    lone = (n == 1) & (F.col("paths") == 1)
    # few documents have a single supporter; the others look nobody up and are dealt by their own key
    out = attach(out.withColumn("_one", F.when(lone, F.col("_one"))), other, ["_one"], spread=key)
    gap = F.abs(F.col("seq") - F.col("o_seq"))
    score = (
        F.lit(50) + F.when((F.col("kind") != "") & (F.col("kind") == F.col("o_kind")), 35).otherwise(0)
        + F.when(F.arrays_overlap(split(F.col("subj")), split(F.col("o_subj"))), 38).otherwise(0) + text.half_up(text.set_similarity(F.col("tok"), F.col("o_tok")) * 30)
        + F.when((F.col("disc") != "") & (F.col("disc") == F.col("o_disc")), 10).otherwise(0) + F.lit(18 if source == "history" else 4)
        + F.coalesce(F.greatest(F.lit(0), 10 - F.least(F.lit(10), gap)), F.lit(0))
    )
    if source == "history":
        strong = strong | (lone & (score >= 118))
    strong = F.coalesce(strong, F.lit(False))
    verdict = F.when(F.col("total").isNull(), "none").when(blurred, "conflict").when(strong, "accepted").when(F.col("paths") > 1, "conflict").otherwise("none")
    return out.select(key, verdict.alias("verdict"), F.when(verdict == "accepted", F.col("top.path")).otherwise(F.lit("")).alias("path"),
                      F.coalesce("top.m", F.lit(0)).alias("support"), F.coalesce("total", F.lit(0)).alias("total"))
