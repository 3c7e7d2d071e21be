"""Latest rows, choices, timelines and sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import codes, dates, revision, text
from ..session import cut_lineage, in_methods
from .keyed import latest_by, top_k_by


def order_revision() -> list[Column]:
    """Revision, source time, date, dispatch, row."""
    rank = revision.revision_rank(revision.normal_revision("revision"))
    return [rank, F.col("source_ts"), dates.day_number("effective_date"), (text.text("dispatch") != "").cast("int"), F.col("row_no")]


def order_history() -> list[Column]:
    """Modified, included, row."""
    return [dates.day_number("modified"), dates.day_number("included"), F.col("row_no")]


def newest_day(cols: list[str]) -> Column:
    return F.greatest(*[dates.day_number(c) for c in cols], F.lit(0).cast("bigint"))


def order_relation(cols: list[str]) -> list[Column]:
    """Revision, then the greatest of all dates, source time and row in milliseconds, then row."""
    at = F.greatest(newest_day(cols) * 86400000, F.col("source_ts"), F.col("row_no"))
    return [revision.revision_rank(revision.normal_revision("revision")), at, F.col("row_no"), F.col("source_ts")]


def order_row() -> list[Column]:
    return [F.col("row_no")]


def latest_record(df: DataFrame, key: str, order: list[Column], cols: list[str]) -> DataFrame:
    return latest_by(df, [key], order, cols)


def latest_nonempty_value(df: DataFrame, key: str, fields: list[str], order: list[Column]) -> DataFrame:
    """Per field the newest value that is not blank; one aggregation for all fields."""
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    staged = df.withColumn("_at", at)
    picks = [
        F.max(F.when(text.text(f) != "", F.struct(F.col("_at"), text.text(f).alias("v")))).alias(f"_b_{f}") for f in fields
    ]
    out = staged.groupBy(key).agg(*picks)
    return out.select(key, *[F.coalesce(F.col(f"_b_{f}.v"), F.lit("")).alias(f) for f in fields])


# Fields whose difference makes the rows of a document ambiguous.
SIGNATURE = [
    "revision", "_status", "dispatch", "effective_date", "path", "title", "format", "discipline", "document_type",
    "purpose", "allocation_status", "comment", "allocation_stage",
]


def record_choice(rows: DataFrame, key: str, hint: str | None, cols: list[str]) -> DataFrame:
    """The technical row of a document: none in the hinted sheet, several sheets or differing rows leave it open.

    Counts and the newest row come from one aggregation; rows carry a 64 bit signature instead of 13 fields.
    """
    posted = text.text("posting_status")
    staged = rows.withColumn("_status", F.when(posted != "", posted).otherwise(text.text("status")))
    exact = {"dispatch", "effective_date", "path"}
    parts = [revision.normal_revision(c) if c == "revision" else text.text(c) if c in exact else text.norm(c) for c in SIGNATURE]
    staged = in_methods(staged.withColumn("_sig", F.xxhash64(*parts)).withColumn("_name", text.norm("sheet")), "_sig")
    hinted = text.norm(hint) if hint else F.lit("")
    staged = staged.withColumn("_hint", hinted).withColumn("_use", (F.col("_hint") == "") | (F.col("_name") == F.col("_hint"))).withColumn("_sheet", F.xxhash64("_name"))
    use = F.col("_use")
    pick = lambda c: F.when(use, F.col(c))
    order = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order_revision())])
    blocked = text.norm("allocation_status") == "NAO ALOCADO"
    agg = staged.groupBy(key).agg(
        F.max("_hint").alias("_hint"), F.count(F.lit(1)).alias("all_rows"), F.count_if(use).alias("used_rows"),
        F.min(pick("_sheet")).alias("_s1"), F.max(pick("_sheet")).alias("_s2"), F.min(pick("_sig")).alias("_g1"), F.max(pick("_sig")).alias("_g2"),
        F.max(F.when(use, F.struct(order.alias("o"), F.struct(*cols).alias("p")))).alias("_best"),
        F.count_if(blocked).alias("blocked_all"), F.count_if(blocked & use).alias("blocked_used"),
    )
    choice = (
        F.when(F.col("used_rows") == 0, "sheet_mismatch")
        .when((F.col("_hint") == "") & (F.col("_s1") != F.col("_s2")), "ambiguous")
        .when((F.col("used_rows") > 1) & (F.col("_g1") != F.col("_g2")), "ambiguous")
        .otherwise("chosen")
    )
    blocked_rows = F.when(F.col("used_rows") == 0, F.col("blocked_all")).otherwise(F.col("blocked_used"))
    out = agg.withColumn("choice", choice).withColumn("any_blocked", blocked_rows > 0)
    return out.select(key, "choice", "any_blocked", *[F.when(F.col("choice") == "chosen", F.col(f"_best.p.{c}")).alias(c) for c in cols])


def status_for_revision(history: DataFrame, key: str) -> DataFrame:
    """Posting state per document and revision: incomplete, conflict or the one status."""
    posted = text.text("posting_status")
    raw = F.when(posted != "", posted).otherwise(text.text("status"))
    n = F.when(raw != "", text.norm(raw))
    named = in_methods(history.select(key, revision.normal_revision("revision").alias("rev"), raw.alias("raw"), n.alias("n"), "row_no"), "raw")
    g = named.groupBy(key, "rev").agg(
        F.count_if(F.col("raw") == "").alias("blank"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.min(F.struct("row_no", "raw")).alias("first"), F.count(F.lit(1)).alias("rows"),
    )
    state = F.when(F.col("blank") > 0, "incomplete").when(F.col("lo") != F.col("hi"), "conflict").otherwise("single")
    return g.select(key, "rev", state.alias("state"), F.when(state == "single", F.col("first.raw")).otherwise(F.lit("")).alias("posted_status"), "rows")


def revision_timeline(technical: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """One row per document and valid revision in order: status, counts, newest values, and the step that follows.

    A last revision whose status advances gets its successor as a predicted step. Steps stay rows.
    """
    rank = lambda: revision.revision_rank(F.col("rev"))
    t = technical.select(key, revision.normal_revision("revision").alias("rev"), "title", "dispatch", "row_no", F.lit(1).alias("tech"))
    h = history.select(key, revision.normal_revision("revision").alias("rev"), F.lit("").alias("title"), F.lit("").alias("dispatch"), "row_no", F.lit(0).alias("tech"))
    rows = t.unionByName(h).withColumn("_rank", rank()).filter("_rank >= 0")
    newest = lambda f: F.max(F.when(text.text(f) != "", F.struct("tech", "row_no", text.text(f).alias("v"))))
    steps = rows.groupBy(key, "rev", "_rank").agg(
        F.sum("tech").alias("records"), F.sum(1 - F.col("tech")).alias("events"), newest("title").alias("_t"), newest("dispatch").alias("_d")
    )
    posted = status_for_revision(history, key)
    steps = steps.join(posted, [key, "rev"], "left")
    status = F.when(F.col("state") == "single", F.col("posted_status")).when(F.col("state").isNotNull(), F.col("state")).otherwise(F.lit("not_posted"))
    steps = steps.select(
        key, "rev", F.col("_rank").alias("rank"), "records", "events", status.alias("step_status"),
        F.coalesce("_t.v", F.lit("")).alias("title"), F.coalesce("_d.v", F.lit("")).alias("dispatch"), F.lit(False).alias("predicted"),
    )
    top = latest_by(steps, [key], ["rank"], ["rev", "step_status"])
    following = revision.revision_next(F.col("rev"))
    advance = (revision.status_kind("step_status") == "advance") & (following != "")
    nxt = top.filter(advance).select(key, following.alias("rev")).withColumn("rank", rank())
    nxt = nxt.select(
        key, "rev", "rank", F.lit(0).cast("bigint").alias("records"), F.lit(0).cast("bigint").alias("events"), F.lit("not_posted").alias("step_status"),
        F.lit("").alias("title"), F.lit("").alias("dispatch"), F.lit(True).alias("predicted"),
    )
    out = steps.unionByName(nxt).join(top.select(key, F.col("rev").alias("_last")), key, "left")
    return out.withColumn("latest", (F.col("rev") == F.col("_last")) & ~F.col("predicted")).drop("_last")


def sequence_number_groups(groups: DataFrame, label: str, prefix: str, first: int, year: int) -> DataFrame:
    """Consecutive batch codes for groups sorted by label; one row per group goes in.

    A code holds four digits; groups beyond them have no code and are flagged as ``exhausted``.
    """
    ordered = enumerate_rows(groups, [text.norm(label), F.col(label)], "group_no", first)
    code = F.when(F.col("group_no") <= 9999, codes.batch_code(prefix, F.col("group_no"), F.lit(year))).otherwise(F.lit(""))
    return ordered.withColumn("batch_code", code).withColumn("exhausted", F.col("group_no") > 9999)


def enumerate_rows(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """Number rows of a whole table in order without bringing them into one task.

    Rows are range-partitioned and sorted; each partition is counted, and the counts of the partitions
    before it are added to the position inside. The sorted rows are written to the shared folder first, so
    that positions and counts come from the same rows even when an executor is lost in between.
    """
    tagged = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    fixed = cut_lineage(tagged)
    part = F.shiftright("_id", 33)
    counts = fixed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_min"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", "_min", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = fixed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return out.withColumn(name, (F.col("_id") - F.col("_min") + F.col("_before") + first).cast("bigint")).drop("_id", "_p", "_min", "_before")


def natural_key(c: Column | str) -> Column:
    """Sort text in which digit runs compare as numbers: each run is led by its length."""
    runs = F.regexp_extract_all(text.norm(c), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]+$"), text.let(F.regexp_replace(r, "^0+(?=[0-9])", ""), lambda n: F.concat(F.lpad(F.length(n).cast("string"), 10, "0"), n))).otherwise(r)), "")


def natural_sort_enumerate(df: DataFrame, name: str, tie: str, first: int = 1, number: str = "sequence") -> DataFrame:
    return enumerate_rows(df, [natural_key(name), F.col(name), F.col(tie)], number, first)


def retain_last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return top_k_by(df, keys, order, n, "_k").drop("_k")


def sequence_distance(a: Column, b: Column) -> Column:
    """Bonus of 10 for equal sequence numbers, one less per step, never below 0."""
    gap = F.abs(a - b)
    return F.when(gap.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.lit(10) - F.least(F.lit(10), gap))).cast("int")


def distinct_ordered_concat(df: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """Distinct normal values of a document, newest first, joined, and the first one.

    Equal values meet first, so a cell is built from the distinct values of a document only.
    """
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    per = df.filter(text.norm(value) != "").groupBy(key, text.norm(value).alias("_n")).agg(F.max(F.struct(at.alias("at"), text.text(value).alias("v"))).alias("b"))
    lists = per.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("b.at", "b.v")), asc=False).alias("l"))
    values = F.transform("l", lambda x: x["v"])
    return lists.select(key, F.array_join(values, " · ").alias("joined"), F.get(values, F.lit(0)).alias("first_value"), F.size("l").alias("distinct_values"))


def current_records_conflict(technical: DataFrame, conflicts: DataFrame, key: str, fields: list[str], cols: list[str]) -> DataFrame:
    """Newest technical row per document, with the relevant fields that conflict in its revision."""
    current = latest_record(technical, key, order_revision(), ["revision", *cols]).withColumn("rev", revision.normal_revision("revision"))
    relevant = conflicts.filter(F.col("field").isin(*fields) & (F.col("scope") != "technical"))
    per = relevant.groupBy(key, "rev").agg(F.array_join(F.array_sort(F.collect_set("field")), ", ").alias("conflict_fields"))
    return current.join(per, [key, "rev"], "left").withColumn("conflict_fields", F.coalesce("conflict_fields", F.lit("")))
