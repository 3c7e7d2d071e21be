"""Joins along dotted work codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import codes, text
from .keyed import attach, latest_by


def consensus_levels(df: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Per level the value all rows of a key share, '' where they differ or one is blank."""
    same = [
        F.when((F.min(text.norm(c)) == F.max(text.norm(c))) & (F.min(text.norm(c)) != ""), F.min(text.text(c))).otherwise(F.lit("")).alias(c)
        for c in levels
    ]
    return df.groupBy(*keys).agg(*same)


def wbs_longest_prefix_join(docs: DataFrame, key: str, wbs: str, discipline: str, base: DataFrame, levels: list[str]) -> DataFrame:
    """Levels of the deepest base code that is the work code or an ancestor of it.

    Several rows at that depth: the one whose deepest level names the discipline, if exactly one does,
    else the levels they share. The base is brought to one row per code (and per code and discipline)
    before it meets the documents.
    """
    deepest = F.coalesce(*[F.when(text.text(c) != "", text.norm(c)) for c in reversed(levels)], F.lit(""))
    rows = base.select(F.col("code").alias("_code"), *levels, deepest.alias("_leaf"))
    depth = F.coalesce(*[F.when(text.text(c) != "", F.lit(i + 1)) for i, c in reversed(list(enumerate(levels)))], F.lit(0))
    rows = rows.withColumn("_depth", depth)
    top = rows.groupBy("_code").agg(F.max("_depth").alias("_d"), F.count(F.lit(1)).alias("_n"))
    shared = consensus_levels(rows, ["_code"], levels).join(top, "_code")
    leafy = rows.join(top.select("_code", F.col("_d").alias("_depth")), ["_code", "_depth"])
    by_leaf = leafy.groupBy("_code", "_leaf").agg(F.count(F.lit(1)).alias("_ln"), *[F.min(c).alias(f"_l_{c}") for c in levels])
    by_leaf = by_leaf.filter("_ln = 1").drop("_ln")

    asked = docs.select(key, codes.wbs_norm(wbs).alias("work_code"), text.norm(discipline).alias("_leaf")).filter("work_code <> ''")
    # distinct work codes meet the base, not documents
    distinct = asked.select("work_code").distinct()
    cand = distinct.select("work_code", F.explode(codes.wbs_prefixes(F.col("work_code"))).alias("_code"))
    best = latest_by(cand.join(top.select("_code"), "_code"), ["work_code"], [codes.wbs_depth(F.col("_code"))], ["_code"])
    placed = best.join(shared, "_code")
    out = attach(asked, placed, ["work_code"], "left")
    out = out.join(by_leaf, ["_code", "_leaf"], "left")
    pick = lambda c: F.when((F.col("_n") > 1) & F.col(f"_l_{levels[0]}").isNotNull(), F.col(f"_l_{c}")).otherwise(F.col(c))
    rule = F.when(F.col("_code").isNull(), "none").when(F.col("_n") == 1, "single").when(
        F.col(f"_l_{levels[0]}").isNotNull(), "discipline"
    ).otherwise("shared")
    return out.select(
        key, "work_code", F.coalesce("_code", F.lit("")).alias("base_code"), rule.alias("rule"),
        *[F.coalesce(pick(c), F.lit("")).alias(c) for c in levels],
    )


def wbs_sibling_fallback(docs: DataFrame, key: str, wbs: str, base: DataFrame, levels: list[str]) -> DataFrame:
    """Levels shared by all base rows below the same first two parts."""
    group = lambda c: F.regexp_extract(c, r"^(\d+\.\d+)\.", 1)
    has = text.any_of([text.text(c) != "" for c in levels])
    siblings = base.filter(has).withColumn("_group", group(F.col("code"))).filter("_group <> ''")
    shared = consensus_levels(siblings, ["_group"], levels)
    asked = docs.select(key, codes.wbs_norm(wbs).alias("work_code")).withColumn(
        "_group", F.regexp_extract("work_code", r"^(\d+\.\d+)", 1)
    )
    out = attach(asked, shared, ["_group"], "left")
    return out.select(key, "work_code", *[F.coalesce(c, F.lit("")).alias(c) for c in levels])


def scope_wbs_narrow(cand: DataFrame, key: str, wanted: str, own: str, activity: str, same_discipline: str) -> DataFrame:
    """Narrow the candidates of a row: exact work code, else parent, else all; then activity, then discipline.

    Each step keeps the wider set where it would leave nothing.
    """
    rows = cand.withColumn("_w", codes.wbs_norm(wanted)).withColumn("_o", codes.wbs_norm(own)).withColumn("_a", codes.wbs_norm(activity))
    parent = F.when(codes.wbs_depth(F.col("_w")) >= 4, F.regexp_replace("_w", r"\.\d+$", "")).otherwise(F.lit(""))
    level = F.when(F.col("_o") == F.col("_w"), 1).when((parent != "") & (F.col("_o") == parent), 2).otherwise(3)
    rows = rows.withColumn("_level", level)
    act = (F.col("_a") == F.col("_w")).cast("int")
    dis = F.col(same_discipline).cast("int")
    facts = rows.groupBy(key).agg(
        F.min("_level").alias("_best"),
        *[F.max(F.when(F.col("_level") == n, act)).alias(f"_act{n}") for n in (2,)],
        *[F.max(F.when((F.col("_level") == n), dis)).alias(f"_dis{n}") for n in (1, 2, 3)],
        F.max(F.when((F.col("_level") == 2) & (act == 1), dis)).alias("_dis2a"),
    )
    j = attach(rows, facts, [key], "inner").filter(F.col("_level") == F.col("_best"))
    by_activity = (F.col("_best") == 2) & (F.col("_act2") == 1)
    j = j.filter(~by_activity | (act == 1))
    has_dis = F.when(by_activity, F.col("_dis2a")).when(F.col("_best") == 1, F.col("_dis1")).when(F.col("_best") == 2, F.col("_dis2")).otherwise(F.col("_dis3"))
    j = j.filter((F.coalesce(has_dis, F.lit(0)) == 0) | (dis == 1))
    return j.withColumn("scope_level", F.when(by_activity, 2).otherwise(F.col("_best") * 1)).withColumn("by_activity", by_activity).select(
        *cand.columns, "scope_level", "by_activity"
    )
