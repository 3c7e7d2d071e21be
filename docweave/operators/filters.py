"""Projections, filters, facets and searches over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import revision, text
from ..session import cut_lineage
from .keyed import latest_by, top_k_by

# Columns of the named projections.
PROJECTIONS = {
    "posting": ["document", "sheet", "title", "current_revision", "posting_status", "next_revision", "next_status", "dispatch", "effective_date"],
    "allocation_status": ["document", "sheet", "title", "current_revision", "allocation_status", "allocation", "allocation_stage"],
    "allocation": ["document", "sheet", "title", "current_revision", "allocation", "path", "purpose"],
    "comments": ["document", "sheet", "title", "current_revision", "posting_status", "comment"],
    "revisions": ["document", "sheet", "title", "current_revision", "posting_status", "next_revision", "next_status", "dispatch"],
    "dispatch": ["document", "sheet", "title", "current_revision", "posting_status", "dispatch", "effective_date"],
    "databook": ["document", "sheet", "title", "discipline", "path"],
    "missing": ["requested", "source"],
}


def relation_project(rows: DataFrame, kind: str, custom: list[str] | None = None) -> DataFrame:
    """One of the named projections or a custom one; columns a table lacks come out blank.

    The databook projection has all levels of the path as the array ``levels``.
    """
    names = custom if kind == "custom" else PROJECTIONS.get(kind, PROJECTIONS["posting"])
    names = names or PROJECTIONS["posting"][:5]
    cols = [text.text(c).alias(c) if c in rows.columns else F.lit("").alias(c) for c in names]
    if kind == "databook":
        parts = F.split(text.text("path"), r"\|")
        cols.append(F.transform(parts, lambda p: F.trim(p)).alias("levels"))
    return rows.select(*cols)


def open_attribute_headers(df: DataFrame, attributes: str, known: list[str]) -> DataFrame:
    """Distinct headers of the open attributes, the smallest label per key, without those a field already shows."""
    x = df.select(F.explode(attributes).alias("a")).select(text.text("a.header").alias("label"), text.norm("a.header").alias("header_key"))
    plain = [k.upper().translate(str.maketrans(text.ACCENTED, text.PLAIN)) for k in known]
    return x.filter((F.col("header_key") != "") & ~F.col("header_key").isin(*plain)).groupBy("header_key").agg(F.min("label").alias("label"))


def open_attribute_columns(df: DataFrame, key: str, attributes: str, headers: list[str], order: str) -> DataFrame:
    """Newest non-blank value per chosen header; the headers are named, so the pivot is one aggregation."""
    x = df.select(key, order, F.explode(attributes).alias("a")).select(key, order, text.norm("a.header").alias("h"), text.text("a.value").alias("v"))
    x = x.filter("v <> ''")
    picks = [F.max(F.when(F.col("h") == text.norm(F.lit(h)), F.struct(order, "v")))["v"].alias(h.lower().replace(" ", "_")) for h in headers]
    return x.groupBy(key).agg(*picks).na.fill("")


def relation_filter(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Rows that satisfy all given filters; rows in conflict pass all of them but the text query."""
    equal = {"status": "posting_status", "sheet": "sheet", "allocation_status": "allocation_status", "document_type": "document_type", "revision": "current_revision"}
    tests = [text.norm(col) == text.norm(F.lit(wanted[k])) for k, col in equal.items() if wanted.get(k)]
    if wanted.get("allocation"):
        tests.append(F.contains(text.norm("allocation"), text.norm(F.lit(wanted["allocation"]))))
    if wanted.get("comments") in ("yes", "no"):
        tests.append((text.text("comment") != "") == F.lit(wanted["comments"] == "yes"))
    query = F.lit(True)
    if wanted.get("query"):
        query = F.contains(text.norm(F.concat_ws(" ", "document", "title")), text.norm(F.lit(wanted["query"])))
    return rows.filter(query & (F.col("conflict") | text.all_of(tests)))


def column_contains_filter(df: DataFrame, wanted: dict[str, str], search: str, search_columns: list[str]) -> DataFrame:
    """Every named column contains its text, and some column contains the search text."""
    tests = [F.contains(text.norm(c), text.norm(F.lit(v))) for c, v in wanted.items()]
    if search:
        tests.append(text.any_of([F.contains(text.norm(c), text.norm(F.lit(search))) for c in search_columns]))
    return df.filter(text.all_of(tests))


def facet_options(df: DataFrame, facets: list[str], multi: list[str] | None = None, revisions: list[str] | None = None) -> DataFrame:
    """Distinct values per facet with a label, a count and a sort key; multi-valued columns are split first."""
    multi, revisions = multi or [], revisions or []
    def options(f: str) -> Column:
        found = F.split(text.text(f), r"\s*·\s*") if f in multi else F.array(text.text(f))
        return F.transform(found, lambda v: F.struct(F.lit(f).alias("facet"), v.alias("value")))

    values = [options(f) for f in facets]
    long = df.select(F.inline(F.concat(*values))).filter("value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    out = long.groupBy("facet", text.norm("value").alias("value_key")).agg(F.min("value").alias("label"), F.sum("n").cast("bigint").alias("row_count"))
    rank = revision.revision_rank(F.col("value_key"))
    return out.withColumn("sort_rank", F.when(F.col("facet").isin(*revisions) if revisions else F.lit(False), rank).otherwise(F.lit(0).cast("bigint")))


def search_score(document: Column, title: Column, query: Column) -> Column:
    return (
        F.when(document == query, 1000).when(F.startswith(document, query), 800).when(F.contains(document, query), 650)
        .when(F.startswith(title, query), 450).when(F.contains(title, query), 350).otherwise(0)
    )


def quick_search_topk(rows: DataFrame, document: str, title: str, queries: list[str], k: int = 8, order: list[Column] | None = None) -> DataFrame:
    """Best k documents per query. All queries are scored in one pass; only the best k per task are shuffled."""
    if order:
        rows = latest_by(rows, [document], order, [title])
    asked = [q for q in queries if len(q) >= 2]
    staged = rows.select(F.col(document).alias("document"), F.col(title).alias("title"), text.norm(document).alias("_d"), text.norm(title).alias("_t"))
    scored = F.array(*[F.struct(F.lit(q).alias("query"), search_score(F.col("_d"), F.col("_t"), text.norm(F.lit(q))).alias("score")) for q in asked])
    hits = staged.select("document", "title", F.inline(F.filter(scored, lambda s: s["score"] > 0)))
    return top_k_by(hits, ["query"], [F.desc("score"), F.asc("document")], k, "place")


def scope_semi_filter(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


class Pages:
    """A table in order, stored once, of which any page is read without the pages before it.

    Rows go to range partitions of the order, one folder each, and are counted there. A page is found from the counts,
    one number a partition, and read from the folders it lies in, one or two unless a page is longer than a folder.
    Rows that ``order`` leaves equal come in the order of their other columns, so pages neither share nor lose rows.
    A page past the end has no rows. Without ``folders`` adaptive execution gives them the size of its partitions.
    """

    def __init__(self, df: DataFrame, order: list[Column], folders: int | None = None):
        unordered = ("map", "variant")
        rest = [F.col(f.name) for f in df.schema.fields if not any(kind in f.dataType.simpleString() for kind in unordered)]
        self.columns, self.order = df.columns, [*order, *rest]
        spread = df.repartitionByRange(*([folders] if folders else []), *self.order).withColumn("_folder", F.spark_partition_id())
        self.stored = cut_lineage(spread, "_folder")
        counts = self.stored.groupBy("_folder").count().orderBy("_folder").collect()  # a row a partition
        self.folders, self.rows = [], 0
        for number, rows in counts:
            self.folders.append((number, self.rows, self.rows + rows))
            self.rows += rows

    def page(self, page: int, size: int) -> DataFrame:
        """Page ``page`` (from 1) of ``size`` rows."""
        low, high = (page - 1) * size, page * size
        held = [(number, first) for number, first, end in self.folders if first < high and end > low]
        rows = self.stored.filter(F.col("_folder").isin([number for number, _ in held]))
        return rows.orderBy(*self.order).offset(low - held[0][1] if held else 0).limit(size).select(*self.columns)


def result_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of a table read once: every task keeps the rows up to its end. For deep pages see ``Pages``."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def source_category(df: DataFrame, rules: list[tuple[str, Column]], default: str, name: str = "category") -> DataFrame:
    """Name of the first rule that holds."""
    return df.withColumn(name, F.coalesce(*[F.when(cond, F.lit(label)) for label, cond in rules], F.lit(default)))
