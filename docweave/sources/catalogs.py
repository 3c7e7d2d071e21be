"""Catalogs, histories, evidence files and request lists as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes, dates, text
from ..operators.keyed import carry_forward, first_by, keep_first, keep_last, running_by_block


def catalog_volume_review(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Row counts (catalog, row_count) against expected ones (catalog, expected)."""
    both = expected.join(counts, "catalog", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    ratio = F.col("row_count") / F.col("expected")
    verdict = F.when(F.col("row_count") == 0, "error").when((ratio < 0.5) | (ratio > 2), "warning").otherwise("ok")
    return both.select("catalog", "expected", "row_count", verdict.alias("verdict"))


def catalog_status(builtin: DataFrame, pinned: DataFrame) -> DataFrame:
    """Source and count in use per catalog; a pinned replacement wins over the built-in one."""
    p = pinned.select("catalog", F.col("source").alias("_s"), F.col("row_count").alias("_n"))
    both = builtin.join(p, "catalog", "left")
    return both.select(
        "catalog",
        F.coalesce("_s", "source").alias("source"),
        F.coalesce("_n", "row_count").alias("row_count"),
        F.col("row_count").alias("builtin_count"),
        F.when(F.col("_s").isNotNull(), "replaced").otherwise("built_in").alias("origin"),
    )


def continuation_fold(df: DataFrame, keys: list[str], order: str, path: str, note: str) -> tuple[DataFrame, DataFrame]:
    """(entries with the number of their notes, notes with the entry they continue).

    A row with a complete path is an entry. A later row that starts with ``*`` or names documents is a
    note of the entry before it. Notes stay rows, so an entry may have any number of them.
    """
    is_entry = codes.path_complete(path)
    folded = carry_forward(df.withColumn("_entry", is_entry), keys, order, F.when(is_entry, F.col(order)), "entry_row")
    is_note = ~F.col("_entry") & text.text(note).rlike(r"(?i)^\*|DOCUMENTOS?:")
    notes = folded.filter(is_note & F.col("entry_row").isNotNull()).select(*keys, "entry_row", order, F.col(note).alias("note"))
    per_entry = notes.groupBy(*keys, "entry_row").agg(F.count(F.lit(1)).alias("notes"))
    entries = df.filter(is_entry).withColumn("entry_row", F.col(order)).join(per_entry, keys + ["entry_row"], "left")
    return entries.withColumn("notes", F.coalesce("notes", F.lit(0))).drop("entry_row"), notes


def path_extract(c: Column | str) -> Column:
    """Longest complete ``a|b|c`` fragment inside a free note; plain cells stay as they are."""
    raw = text.text(c)
    found = F.transform(F.regexp_extract_all(raw, F.lit(r"([^()\n|]+(?:\|[^()\n|]+){2,})"), F.lit(1)), lambda x: F.trim(x))
    longest = F.array_max(F.transform(F.filter(found, codes.path_complete), lambda x: F.struct(F.length(x).alias("n"), x.alias("p"))))
    return F.when(raw.rlike(r"[()\n]"), F.coalesce(longest["p"], raw)).otherwise(raw)


def path_extract_clean(df: DataFrame, column: str, unit: Column, placeholder: str = r"^(UNIT-?X|X{2,}|NOME UNIDADE|UNIDADE)$",
                       name: str = "clean_path") -> DataFrame:
    """Path without the note around it and with the real unit in place of a placeholder root."""
    levels = codes.path_levels(path_extract(column))
    fixed = text.let(levels, lambda p: F.when(
        text.norm(F.get(p, F.lit(0))).rlike(placeholder), F.concat(F.array(unit), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    ).otherwise(p))
    return df.withColumn(name, F.array_join(fixed, "|"))


def level_base_build(df: DataFrame, levels: list[str]) -> DataFrame:
    """Work code of a hierarchy row: the deepest numeric prefix among its levels, the first on a tie."""
    found = F.filter(F.transform(F.array(*levels), codes.leading_code), lambda c: c != "")
    best = F.array_max(
        F.transform(found, lambda c, i: F.struct(codes.wbs_depth(c).alias("d"), (-i).alias("i"), c.alias("c")))
    )
    return df.withColumn("_b", best).filter("_b is not null").withColumn("base_code", F.col("_b.c")).drop("_b")


def allocation_history_ingest(files: list[DataFrame], prefix: str) -> DataFrame:
    """Union of history files; the code comes from the column, else from the file name; last row per evidence key."""
    rows = files[0]
    for f in files[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    in_name = F.regexp_extract(F.upper("source"), rf"({prefix}-\d{{4}}-\d{{4}})", 1)
    own = text.text("allocation")
    rows = rows.withColumn("allocation", F.when(own != "", own).otherwise(in_name)).withColumn("document_key", text.canon_key("document"))
    rows = rows.filter((F.col("document_key") != "") & (F.col("document_key") != "FIM"))
    for c in ("status", "path", "comment", "return_date"):
        rows = rows.withColumn(f"_{c}", text.norm(c))
    key = ["document_key", "allocation", "_status", "_path", "_comment", "_return_date"]
    return keep_last(rows, key, ["source_row"]).drop("_status", "_path", "_comment", "_return_date")


def control_ingest(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(control rows, latest row per document key); the lowest row of the sheet is the latest."""
    rows = df.withColumn("document_key", text.canon_key("document")).filter("document_key <> ''")
    return rows, keep_last(rows, ["document_key"], ["row_no"])


def evidence_quarantine(df: DataFrame, prefix: str, date_column: str | None = "return_date",
                        useful: list[str] | None = None) -> DataFrame:
    """Evidence rows with the batch code they belong to and, where they cannot be used, why.

    The row's own code must equal the one in the file name; a code must be known; a date must lie in
    the year of the code; at least one of the ``useful`` columns must hold something.
    """
    own = F.when(codes.batch_sequence("allocation", prefix).isNotNull(), F.upper(text.text("allocation"))).otherwise(F.lit(""))
    named = F.regexp_extract(F.upper("source"), rf"({prefix}-\d{{4}}-\d{{4}})", 1)
    out = df.withColumn("_own", own).withColumn("_named", named)
    out = out.withColumn("allocation", F.when(F.col("_own") != "", F.col("_own")).otherwise(F.col("_named")))
    year = F.right("allocation", F.lit(4))
    given = F.lit("") if date_column is None else F.substring(dates.date_text(date_column), 1, 4)
    nothing = text.all_of([text.text(c) == "" for c in useful]) if useful else F.lit(False)
    reason = (
        F.when((F.col("_own") != "") & (F.col("_named") != "") & (F.col("_own") != F.col("_named")), "file_disagrees")
        .when(F.col("allocation") == "", "code_missing")
        .when((given != "") & (given != year), "wrong_year")
        .when(nothing, "nothing_useful")
        .otherwise("")
    )
    return out.withColumn("reject_reason", reason).drop("_own", "_named")


def comment_merge(columns: list[Column | str]) -> Column:
    """Distinct comments in column order joined by `` | ``; dates and placeholders are no comments."""
    values = F.array(*[text.text(c) for c in columns])
    kept = F.filter(
        values, lambda v: (v != "") & ~v.rlike(r"\b(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\b") & ~text.norm(v).rlike(r"^(N/A|NA|-|)$")
    )
    first_only = lambda vs: text.let(
        F.transform(vs, text.norm), lambda ns: F.filter(vs, lambda v, i: F.array_position(ns, text.norm(v)) == i + 1)
    )
    return F.array_join(text.let(kept, first_only), " | ")


def request_list_normalize(df: DataFrame, column: str, order: str) -> DataFrame:
    """One request per code in a line: split, bullets and quotes dropped, path and extension removed, first kept per key."""
    pieces = F.split(F.col(column), r"[\t;|\r\n]+")
    rows = df.select(order, F.posexplode(pieces).alias("part_no", "piece"))
    v = F.regexp_replace(text.text("piece"), r"^[\s•*\-]+\s+", "")
    v = F.regexp_replace(v, r"""^['"]+|['",;]+$""", "")
    v = F.element_at(F.split(v, r"[\\/]"), -1)
    rows = rows.withColumn("request", text.text(v)).withColumn("request_key", codes.request_key("request"))
    rows = rows.filter((F.col("request_key") != "") & (F.col("request_key") != "FIM"))
    return first_by(rows, ["request_key"], [order, "part_no"], [order, "part_no", "request"])


def file_manifest_filter(df: DataFrame, name: str, size: str, extensions: str, own_output: str) -> DataFrame:
    """Files with the reason they are left out, '' for the ones to read."""
    base = F.element_at(F.split(F.col(name), r"[\\/]"), -1)
    reason = (
        F.when(base.rlike(r"^~\$"), "temporary")
        .when(base.rlike(r"^\."), "hidden")
        .when(F.col(size) <= 0, "empty")
        .when(F.upper(base).rlike(own_output), "own_output")
        .when(~F.lower(base).rlike(rf"\.({extensions})$"), "extension")
        .otherwise("")
    )
    return df.withColumn("skip_reason", reason)


def text_line_extract(lines: DataFrame, tag_pattern: str, size_pattern: str, cancelled: str = "CANCELADA") -> DataFrame:
    """Entity rows of a text dump (file, line_no, line) with the page they stand on.

    A form feed starts a page; the page number is a running sum, taken block by block.
    """
    feeds = F.length("line") - F.length(F.replace("line", F.lit("\f"), F.lit("")))
    paged = running_by_block(lines, ["file"], "line_no", feeds, "_feeds")
    return (
        paged.withColumn("tag", F.upper(F.regexp_extract("line", rf"(?i)\b({tag_pattern})\b", 1)))
        .filter("tag <> ''")
        .select(
            "file", "line_no", "tag", F.regexp_extract("line", size_pattern, 1).alias("size"),
            (F.col("_feeds") + 1).alias("page"), F.upper("line").rlike(rf"\b{cancelled}\b").alias("cancelled"),
        )
    )


def catalog_build(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Complete rows only, one per combination of the normal column values, the first kept."""
    complete = df.filter(text.all_of([text.text(c) != "" for c in columns]))
    keyed = complete
    for c in columns:
        keyed = keyed.withColumn(f"_{c}", text.norm(c))
    return keep_first(keyed, [f"_{c}" for c in columns], [order]).select(*df.columns)


def write_partitioned(df: DataFrame, path: str, partition: str) -> None:
    """One folder per partition value; readers that filter on it touch only what they need."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def catalog_union_dedupe(catalogs: list[DataFrame], keys: list[str], order: str, last_wins: bool = True) -> DataFrame:
    """Catalogs laid over each other: the later catalog wins a key, inside one catalog the later row does."""
    ranked = [c.withColumn("catalog_rank", F.lit(i)) for i, c in enumerate(catalogs)]
    rows = ranked[0]
    for c in ranked[1:]:
        rows = rows.unionByName(c, allowMissingColumns=True)
    keyed = rows
    for c in keys:
        keyed = keyed.withColumn(f"_{c}", text.norm(c))
    pick = keep_last if last_wins else keep_first
    return pick(keyed, [f"_{c}" for c in keys], ["catalog_rank", order]).select(*rows.columns)


def complement_union(own: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """Own rows, and embedded rows for keys the own table lacks."""
    return own.unionByName(embedded.join(own.select(key), key, "left_anti"))


def partitioned_catalog(catalog: DataFrame, path: str, partition: str) -> DataFrame:
    """The catalog written in folders by ``partition`` and read back as a partitioned table."""
    write_partitioned(catalog, path, partition)
    columns = [c for c in catalog.columns if c != partition]
    return catalog.sparkSession.read.schema(catalog.select(*columns, partition).schema).parquet(path)


def partitions_for_codes(codes: DataFrame, code: str, rules: list[tuple[str, list[str]]], known: list[str]) -> DataFrame:
    """``partition``: what the rules (pattern, partitions) ask for that some code matches; all known ones if none does.

    One aggregation over the codes; the result has a row a partition at most.
    """
    value = text.norm(code)
    fires = lambda pattern: F.coalesce(F.max(value.rlike(pattern)), F.lit(False))
    asked = F.flatten(F.array(*[F.when(fires(p), F.array(*[F.lit(x) for x in parts])).otherwise(F.array().cast("array<string>")) for p, parts in rules]))
    every = F.array(*[F.lit(x) for x in known])
    one = codes.agg(F.array_intersect(every, asked).alias("asked"))
    return one.select(F.explode(F.when(F.size("asked") > 0, F.col("asked")).otherwise(every)).alias("partition"))


def partition_prune_by_code(catalog: DataFrame, partition: str, codes: DataFrame, code: str, rules: list[tuple[str, list[str]]], known: list[str]) -> DataFrame:
    """Rows of a partitioned catalog that the codes can refer to.

    The partitions asked for are known only when the query runs; as the small side of a semi-join (a row a partition,
    hence the broadcast) they prune the scan, so that folders of other partitions are never read.
    """
    needed = partitions_for_codes(codes, code, rules, known).filter(F.col("partition").isin(*known))
    return catalog.join(F.broadcast(needed.withColumnRenamed("partition", partition)), partition, "left_semi")
