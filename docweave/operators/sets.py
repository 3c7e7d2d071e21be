"""Set operations on tables and token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Tables one below the other with the name of their source; missing columns are null."""
    named = [df.withColumn("origin", F.lit(name)) for name, df in sources.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def intersect_tokens(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def set_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def preservation_diff(original: DataFrame, output: DataFrame, keys: list[str], fields: list[str], approved: DataFrame) -> DataFrame:
    """What differs between two versions of a table: lost, added, and changed cells, approved or not.

    ``approved`` holds the keys and the field of every cell that may differ. Rows are hashed, so only
    rows that differ are compared cell by cell.
    """
    a = original.select(*keys, F.struct(*fields).alias("_a"), F.xxhash64(*fields).alias("_ha"))
    b = output.select(*keys, F.struct(*fields).alias("_b"), F.xxhash64(*fields).alias("_hb"))
    both = a.join(b, keys, "full_outer")
    lost = both.filter("_hb is null").select(*keys, F.lit("").alias("field"), F.lit("lost").alias("change"))
    added = both.filter("_ha is null").select(*keys, F.lit("").alias("field"), F.lit("added").alias("change"))
    differ = both.filter("_ha is not null and _hb is not null and _ha <> _hb")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")).alias("same")) for f in fields])
    changed = differ.select(*keys, F.inline(F.filter(cells, lambda c: ~c["same"]))).drop("same")
    marked = changed.join(approved.select(*keys, "field").distinct().withColumn("_ok", F.lit(True)), [*keys, "field"], "left")
    return lost.unionByName(added).unionByName(
        marked.select(*keys, "field", F.when(F.col("_ok"), "approved").otherwise("not_approved").alias("change"))
    )
