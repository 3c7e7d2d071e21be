"""Mixing sources to target weights by entropy balancing.

The rates closest to one in token-weighted relative entropy, under given token totals for the levels of one or more
margins (source, language, ...), are exponential tilts: rate = exp(sum of a multiplier for each level). The multipliers
solve a convex dual, by Newton steps over sums that Spark aggregates; the levels of one margin exclude each other, so
its block of the Hessian is diagonal. Rows are summed up to cells of equal levels first, and only cells are iterated.

Rates become copies without chance: floor(rate) for all, and one more for some of the rows of each size, largest sizes
first, with what is missing or too much carried on to the next smaller size, so that a cell's total misses its target by
about half of its smallest text. Which rows of a size is decided by hash; many rows of one size are split into buckets.

Result by case: a null or empty text has size 0 and takes nothing; a null source is a source, last in order; a cell
without words, or with target 0, has rate 0; equal rows may differ by one copy; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from docweave.operators.keyed import attach

from .common import forget, fresh, store, table

WEIGHTS, MAX_COPIES = (5, 2, 1), 3
TOLERANCE, MAX_STEPS = 1e-10, 60
#: Rows of one cell and size that are ranked together.
BUCKET_ROWS = 4096


def level(column: str) -> Column:
    """A key that is never null and tells a null from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """``target`` for each row of ``sources(source, level, source_size)``, one row per source.

    Sources by code point share the total by ``weights``, repeating, and stop at ``most`` times their size; the rest
    goes to the others by weight. With sources ordered by how soon they stop, the share per unit of weight is the
    largest of those that result when the sources before each one have stopped.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("w", weight).withColumn("stop", most * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("stop") / F.col("w"), "level").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    share = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    return ranked.withColumn("share", share).withColumn("target", F.least(F.max("share").over(every) * F.col("w"), "stop")).drop("w", "stop", "share")


def entropy_rates(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with ``rate``: one row per cell, with a key column for each margin and ``tokens``.

    ``targets[margin](margin, target)`` holds a row per level. Every step's cells are a stored table.
    """
    spark, path = cells.sparkSession, None
    state = cells.withColumn("eta", F.lit(0.0))
    for _ in range(MAX_STEPS):
        gaps = []
        for margin, wanted in targets.items():
            now = state.groupBy(margin).agg(F.sum(F.col("tokens") * F.exp("eta")).alias("current")).join(wanted, margin)
            newton = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("target") / F.col("current") - 1))
            step = now.select(margin, F.when((F.col("target") > 0) & (F.col("current") > 0), newton).otherwise(F.lit(float("-inf"))).alias("step"),
                              F.when((F.col("target") > 0) & (F.col("current") > 0), F.abs(newton)).otherwise(0.0).alias(f"gap_{len(gaps)}"))
            state = attach(state, step, [margin], "inner").withColumn("eta", F.col("eta") + F.col("step")).drop("step")
            gaps.append(f"gap_{len(gaps)}")
        state, new = store(state)
        worst = state.agg(F.max(F.greatest(*gaps, F.lit(0.0)))).first()[0]
        state = state.drop(*gaps)
        if path:
            forget(spark, path)
        path = new
        if worst is None or worst < TOLERANCE:
            return state.withColumn("rate", F.round(F.exp("eta"), 9)).drop("eta")
    raise ValueError(f"token targets not reached in {MAX_STEPS} steps: a gap of {worst:g} is left; the margins contradict each other")


def _carry(cell: pd.DataFrame) -> pd.DataFrame:
    """Of every (size, bucket) how many rows take one copy more than the others; one cell's sizes, largest first."""
    cell = cell.sort_values(["size", "bucket"], ascending=[False, True], kind="stable").reset_index(drop=True)
    extra, carry = [], 0.0
    for size, rows, rate in zip(cell["size"].tolist(), cell["rows"].tolist(), cell["rate"].tolist()):
        carry += (rate - int(rate)) * size * rows
        k = min(rows, max(0, round(carry / size))) if size else 0
        carry -= k * size
        extra.append(k)
    return cell[["cell", "size", "bucket"]].assign(extra=extra)


def copies(rows: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``rows(cell, size, rate, hash, ...)`` with ``copies``."""
    counted = rows.groupBy("cell", "size").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("long").alias("buckets"))
    spread = attach(rows, counted, ["cell", "size"]).withColumn("bucket", F.pmod("hash", "buckets")).drop("buckets")
    # One row per size and bucket: as many as there are sizes, and one more for every BUCKET_ROWS rows.
    sums = spread.groupBy("cell", "size", "bucket").agg(F.count("*").alias("rows"), F.max("rate").alias("rate"))
    chosen = sums.groupBy("cell").applyInPandas(_carry, "cell string, size long, bucket long, extra long")
    ranked = attach(spread, chosen, ["cell", "size", "bucket"])
    nth = F.row_number().over(Window.partitionBy("cell", "size", "bucket").orderBy("hash"))
    number = F.floor("rate") + F.when(nth <= F.col("extra"), 1).otherwise(0)
    return ranked.withColumn("copies", F.least(number, F.lit(max_copies)).cast("long")).drop("bucket", "extra")


def mix_sources(rows: DataFrame) -> DataFrame:
    """``rows(source, size, hash, ...)`` with ``source_size``, ``target``, ``rate`` and ``copies``."""
    keyed = rows.withColumn("cell", level("source"))
    sources, _ = store(capped_targets(keyed.groupBy("cell").agg(F.max("source").alias("source"), F.sum("size").alias("source_size")).withColumn("level", F.col("cell"))).drop("level"))
    cells = sources.select("cell", F.col("source_size").cast("double").alias("tokens"))
    rates = entropy_rates(cells, {"cell": sources.select("cell", "target")})
    facts = sources.drop("source").join(rates.select("cell", "rate"), "cell")
    return copies(attach(keyed, facts, ["cell"])).drop("cell")


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), F.xxhash64(id_col, F.xxhash64(text_col)).alias("hash")]


def source_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, size, source_size, target and taken (size times copies) of every row."""
    rows, _ = store(docs.select(*_narrow(docs, id_col, text_col, source_col)))
    mixed = mix_sources(rows)
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    (row,) = fresh(docs, "_row")
    kept, _ = store(docs.withColumn(row, F.monotonically_increasing_id()))
    rows, _ = store(kept.select(F.col(row).alias("row"), *_narrow(docs, id_col, text_col, source_col)[1:]))
    taken = mix_sources(rows).filter("copies > 0").select(F.col("row").alias(row), "copies")
    again, n = fresh(kept, "_again", "_copies")
    joined = kept.join(taken.withColumnRenamed("copies", n), row)
    return joined.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents"))


QUERIES = {"op10_source_mix": op10_source_mix}
