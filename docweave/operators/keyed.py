"""Per-key building blocks that stay spread out when one key holds a large part of the rows.

* one row per key: ``max``/``min`` of a struct, so every task reduces its rows before the shuffle;
* first k per key: ``row_number() <= k``, which Spark limits per task before the shuffle;
* per-key facts back on rows: a join that adaptive execution can split where a key is hot;
* running values over an integer order: block by block, so that one long group is many blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _struct(cols: list[Column | str], prefix: str) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"{prefix}{i}") for i, c in enumerate(cols)])


def _payload(cols: list[Column | str]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])


def latest_by(df: DataFrame, keys: list[str], order: list[Column | str], cols: list[Column | str],
              where: Column | None = None) -> DataFrame:
    """The row with the greatest ``order`` tuple per key; equal tuples fall to the greatest row text."""
    value = F.struct(_struct(order, "o").alias("o"), _payload(cols).alias("p"))
    best = F.max(F.when(where, value) if where is not None else value)
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.p.*")


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], cols: list[Column | str]) -> DataFrame:
    """The row with the smallest ``order`` tuple per key."""
    value = F.struct(_struct(order, "o").alias("o"), _payload(cols).alias("p"))
    return df.groupBy(*keys).agg(F.min(value).alias("_best")).select(*keys, "_best.p.*")


def top_k_by(df: DataFrame, keys: list[str], order: list[Column], k: int, number: str = "rank") -> DataFrame:
    """At most ``k`` rows per key, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(w)).filter(F.col(number) <= k)


def attach(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "left", spread: str | None = None) -> DataFrame:
    """Join ``facts`` (one row per key) to rows, with rows of hot keys split over tasks.

    ``facts`` usually comes out of an aggregation on the same keys. Joined as it is, its partitions would
    be reused and adaptive execution could not split a skewed key of ``df``. The hash of the keys as a
    further join key changes no result but gives both sides a shuffle of their own, and such a join is
    split at run time. Facts small enough are broadcast by Spark after it has seen their size. Rows with a null key
    meet nothing; ``spread`` names a column to deal them by, where they may be too many for one task.
    """
    tag = F.xxhash64(*[F.col(k) for k in keys])
    own = F.when(reduce(Column.__or__, [F.col(k).isNull() for k in keys]), F.xxhash64(spread)).otherwise(tag) if spread else tag
    return df.withColumn("_key_hash", own).join(facts.withColumn("_key_hash", tag), keys + ["_key_hash"], how).drop("_key_hash")


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key in input order."""
    rest = [c for c in df.columns if c not in keys]
    return first_by(df, keys, order, rest).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return latest_by(df, keys, order, rest).select(*df.columns)


def running_by_block(df: DataFrame, keys: list[str], order: str, value: Column, name: str,
                     block_rows: int = 100_000) -> DataFrame:
    """Running sum of ``value`` in ``order`` (an integer), inclusive.

    Rows are cut into blocks of the order value. Sums run inside a block; the blocks of one group are
    summed up beforehand, which leaves one row per block for the group-wide window.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block_rows).cast("bigint")).withColumn("_value", value)
    totals = cut.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carried, keys + ["_block"], "left")
    return joined.withColumn(name, (F.sum("_value").over(inside) + F.col("_carry")).cast("bigint")).drop(
        "_block", "_value", "_carry"
    )


def carry_forward(df: DataFrame, keys: list[str], order: str, value: Column, name: str,
                  block_rows: int = 100_000) -> DataFrame:
    """Last non-null ``value`` at or before each row in ``order``, block by block."""
    cut = df.withColumn("_block", F.floor(F.col(order) / block_rows).cast("bigint")).withColumn("_value", value)
    last = cut.groupBy(*keys, "_block").agg(
        F.max(F.when(F.col("_value").isNotNull(), F.struct(F.col(order).alias("o"), F.col("_value").alias("v")))).alias("_l")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_block", F.last(F.col("_l.v"), ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carried, keys + ["_block"], "left")
    return joined.withColumn(
        name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carry"))
    ).drop("_block", "_value", "_carry")
