"""Streaming twins, driven to their end over the given tables.

The result of a drained query is read back from a Parquet sink in the shared folder, like any table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweave.session import shared_folder
from docweave.sources.streams import parquet_stream
from docweave.streaming import twins as T

from . import duck as d, registry
from .registry import query


FILES = 6


def _stream(spark: SparkSession, sf_dir: str, table: str, folder: str, order: str | Column) -> DataFrame:
    """The table as a stream in order of arrival, in about FILES micro-batches."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    arrived = f"{folder}/arrived"
    place = F.col(order) if isinstance(order, str) else order
    bounds = rows.select(place.alias("place")).approxQuantile("place", [i / FILES for i in range(1, FILES)], 0.01)
    part = sum((place > b).cast("int") for b in bounds)
    for number in range(FILES):
        rows.filter(part == number).write.mode("append").parquet(arrived)
    files = len(spark.read.schema(rows.schema).parquet(arrived).inputFiles())
    return parquet_stream(spark, arrived, rows.schema, files_per_batch=-(-files // FILES))


def _drain(writer, folder: str) -> None:
    job = writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    job.awaitTermination()


def _register(name: str, oracle: str):
    def wrap(fn):
        registry.QUERIES[name] = fn
        registry.ORACLES[name] = oracle
        return fn

    return wrap


@_register("stream_latest_record", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) n from events) where n = 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    state = T.BucketState(spark, f"{folder}/state", "user_id", 16)
    _drain(T.stream_latest_record(_stream(spark, sf_dir, "events", folder, "event_id"), "user_id", ["event_id"], ["event_type"], state), folder)
    return state.read().select("user_id", "event_id", "event_type")


def _drain_days(per_day: DataFrame, names: list[str], folder: str) -> DataFrame:
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    _drain(per_day.writeStream.outputMode("update").foreachBatch(keep), folder)
    # a later batch replaces the counts of a day
    out = per_day.sparkSession.read.parquet(f"{folder}/out")
    return out.groupBy("day").agg(F.max(F.struct("batch", *names)).alias("m")).select("day", *[f"m.{n}" for n in names])


@_register("stream_daily_comparison", """select cast(cast(ts as date) as varchar) as day, count(*) filter (where event_type = 'view') ready, count(*) filter (where event_type = 'error') failed from events group by 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    counts = {"ready": F.col("event_type") == "view", "failed": F.col("event_type") == "error"}
    sources = {"events": (_stream(spark, sf_dir, "events", folder, "event_id"), "ts", counts, "1 day")}
    return _drain_days(T.stream_daily_comparison(sources), list(counts), folder)


@_register("stream_daily_comparison_sources", """select cast(day as varchar) as day, cast(sum(ready) as bigint) ready, cast(sum(failed) as bigint) failed, cast(sum(orders) as bigint) orders, cast(sum(urgent) as bigint) urgent, cast(sum(shipped) as bigint) shipped from (
  select cast(ts as date) as day, count(*) filter (where event_type = 'view') ready, count(*) filter (where event_type = 'error') failed, 0 orders, 0 urgent, 0 shipped from events group by 1 union all
  select cast(o_orderdate as date), 0, 0, count(*), count(*) filter (where o_orderpriority = '1-URGENT'), 0 from orders group by 1 union all
  select cast(l_shipdate as date), 0, 0, 0, 0, count(*) from lineitem group by 1) where day >= date '1996-01-01' group by 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    arrival = lambda c: F.unix_date(F.col(c).cast("date"))
    sources = {
        "events": (_stream(spark, sf_dir, "events", f"{folder}/events", "event_id"), "ts", {"ready": F.col("event_type") == "view", "failed": F.col("event_type") == "error"}, "1 day"),
        "orders": (_stream(spark, sf_dir, "orders", f"{folder}/orders", arrival("o_orderdate")), "o_orderdate", {"orders": F.lit(True), "urgent": F.col("o_orderpriority") == "1-URGENT"}, "1 day"),
        "shipped": (_stream(spark, sf_dir, "lineitem", f"{folder}/lineitem", arrival("l_shipdate")), "l_shipdate", {"shipped": F.lit(True)}, "3 days"),
    }
    return _drain_days(T.stream_daily_comparison(sources, start="1996-01-01"), ["ready", "failed", "orders", "urgent", "shipped"], folder)


@_register("stream_dedupe_requests", f"select distinct {d.request_key('props || user_id')} request_key from events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    rows = _stream(spark, sf_dir, "events", folder, "event_id").withColumn("raw", F.concat("props", F.col("user_id").cast("string")))
    first = T.stream_dedupe_requests(rows, "raw", "ts", delay="31 days")
    _drain(first.select("request_key").writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out")
