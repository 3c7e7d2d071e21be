"""Streaming forms of three batch jobs. Each ends with what its batch form gives on the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import codes
from ..operators.keyed import latest_by


def stream_latest_record(rows: DataFrame, key: str, order: list[str], cols: list[str], state: BucketState) -> DataStreamWriter:
    """Keep the newest row per key of a stream.

    Every micro-batch is reduced to one row per key, put next to the stored rows of the buckets its keys fall into and
    reduced again; other buckets are neither read nor written. A repeated batch reads what it read the first time and
    replaces its own result.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        fresh = latest_by(batch, [key], order, order + cols).withColumn(BUCKET, state.bucket()).persist()
        try:
            touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # no more than there are buckets
            if not touched:
                return
            old = state.read(before=batch_id, only=touched)
            both = fresh if old is None else old.withColumn(BUCKET, state.bucket()).select(*fresh.columns).unionByName(fresh)
            state.write(latest_by(both, [BUCKET, key], order, order + cols), touched, batch_id)
        finally:
            fresh.unpersist()

    return rows.writeStream.foreachBatch(upsert)


BUCKET = "_bucket"


class BucketState:
    """Rows by key in a shared place, in buckets of keys of which a batch writes only some.

    Batch ``n`` puts its buckets under ``batch=n`` and, last of all, a manifest that names for every bucket the batch that
    wrote it. The state before a batch is the highest complete manifest with a smaller number. It is looked for on the
    storage each time, so a restarted driver goes on where the last one ended, and a batch cut short leaves nothing that
    a reader sees. Buckets that neither of the last two manifests names are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _listed(self, *parts: str) -> list[str]:
        place = self._path("/".join([self.folder, *parts]))
        return [f.getPath().getName() for f in self._files.listStatus(place)] if self._files.exists(place) else []

    def _batches(self, *parts: str) -> list[int]:
        return sorted(int(name[6:]) for name in self._listed(*parts) if name.startswith("batch="))

    def _complete(self) -> list[int]:
        return [n for n in self._batches("manifest") if self._files.exists(self._path(f"{self.folder}/manifest/batch={n}/_SUCCESS"))]

    def _manifest(self, number: int) -> dict[int, int]:
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.folder}/manifest/batch={number}")
        return {r["bucket"]: r["batch"] for r in rows.collect()}  # a row a bucket

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> the batch that wrote it, as of the batches before ``before``."""
        numbers = [n for n in self._complete() if before is None or n < before]
        return self._manifest(numbers[-1]) if numbers else {}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """Rows of all buckets or of some; None if there are none."""
        held = self.manifest(before)
        paths = [f"{self.folder}/batch={batch}/{BUCKET}={bucket}" for bucket, batch in sorted(held.items()) if only is None or bucket in only]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, rows: DataFrame, touched: list[int], batch_id: int) -> None:
        """``rows`` are the whole new content of the ``touched`` buckets."""
        old = self.manifest(batch_id)
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/batch={batch_id}")
        new = old | dict.fromkeys(touched, batch_id)
        self.spark.createDataFrame(sorted(new.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch_id}")
        needed = {*old.items(), *new.items()}
        for number in [n for n in self._batches() if n < batch_id]:
            names = [name for name in self._listed(f"batch={number}") if name.startswith(f"{BUCKET}=")]
            gone = [name for name in names if (int(name[len(BUCKET) + 1:]), number) not in needed]
            for path in [f"batch={number}"] if len(gone) == len(names) else [f"batch={number}/{name}" for name in gone]:
                self._files.delete(self._path(f"{self.folder}/{path}"), True)
        for number in [n for n in self._complete() if n < batch_id][:-1]:
            self._files.delete(self._path(f"{self.folder}/manifest/batch={number}"), True)


def stream_daily_comparison(sources: dict[str, tuple[DataFrame, str, dict[str, Column], str]], start: str | None = None, end: str | None = None) -> DataFrame:
    """Conditional counts of several event streams per day of event time, one row a day; what ``daily_comparison`` gives.

    ``sources`` are name -> (stream, time column, counts by name, delay). Every stream has its own watermark, its latest
    time less its delay. A day stays open until it is behind all of them, so a slow source loses nothing to a fast one:
    this is the policy "min" of spark.sql.streaming.multipleWatermarkPolicy, Spark's default; "max" is refused. After a
    restart days stay open until every stream has brought rows again. Rows without a time or out of the days ``start`` to ``end`` are not counted.
    """
    names = [n for _, _, counts, _ in sources.values() for n in counts]
    parts = []
    for rows, at, counts, delay in sources.values():
        if rows.sparkSession.conf.get("spark.sql.streaming.multipleWatermarkPolicy", "min") != "min":
            raise ValueError("spark.sql.streaming.multipleWatermarkPolicy has to be min")
        marked = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
        hits = [(counts[n] if n in counts else F.lit(False)).alias(n) for n in names]
        day = F.col("_at").cast("date")
        for bound, holds in ((start, day >= F.lit(start).cast("date")), (end, day <= F.lit(end).cast("date"))):
            marked = marked.filter(holds) if bound is not None else marked
        parts.append(marked.select("_at", *hits))
    both = functools.reduce(DataFrame.unionByName, parts)
    per = both.groupBy(F.window("_at", "1 day").alias("w")).agg(*[F.count_if(n).alias(n) for n in names])
    return per.select(F.col("w.start").cast("date").cast("string").alias("day"), *names)


def stream_dedupe_requests(requests: DataFrame, raw: str, at: str, delay: str = "1 day") -> DataFrame:
    """First request per key within the watermark."""
    keyed = requests.withColumn("request_key", codes.request_key(raw)).filter("request_key <> ''")
    return keyed.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["request_key"])
