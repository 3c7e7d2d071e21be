"""Session helpers: one builder for local runs and one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Tables written by ``cut_lineage`` that have not been dropped.
WRITTEN: list[str] = []


def local_session(app: str = "docweave", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and single-node runs; on a cluster use the session the cluster gives."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without one (a test) gets a folder of its own; on a cluster a missing setting
    is an error, because a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="docweave-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Later stages read files that survive the loss of any executor, and only the columns they need; of a table in
    folders ``by`` some columns, only the folders they need.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def in_methods(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its expressions worked out in methods of their own, which the JVM compiles.

    Spark makes one method of a stage's operators. Where many texts are normalised it grows beyond what the JVM compiles
    (8,000 bytes) and is interpreted, several times slower. An operator that holds a function without generated code
    stays out of that method, and its expressions are cut into small ones; here this function gives ``column`` back as it is.
    Take no key: Spark takes what comes out for nullable, for a value of its own, and would test and deal rows by it again.
    """
    same = F.element_at(F.transform(F.array(F.col(column)), lambda x: x), 1)
    return df.select(*[same.alias(c) if c == column else F.col(c) for c in df.columns])


def drop_written(spark: SparkSession) -> None:
    """Delete the intermediate tables; for the end of a piece of work, when no result that reads them is needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while WRITTEN:
        place = hadoop.Path(WRITTEN.pop())
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
