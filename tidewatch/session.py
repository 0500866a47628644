"""Session settings and the one place where intermediate results are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: naive timestamps mean UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def allow_charsets(spark: SparkSession) -> None:
    """Let decode() take Japanese charsets and skip over bytes it cannot map."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by the cluster.

    Only a single-machine session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts lineage (a lost executor re-reads the files instead of re-running the
    plan) and gives later joins true sizes to plan with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition ahead of a Python step that computes much per byte.

    Adaptive execution sizes partitions by bytes and would put such a step into a
    few tasks; a stated number of partitions is left alone.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, spark.sparkContext.defaultParallelism), *cols)
