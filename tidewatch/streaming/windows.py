"""Event-time rollups and sessions, and an idempotent ledger sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: files a micro-batch takes in
FILES_PER_TRIGGER = 64


def hourly_rollup(
    stream: DataFrame, ts: str, value: str, keys: Sequence[str] = (), late: str = "1 hour", every: str = "1 hour"
) -> DataFrame:
    at = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return (
        at.groupBy(*keys, F.window("_t", every).alias("_w"))
        .agg(F.sum(F.col(value).cast("double")).alias("y"))
        .select(*keys, F.col("_w.start").alias("ts"), "y")
    )


def event_sessions(
    stream: DataFrame, cooldown: str, keys: Sequence[str] = (), late: str = "1 hour", flag: str = "flag"
) -> DataFrame:
    """Sessions of flagged rows by time only; batch ``events`` also joins neighbours."""
    at = stream.where(F.col(flag) == 1).withColumn("_t", F.col("ts").cast("timestamp"))
    return (
        at.withWatermark("_t", late)
        .groupBy(*keys, F.session_window("_t", cooldown).alias("_w"))
        .agg(
            F.min("_t").alias("start"),
            F.max("_t").alias("end"),
            F.count(F.lit(1)).alias("flagged"),
            F.max("score").alias("peak_score"),
        )
        .drop("_w")
    )


def ledger_sink(folder: str, run_id: str, step: Callable[[DataFrame, int], DataFrame] | None = None):
    """``foreachBatch`` writer: a batch that is run again replaces its own rows.

    ``step(batch, batch_id)`` makes what is written of a batch, as ``FlagSteps`` does.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = step(batch, batch_id) if step else batch
        out.write.mode("overwrite").parquet(f"{folder}/ledger/run_id={run_id}/batch_id={batch_id}")

    return write


def file_stream(spark: SparkSession, schema: T.StructType, folder: str, files: int = FILES_PER_TRIGGER) -> DataFrame:
    """Parquet files as a stream; a micro-batch takes at most so many, so the first one is no larger than others."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_to_end(
    stream: DataFrame,
    folder: str,
    mode: str = "append",
    run_id: str = "run",
    step: Callable[[DataFrame, int], DataFrame] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Process what is there and read the result back; ``schema`` is that of ``step``'s rows."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/state")
        .foreachBatch(ledger_sink(folder, run_id, step))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(schema or stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/ledger")


def closing_row(rows: DataFrame, ts: str = "ts", given: dict[str, Column] | None = None) -> DataFrame:
    """One row long after the last of ``rows``: it moves the watermark past everything that is still open.

    A stream gives out a window or session only when its watermark has passed it, so the last ones stay
    inside until something later comes.  When a source has ended, append this row to it and run once more.
    Its other columns are null unless ``given``; its own window stays open.
    """
    end = rows.agg((F.max(ts) + F.expr("interval 10000 days")).alias(ts))
    given = {ts: F.col(ts)} | (given or {})
    return end.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])


def replay(
    rows: DataFrame,
    cuts: Sequence[str],
    build: Callable[[DataFrame], DataFrame],
    folder: str,
    close: bool = False,
    step: Callable[[DataFrame, int], DataFrame] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Feed the rows before, between and behind the times ``cuts`` in runs of one stream.

    State is carried between the runs.  ``close`` ends the stream with a ``closing_row``.
    """
    spark = rows.sparkSession

    def run() -> DataFrame:
        stream = build(file_stream(spark, rows.schema, f"{folder}/in"))
        return run_to_end(stream, folder, step=step, schema=schema)

    edges = [None, *cuts, None]
    for a, b in zip(edges, edges[1:]):
        part = rows if a is None else rows.where(F.col("ts") >= F.to_timestamp(F.lit(a)))
        part = part if b is None else part.where(F.col("ts") < F.to_timestamp(F.lit(b)))
        part.write.mode("append").parquet(f"{folder}/in")
        out = run()
    if close:
        closing_row(rows, given={"flag": F.lit(1)}).write.mode("append").parquet(f"{folder}/in")
        # the run that takes the row in moves the watermark, the next one gives out what it passed
        for _ in range(2):
            out = run()
    return out
