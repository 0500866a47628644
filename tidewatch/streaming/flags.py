"""Hysteresis and K of W on a stream, with the rows of a hot key in many groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import AuditConfig
from tidewatch.operators.flags import flag_streams
from tidewatch.operators.sequence import BLOCK_ROWS, index_rows
from tidewatch.session import stage_table
from tidewatch.streaming.state import KeyedState


class FlagSteps:
    """Flags of each micro-batch: ``step(batch, batch_id)`` gives ``keys, ts, score, flag``.

    A stateful operator would hand all rows of a key in a micro-batch to one task.  Here a batch is a
    table like any other.  Its rows are numbered per key and cut into blocks; a block is a function of
    the state it is entered in, known by its last trigger and its last W - 1 raw states, and the
    blocks of a key are put together in a table with one row per block (``flag_streams``).  So a key
    with any number of rows is worked on in groups of ``rows``, without user functions.

    Between batches a key keeps the last W - 1 raw states (one at least) and the time of its last row
    (``KeyedState``).  They enter the next batch as rows that say on or off whatever the threshold.  Rows
    are ordered by time, rows of one instant by score.  A row older than the last one decided would
    change decisions already given, so it comes out with a null flag.  A null key is a key.
    """

    def __init__(
        self,
        cfg: AuditConfig,
        keys: Sequence[str],
        folder: str,
        tau: str = "tau",
        score: str = "score",
        rows: int = BLOCK_ROWS,
    ):
        self.cfg, self.keys, self.folder = cfg, list(keys), folder
        self.tau, self.score, self.rows = tau, score, rows

    def schema(self, given: T.StructType) -> T.StructType:
        """Columns that come out for a stream of ``given`` columns."""
        kinds = {"ts": T.TimestampType(), "score": T.DoubleType(), "flag": T.IntegerType()}
        return T.StructType([given[c] for c in self.keys] + [T.StructField(c, t) for c, t in kinds.items()])

    def __call__(self, batch: DataFrame, batch_id: int) -> DataFrame:
        spark, cfg, w = batch.sparkSession, self.cfg, self.cfg.w
        # keys travel in one struct, which is never null
        key = F.struct(*(self.keys or [F.lit(0).alias("none")])).alias("_key")
        rows = batch.select(
            key,
            F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
            F.col(self.score).cast("double").alias("score"),
            F.col(self.tau).cast("double").alias("tau"),
        )
        kept = T.StructType(
            [rows.schema["_key"], T.StructField("_last", T.LongType()), T.StructField("_tail", T.ArrayType(T.IntegerType()))]
        )
        state = KeyedState(f"{self.folder}/flag-state", ["_key"], kept)
        before = state.before(spark, batch_id)
        rows = stage_table(rows.join(before, "_key", "left"), "flag-rows")
        is_late = F.coalesce(F.col("_us") < F.col("_last"), F.lit(False))
        late = rows.where(is_late).select("_key", "_us", "score", F.lit(None).cast("int").alias("flag"))

        live = index_rows(rows.where(~is_late), ["_key"], "_us", ties=["score"])
        live = live.withColumn("row_no", F.col("row_no") + F.coalesce(F.size("_tail"), F.lit(0))).drop("_last", "_tail")
        # what was on or off before the batch
        seen = rows.where(~is_late).select("_key").distinct()
        carried = before.join(seen, "_key", "left_semi").select("_key", "_last", F.posexplode("_tail").alias("row_no", "_raw"))
        carried = carried.select(
            "_key",
            F.lit(None).cast("long").alias("_us"),
            F.when(F.col("_raw") == 1, 2.0).otherwise(-1.0).alias("score"),
            F.lit(1.0).alias("tau"),
            F.col("row_no").cast("long").alias("row_no"),
        )
        both = live.select("_key", "_us", "score", "tau", F.col("row_no").cast("long").alias("row_no")).unionByName(carried)
        streams = {"flag": ("score", "tau")}
        flagged = stage_table(
            flag_streams(both, streams, w, cfg.k, cfg.low_ratio, ["_key"], self.rows, keep=["flag_raw"]), "flag-decided"
        )

        ends = flagged.groupBy("_key").agg(F.max("_us").alias("_last"), F.max("row_no").alias("_end"))
        last = flagged.join(ends, "_key").where(F.col("row_no") > F.col("_end") - max(w - 1, 1))
        # at most W - 1 rows per key
        tail = F.sort_array(F.collect_list(F.struct("row_no", F.col("flag_raw").cast("int").alias("raw"))))
        state.write(last.groupBy("_key").agg(F.first("_last").alias("_last"), tail["raw"].alias("_tail")), batch_id)

        out = flagged.where("_us IS NOT NULL").select("_key", "_us", "score", "flag").unionByName(late)
        names = [F.col("_key").getField(c).alias(c) for c in self.keys]
        return out.select(*names, F.timestamp_micros("_us").alias("ts"), "score", F.col("flag").cast("int").alias("flag"))
