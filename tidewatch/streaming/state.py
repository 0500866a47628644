"""What a stream keeps per key between micro-batches, as tables in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: micro-batches between versions that hold all keys
COMPACT = 16


class KeyedState:
    """One row per key, one version per micro-batch.

    A batch reads what the batches before it left and writes a version of its own, so a batch
    that runs again (a driver was lost) sees the same state and replaces only what it wrote.  A
    version holds the keys of its batch; every ``compact`` batches it holds all keys, so a read
    takes in at most so many versions.
    """

    def __init__(self, folder: str, keys: Sequence[str], schema: T.StructType, compact: int = COMPACT):
        self.folder, self.keys, self.schema, self.compact = folder.rstrip("/"), list(keys), schema, compact

    def _path(self, batch_id: int) -> str:
        return f"{self.folder}/version={batch_id}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The state that batch ``batch_id`` starts from."""
        if batch_id <= 0:
            return spark.createDataFrame([], self.schema)
        first = (batch_id - 1) // self.compact * self.compact
        parts = []
        for version in range(first, batch_id):
            rows = spark.read.schema(self.schema).parquet(self._path(version))
            parts.append(rows.withColumn("_version", F.lit(version)))
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        values = [f.name for f in self.schema if f.name not in self.keys]
        latest = F.max_by(F.struct(*values), "_version").alias("_s")
        if self.keys:
            return every.groupBy(*self.keys).agg(latest).select(*self.keys, "_s.*")
        return every.agg(latest).where("_s IS NOT NULL").select("_s.*")

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """Keep the rows of the keys that a batch has changed."""
        names = [f.name for f in self.schema]
        out = changed.select(*names)
        if batch_id % self.compact == 0 and batch_id > 0:
            spark = changed.sparkSession
            both = self.before(spark, batch_id).withColumn("_version", F.lit(0))
            both = both.unionByName(out.withColumn("_version", F.lit(1)))
            values = [c for c in names if c not in self.keys]
            latest = F.max_by(F.struct(*values), "_version").alias("_s")
            out = both.groupBy(*self.keys).agg(latest).where("_s IS NOT NULL").select(*self.keys, "_s.*")
        out.select(*names).write.mode("overwrite").parquet(self._path(batch_id))
