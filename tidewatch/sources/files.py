"""Digests of files of any size, read by byte ranges."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import spread

#: bytes behind one digest of a range, and read at once
RANGE_BYTES = 64 << 20
PIECE_BYTES = 8 << 20


def _open(path: str):
    """A file in any store that Arrow reaches: a local or mounted folder, s3, gs, abfs, hdfs."""
    from pyarrow import fs

    # Spark writes file:/a/b and escapes what a URI may not hold
    if local := re.match(r"file:/+(.*)", path):
        return fs.LocalFileSystem().open_input_file("/" + unquote(local[1]))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _sha256(path: str, start: int, size: int) -> str:
    digest = hashlib.sha256()
    with _open(path) as file:
        file.seek(start)
        while size:
            piece = file.read(min(size, PIECE_BYTES))
            if not piece:
                raise EOFError(f"{path} is shorter than it was listed")
            digest.update(piece)
            size -= len(piece)
    return digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte ranges with the SHA-256 of what is there."""
    for batch in batches:
        ranges = zip(*(batch[c].to_pylist() for c in ("path", "start", "size")), strict=True)
        for i, (path, start, size) in enumerate(ranges):
            sha = pa.array([_sha256(path, start, size)])
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, sha], [*batch.schema.names, "sha256"])


def _listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, bytes`` of files as Spark lists them, which leaves out files of no bytes; no content is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def file_ranges(spark: SparkSession, path: str | list[str], size: int = RANGE_BYTES) -> DataFrame:
    """``path, bytes, start, size, sha256`` of the byte ranges of files.

    A range is one row and is read in pieces, so a task needs a few megabytes whatever the size of a file, and
    the ranges of a large file are read by as many tasks as there are.
    """
    size = int(size)
    start = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))
    ranges = _listed(spark, path).withColumn("start", F.explode(start))
    ranges = ranges.withColumn("size", F.least(F.lit(size).cast("long"), F.col("bytes") - F.col("start")))
    # adaptive execution would see a few bytes per range and put many into a task
    ranges = spread(ranges, "path", "start")
    return ranges.mapInArrow(_digests, "path string, bytes long, start long, size long, sha256 string")


def file_tree_digests(spark: SparkSession, path: str | list[str], size: int = RANGE_BYTES) -> DataFrame:
    """``path, bytes, ranges, tree_sha256``: SHA-256 over the digests of a file's ranges, in order.

    The digest for files that one task should not read; two files of one digest (and range size) are equal.
    """
    ranges = file_ranges(spark, path, size)
    parts = F.sort_array(F.collect_list(F.struct("start", "sha256")))
    return ranges.groupBy("path", "bytes").agg(
        F.count(F.lit(1)).alias("ranges"), F.sha2(F.array_join(parts["sha256"], "\n"), 256).alias("tree_sha256")
    )


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, bytes, sha256`` of whole files of any size.

    A plain SHA-256 runs from the first byte to the last, so one task reads a file, a piece at a time.
    ``file_tree_digests`` spreads the ranges of very large ones.
    """
    whole = _listed(spark, path).select("path", "bytes", F.lit(0).cast("long").alias("start"), F.col("bytes").alias("size"))
    rows = spread(whole, "path").mapInArrow(_digests, "path string, bytes long, start long, size long, sha256 string")
    return rows.select("path", "bytes", "sha256")
