"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; rank r of n gets the fraction
(r + 1/2) / n. Sorted by fraction, every stretch of the order holds all sources in proportion, and
the order is cut into shards of equal row counts (the law ``rows``: at most one apart).

Neither ranking puts a source into one task: hashes and fractions are uniform, so fixed ranges of
them hold a bounded number of rows. Ranges are counted, the counts summed up in order, and rows
ranked inside their range. The number of ranges follows the number of rows.

Only ids, sizes and hashes are shuffled; texts are read once for their size and checksum.

Defined results: a null text has size 1 and checksum 0; a null source is a source of its own; a null
doc_id and equal doc_ids are ordered by checksum and size, and rows equal in all of these may change
places, which changes no result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.mixing import source_key
from tidewatch.session import stage_table

#: rows in a range
RANGE_ROWS = 4_000
#: hexadecimal digits that choose the range of a hash
DIGITS = 8


def ranked(rows: DataFrame, groups: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, the place from 0 in ``order`` within ``groups``; buckets follow that order."""
    rows = rows.withColumn("bucket", bucket)
    count = rows.groupBy(*groups, "bucket").agg(F.count("*").alias("in_bucket"))
    window = Window.partitionBy(*groups).orderBy("bucket") if groups else Window.orderBy("bucket")
    before = count.withColumn("before", F.sum("in_bucket").over(window) - F.col("in_bucket")).drop("in_bucket")
    inside = F.row_number().over(Window.partitionBy(*groups, "bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    placed = rows.withColumn("inside", inside).join(before, [*groups, "bucket"])
    return placed.withColumn(name, F.col("before") + F.col("inside") - 1).drop("bucket", "inside", "before")


def interleave(
    docs: DataFrame, shards: int = 8, seed: int = 11, source: str = "source", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, source, size, text_crc32, law, shard, slot), one row per input row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        source_key(F.col(source)).alias("skey"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("hash"),
    )
    rows = stage_table(rows, "sizes")
    total = rows.count()
    ranges = max(1, -(-total // RANGE_ROWS))
    by_hash = F.conv(F.substring("hash", 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    out = ranked(rows, ["skey"], F.floor(by_hash * ranges), ["hash", "doc_id", "text_crc32", "size"], "place")
    out = stage_table(out, "places")
    # staged, so that the planner knows its size and rows need not be shuffled by source
    of_source = stage_table(out.groupBy("skey").agg(F.count("*").alias("n")), "source-sizes")
    out = out.join(of_source, "skey").withColumn("fraction", (F.col("place") + F.lit(0.5)) / F.col("n")).drop("n", "place")
    out = ranked(out, [], F.floor(F.col("fraction") * ranges), ["fraction", "skey", "hash", "doc_id", "text_crc32", "size"], "place")
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    out = out.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("place") - first)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot")


#: DuckDB SQL of (doc_id, size, text_crc32, law, shard, slot, grown_shard) with the default parameters
ORACLE = """
WITH crc_bits AS (
  SELECT b, list_reduce([b::UBIGINT] || generate_series(1, 8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
  FROM generate_series(0, 255) AS x(b)
),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM crc_bits),
rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS skey, coalesce(strlen(text), 0) + 1 AS size,
    md5('11:' || coalesce(doc_id::VARCHAR, '')) AS hash,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(regexp_replace(hex(coalesce(text, '')), '(..)', '\\1 ', 'g'), ' ')[:-2],
      lambda h: ('0x' || h)::UBIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INT + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc_table
),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY skey ORDER BY hash, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE)
    / (count(*) OVER (PARTITION BY skey))::DOUBLE AS fraction FROM rows
),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY fraction, skey, hash, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM placed
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 8 // n)::INT AS shard,
  place - ((place * 8 // n) * n + 7) // 8 AS slot, NULL::INT AS grown_shard
FROM ordered
"""
