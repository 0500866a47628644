"""Texts in parts, and what the operators share around them.

Corpus-wide counts meet in *buckets*: a part (some MB of whole texts) condenses what it needs to
know to distinct 64-bit keys, sends them packed by key range, and gets an answer per key back. A
key therefore crosses the network once per part however often it occurs, a bucket holds a bounded
number of keys, and no row is made per word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.kernel import bucket_of

#: bytes of text in a part; keys in a bucket
PART_BYTES = 8 << 20
BUCKET_KEYS = 2 << 20
#: stands for a null doc_id inside the operators
NULL_ID = np.iinfo(np.int64).min


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """All bytes of the texts."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def part_count(total_bytes: int) -> int:
    return max(64, math.ceil(total_bytes / PART_BYTES))


def bucket_count(keys: float) -> int:
    return max(24, math.ceil(keys / BUCKET_KEYS))


def part_of(doc_id: Column, parts: int) -> Column:
    """The part of a document: doc_id alone decides."""
    return F.pmod(F.xxhash64(doc_id), F.lit(parts)).cast("int")


def in_parts(docs: DataFrame, parts: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, doc_id, text), with no other column of the input."""
    return docs.select(
        part_of(F.col(doc_id).cast("long"), parts).alias("part"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.col(text).alias("text"),
    )


def in_order(table: pa.Table) -> pa.Table:
    """Rows by doc_id and text: the same whichever way the rows came."""
    ids = table["doc_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(ids) and (np.diff(ids[order]) == 0).any():
        return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table.take(order)


def id_column(ids: np.ndarray) -> pa.Array:
    """doc_ids as they were given."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the buckets they are in and the bounds of each."""
    at = bucket_of(key, buckets)
    first = np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint64(1)))
    return at[first].astype(np.int32), np.append(first, len(key))
