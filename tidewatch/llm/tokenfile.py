"""Token ids in Parquet list columns.

A token table is a folder of Parquet files in ascending doc_id order. Each row holds a document:

    doc_id      as given
    n_tokens    ids of the document, its end id included
    shard       number of the file, in order
    at          ids before the document in its file
    tokens      the ids, a list of 32-bit integers

Ids are dictionary encoded (a page of a vocabulary's ids takes 16 bits each) and fall back to delta
encoding, as the other columns do. Row groups and pages have stated sizes and the writer adds page
indexes, so a range of doc_ids reads a few pages, and metadata reads never touch the ids. A
document's place in the whole corpus is its place in the file plus the ids of the files before, one
number per file.

Texts are range-partitioned by doc_id once, encoded in order and written; nothing else is shuffled.
The tokenizer drops white space, so ids are made per distinct chunk between ASCII white space by the
tokenizers library and remembered by their hash, up to a bound in bytes, by the worker that made them.

Defined results: a null text is empty and has the end id only; rows that share a doc_id follow one
another in the order of the xxhash64 of their texts; a null doc_id comes first; an empty table gives
no rows; texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import exchange as ex
from tidewatch.llm import kernel as kn

#: bytes of text behind one file, of a row group, of a page; rows in a page
FILE_BYTES = 32 << 20
GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: bytes of text worked on at once, in an Arrow batch, and of chunks and ids remembered by a worker
SLICE = 256 << 10
BATCH_BYTES = 4 << 20
REMEMBER = 32 << 20
#: new chunks kept apart from the others until they are so many
YOUNG = 1 << 15
#: up to so many files their places are a broadcast of some 100 kB
FEW_FILES = 10_000

LAYOUT = "doc_id long, n_tokens long, shard int, at long, tokens array<int>"


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that its tasks share what they learn."""
    return vars(sys.modules.setdefault("_tidewatch_worker", types.ModuleType("_tidewatch_worker"))).setdefault(name, {})


class Growing:
    """An array that grows by half at a time."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.used(), np.zeros(max(need, 3 * len(self.data) // 2) - self.n, self.data.dtype)])
        self.data[self.n : need] = more
        self.n = need

    def used(self) -> np.ndarray:
        return self.data[: self.n]

    @property
    def nbytes(self) -> int:
        return self.data.nbytes


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of (keys, slots) as one."""
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


class ChunkIds:
    """Ids of distinct chunks in growing arrays; a chunk is known by its 64-bit hash."""

    def __init__(self, spec: str, remember: int):
        # one task, one core: Spark runs as many tasks as there are cores
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        ids = lambda t: self.library.encode(t, add_special_tokens=False).ids
        #: A-Z are the same as a-z; a comma or full stop behind a letter or digit stands alone
        self.folds = ids("Ab XYZ") == ids("ab xyz")
        self.splits = all(ids(a + b) == ids(a) + ids(b) == ids(f"{a} {b}") for a in ("ab", "x1", "'s") for b in ",.")
        self.special = [kn.lowered()[np.frombuffer(t["content"].encode(), np.uint8)].tobytes() for t in json.loads(spec).get("added_tokens", [])]
        self.remember, self.hasher, self.is_word = remember, kn.Hasher(), kn.is_word_byte()
        self.forget()

    def forget(self) -> None:
        #: sorted keys with the slots of their chunks: most of them, and the latest
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        #: by slot: how many ids, and where they begin in ``ids``
        self.size, self.begin, self.ids = Growing(np.int32), Growing(np.int64), Growing(np.int32)

    def held(self) -> int:
        """Bytes remembered."""
        return sum(x.nbytes for level in self.known for x in level) + self.size.nbytes + self.begin.nbytes + self.ids.nbytes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 where a chunk is new."""
        slot = np.full(len(keys), -1, np.int64)
        for key, slots in self.known:
            at = np.searchsorted(key, keys)
            here = np.flatnonzero(at < len(key))
            here = here[key[at[here]] == keys[here]]
            slot[here] = slots[at[here]]
        return slot

    def learn(self, keys: np.ndarray, chunks: list[str]) -> np.ndarray:
        """Slots of new chunks, given by sorted keys."""
        slots = np.arange(self.size.n, self.size.n + len(keys), dtype=np.int32)
        for at in range(0, len(chunks), 1 << 12):
            batch = [e.ids for e in self.library.encode_batch_fast(chunks[at : at + (1 << 12)], add_special_tokens=False)]
            size = np.fromiter(map(len, batch), np.int32, len(batch))
            self.begin.extend(self.ids.n + np.cumsum(size, dtype=np.int64) - size)
            self.size.extend(size)
            self.ids.extend(np.fromiter(chain.from_iterable(batch), np.int32, int(size.sum())))
        old, young = self.known[0], merged(self.known[1], (keys, slots))
        if len(young[0]) > YOUNG + len(old[0]) // 8:
            old, young = merged(old, young), (keys[:0], slots[:0])
        self.known = [old, young]
        return slots

    def simpler(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of texts with the same ids and far fewer different chunks.

        Where the tokenizer allows it, case is folded and punctuation set apart. Texts that hold a special
        string in any case stay as they are: the library takes its very bytes for special, and no others.
        So does a letter before a byte from 0x80: the library composes characters before it folds case, and
        some marks compose with the small letter alone.
        """
        lower = kn.lowered()[data]
        as_is = np.repeat(self.with_special(lower, off), np.diff(off))
        if self.folds:
            composed = as_is.copy()
            composed[:-1] |= data[1:] >= 0x80
            data = np.where(composed, data, lower)
        if self.splits and len(data) > 1:
            ends = np.append(~kn.is_word_byte()[data][1:], True)
            ends[off[1:-1][off[1:-1] > 0] - 1] = True
            behind = np.append(False, PLAIN_BYTE[data[:-1]])
            behind[off[:-1][off[:-1] < len(data)]] = False
            alone = np.flatnonzero(((data == 0x2C) | (data == 0x2E)) & ends & behind & ~as_is)
            off = off + np.searchsorted(alone, off)
            data = np.insert(data, alone, 0x20)
        return data, off

    def with_special(self, lower: np.ndarray, off: np.ndarray) -> np.ndarray:
        """By text: whether its lower-cased bytes hold a lower-cased special string (or one begins there and ends in the next)."""
        raw, found = lower.tobytes(), np.zeros(len(off) - 1, bool)
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                row = int(np.searchsorted(off, at, side="right")) - 1
                found[row] = True
                at = raw.find(s, int(off[row + 1]))
        return found

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row with the end id behind each text, and where each text begins."""
        if self.held() > self.remember:
            self.forget()
        data, off = self.simpler(data, off)
        start, end, word = kn.find_words(data, off, self.is_word)
        keys, sample, inverse = np.unique(self.hasher.word_hash(data, start, end), return_index=True, return_inverse=True)
        slot = self.find(keys)
        new = np.flatnonzero(slot < 0)
        if len(new):
            places = zip(start[sample[new]].tolist(), end[sample[new]].tolist(), strict=True)
            slot[new] = self.learn(keys[new], [data[a:b].tobytes().decode() for a, b in places])
        chunk = slot[inverse]
        all_size, all_begin, all_ids = self.size.used(), self.begin.used(), self.ids.used()
        size = all_size[chunk].astype(np.int64)
        per_row = np.diff(word)
        text = np.repeat(np.arange(len(per_row)), per_row)
        per_text = np.bincount(text, weights=size, minlength=len(per_row)).astype(np.int64) + 1
        first = np.concatenate([[0], np.cumsum(per_text)])
        out = np.full(int(first[-1]), end_id, np.int32)
        # chunk ids go to consecutive places, moved on by the end ids before
        source = np.repeat(all_begin[chunk] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        target = np.arange(len(source)) + np.repeat(text, size)
        out[target] = all_ids[source]
        return out, first


#: by byte: ASCII letters and digits
PLAIN_BYTE = np.isin(np.arange(256), np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))


def encoded(spec: str, end_id: int, remember: int):
    """A partition in order to rows of the token table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = worker_store("ids"), 0
        if (spec, remember) not in store:
            store.clear()
            store[spec, remember] = ChunkIds(spec, remember)
        cache = store[spec, remember]
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for row, data, off in kn.slices(batch["text"], SLICE):
                ids, first = cache.encode(data, off, end_id)
                n = np.diff(first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch["doc_id"].slice(row, len(n)),
                        "n_tokens": pa.array(n, pa.int64()),
                        "shard": pa.array(np.full(len(n), shard, np.int32)),
                        "at": pa.array(at + first[:-1], pa.int64()),
                        "tokens": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)),
                    }
                )
                at += int(first[-1])

    return run


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of at most so many bytes while jobs run inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> int:
    """Write the token table of ``docs`` to ``path``; gives the number of files it is laid out for."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    files = max(24, -(-ex.text_bytes(docs, text) // FILE_BYTES))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # the hash spreads rows that share a doc_id over files
    order = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "doc_id", "tie")
    order = order.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    writer = order.mapInArrow(encoded(spec, end_id, REMEMBER), LAYOUT).write
    for option, value in {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        "parquet.block.size": GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
    }.items():
        writer = writer.option(option, str(value))
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        writer.parquet(path)
    return files


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, tokens: bool = True) -> DataFrame:
    """Rows with low <= doc_id <= high; bounds reach the page indexes, and without ``tokens`` no id is read."""
    table = spark.read.schema(LAYOUT).parquet(path)
    if low is not None:
        table = table.where(F.col("doc_id") >= low)
    if high is not None:
        table = table.where(F.col("doc_id") <= high)
    return table if tokens else table.drop("tokens")


def starts_of(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids in the files before; one row per file."""
    from pyspark.sql import Window

    size = read_tokens(spark, path, tokens=False).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard")) - F.col("n")
    return size.select("shard", before.alias("before"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["tokens"]
        off = lists.offsets.to_numpy()
        low, high = int(off[0]), int(off[-1])
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy()[low:high], "<u4").tobytes())
        off = off - low
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch["doc_id"],
                "shard": batch["shard"],
                "at": batch["at"],
                "n_tokens": pa.array(np.diff(off), pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
        )


def describe(spark: SparkSession, path: str, files: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, all from the files."""
    rows = read_tokens(spark, path).select("doc_id", "shard", "at", "tokens")
    rows = rows.mapInArrow(_digests, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    starts = starts_of(spark, path)
    if files <= FEW_FILES:
        starts = F.broadcast(starts)
    return rows.join(starts, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
