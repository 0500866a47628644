"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A benchmark item gives all its windows of ``n`` words (one shorter window if it has fewer words).
Their 64-bit hashes are broadcast in blocks of items whose bytes are counted first, so no one broadcast
grows with the benchmark. Their sum does: the driver makes all blocks one by one and keeps them, and
the passes are chained in one stage, so a task's machine holds them all. Each block scans every word window of the training texts in one narrow
pass, verifies hits by comparing the words, and adds its spans to those of the blocks before. Nothing
is shuffled.

Defined results: a null text or item has no words; an item without words has no window; repeated
items count under their own item_id; a null item_id is reported as the empty string; texts are taken
whole; a document's row comes back once per input row, a null doc_id as null; an empty benchmark
contaminates nothing; other columns are ignored by ``find_hits`` and kept by the ``remove_`` functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import kernel as kn

WINDOW = 13
#: benchmark bytes behind one broadcast; a gram takes some 8 bytes of hash and its share of the words
BLOCK_BYTES = 4 << 20

HIT_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))


def grams_of(items: list[tuple[str, str]], n: int) -> dict[int, tuple[np.ndarray, list[bytes], list[list[str]]]]:
    """The windows of a block of items by length: hashes in order, their words, and the items they are in."""
    table = pa.table({"text": pa.array([t for _, t in items], pa.string())})
    hasher, is_word, lower = kn.Hasher(), kn.is_alnum_byte(), kn.lowered()
    found: dict[int, dict[bytes, tuple[int, set[str]]]] = {}
    for row, data, off in kn.slices(table["text"]):
        data = lower[data]
        start, end, first = kn.find_words(data, off, is_word)
        word = hasher.word_hash(data, start, end)
        text, to = kn.spaced(data, start, end, np.ones(len(start), bool))
        text = text.tobytes()
        for size in {min(n, c) for c in np.diff(first).tolist()} - {0}:
            runs = hasher.run_hash(word, size)
            for i in range(len(first) - 1):
                count = int(first[i + 1] - first[i])
                if min(n, count) != size:
                    continue
                for at in range(int(first[i]), int(first[i + 1]) - size + 1):
                    words = text[to[at] : to[at + size] - 1]
                    entry = found.setdefault(size, {}).setdefault(words, (int(runs[at]), set()))
                    entry[1].add(items[row + i][0])
    lengths = {}
    for size, grams in found.items():
        ordered = sorted(grams.items(), key=lambda x: (x[1][0], x[0]))
        hashes = np.array([h for _, (h, _) in ordered], np.uint64)
        lengths[size] = (hashes, [w for w, _ in ordered], [sorted(s) for _, (_, s) in ordered])
    return lengths


def scan(grams: dict, data: np.ndarray, off: np.ndarray, hasher: kn.Hasher):
    """Per row of a slice: number of words, hit spans (first word, length) and items."""
    data = kn.lowered()[data]
    start, end, first = kn.find_words(data, off, kn.is_alnum_byte())
    word = hasher.word_hash(data, start, end)
    rows = len(first) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    items: list[set[str]] = [set() for _ in range(rows)]
    for size, (hashes, words, owners) in grams.items():
        runs = hasher.run_hash(word, size)
        low = np.searchsorted(hashes, runs)
        hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == runs)
        if not len(hit):
            continue
        row = np.searchsorted(first, hit, side="right") - 1
        inside = hit + size <= first[row + 1]
        for at, r in zip(hit[inside].tolist(), row[inside].tolist(), strict=True):
            text = b" ".join(data[start[i] : end[i]].tobytes() for i in range(at, at + size))
            g = int(low[at])
            while g < len(hashes) and hashes[g] == runs[at]:
                if words[g] == text:
                    spans[r].append((at - int(first[r]), size))
                    items[r].update(owners[g])
                g += 1
    return np.diff(first), spans, items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for s, n in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(a, b - a) for a, b in out]


def _pass(block, last: bool):
    """Scan one block; hits of the blocks before come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, grams = kn.Hasher(), block.value
        for batch in batches:
            for row, data, off in kn.slices(batch["text"]):
                n, spans, items = scan(grams, data, off, hasher)
                some = batch.slice(row, len(n))
                for i, (x, y) in enumerate(zip(some["items"].to_pylist(), some["spans"].to_pylist(), strict=True)):
                    items[i].update(x)
                    spans[i] = joined(spans[i] + [(z["start"], z["n_words"]) for z in y])
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": some["key"],
                        "text": pa.nulls(len(n), pa.string()) if last else some["text"],
                        "n_words": pa.array(n, pa.int64()),
                        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        "spans": pa.array([[{"start": s, "n_words": k} for s, k in x] for x in spans], HIT_SPANS),
                    }
                )

    return run


def blocks_of(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text", most: int = BLOCK_BYTES):
    """Broadcast grams of items, block by block; every block is within its size unless one item is larger."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    count = max(1, -(-int(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // most))
    context = benchmark.sparkSession.sparkContext
    for b in range(count):
        chosen = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b).collect()
        yield context.broadcast(grams_of([(r.i, r.t) for r in chosen], n))


def _with_hits(docs: DataFrame, key: Column, text: str, benchmark: DataFrame, n: int, block_bytes: int) -> DataFrame:
    """(key, n_words, items, spans): one narrow pass over the texts per block of the benchmark."""
    hits = docs.select(
        key.alias("key"),
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start:bigint,n_words:bigint>>").alias("spans"),
    )
    blocks = list(blocks_of(benchmark, n, most=block_bytes))
    for i, block in enumerate(blocks):
        hits = hits.mapInArrow(_pass(block, i == len(blocks) - 1), hits.schema)
    return hits.drop("text")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def n_hit(spans: Column) -> Column:
    """Words in spans, which do not overlap."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda t, x: t + x["n_words"])


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans), one row per input row."""
    hits = _with_hits(docs, F.col("doc_id"), "text", benchmark, n, block_bytes)
    return hits.select(
        F.col("key").alias("doc_id"),
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(n_hit(F.col("spans")), F.col("n_words")).alias("contaminated"),
        "items",
        "spans",
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    hits = _with_hits(docs, F.struct("*"), "text", benchmark, n, block_bytes)
    clean = hits.where(~contaminated(n_hit(F.col("spans")), F.col("n_words")))
    return clean.select(*[F.col("key").getField(c).alias(c) for c in docs.columns])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    is_word, lower = kn.is_alnum_byte(), kn.lowered()
    for batch in batches:
        texts = []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            if text is None or not spans:
                texts.append(text)
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            start, end, _ = kn.find_words(lower[raw], np.array([0, len(raw)]), is_word)
            keep = np.ones(len(raw), bool)
            for x in spans:
                keep[start[x["start"]] : end[x["start"] + x["n_words"] - 1]] = False
            texts.append(raw[keep].tobytes().decode())
        yield pa.RecordBatch.from_pydict({"key": batch["key"], "text": pa.array(texts, pa.string())})


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents with their columns; hit words, and what stands between them, are cut out of the text."""
    hits = _with_hits(docs, F.struct("*"), "text", benchmark, n, block_bytes)
    hits = hits.select("key", F.col("key").getField("text").alias("text"), "spans")
    schema = hits.select("key", "text").schema
    cut = hits.mapInArrow(_without, schema)
    return cut.select(*[F.col("text") if c == "text" else F.col("key").getField(c).alias(c) for c in docs.columns])
