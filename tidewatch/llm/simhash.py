"""SimHash near-duplicates by anchor-point covering.

Two 31-bit pieces of a 64-bit fingerprint are covered by the perfect Hamming code [31, 26], whose
words are the *anchors*: every piece has exactly one anchor within the covering radius 1, its home.
If two fingerprints differ in at most ``t`` bits, then by counting either their first pieces differ
in at most t // 2 bits or their second ones in at most t - t // 2 - 1. In both cases the home of the
one is within (covering radius + that number) of the other. So each fingerprint is replicated to all
anchors within that distance - 156 and 16 for t = 4 - and compared, per anchor, with those at home
there. No pair is missed, and with 2**26 anchors per piece few strangers meet.

Equal fingerprints are taken once. A replica is a fingerprint and one byte (which of the patterns
leads to its anchor), packed by ranges of mixed anchors. Members of an anchor are compared by growing
components: what a component has taken is not compared again, so a dense ball of near copies costs
little more than its size and never all its pairs, and each component leaves as a star. Stars are
joined across anchors by rounds of large-star and small-star joins, each round written to the shared
folder.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated
rows share a component; a null doc_id comes back as null and sorts first (a component of null ids
only has component_id null); texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import exchange as ex
from tidewatch.llm import kernel as kn
from tidewatch.session import stage_table

PIECE_BITS = 31
SEED = 42
#: fingerprints replicated at once; replicas in a bucket
STEP = 5_000
BUCKET_ROWS = 2 << 20
#: members of an anchor beyond which components are grown instead of listing candidate pairs
GROW = 48


def fingerprints(width: int = 4):
    """Arrow batches of (key, text) to (key, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word, lower, digest = kn.is_word_byte(), kn.lowered(), xxhash.xxh64_intdigest
        for batch in batches:
            prints = []
            for _, data, off in kn.slices(batch["text"]):
                data = lower[data]
                start, end, first = kn.find_words(data, off, is_word)
                text, to = kn.spaced(data, start, end, np.ones(len(start), bool))
                raw, at = text.tobytes(), to.tolist()
                bounds = first.tolist()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    if a == b:
                        prints.append(0)
                        continue
                    ends = at[a + width : b + 1] or at[b : b + 1]
                    hashes = [digest(raw[i : j - 1], SEED) for i, j in zip(at[a : a + len(ends)], ends, strict=True)]
                    prints.append(majority(np.array(hashes, np.uint64)))
            yield pa.RecordBatch.from_pydict(
                {"key": batch["key"], "fingerprint": pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())}
            )

    return run


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        some = hashes[i : i + (1 << 14)]
        count += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def patterns(radius: int) -> np.ndarray:
    """By syndrome: the error patterns of at most ``radius`` bits that lead from a piece to an anchor, home first.

    Column i of the parity checks is i + 1, so a piece's syndrome is the XOR of its set bits' numbers.
    A syndrome with fewer patterns is filled up with its home.
    """
    found: list[list[int]] = [[] for _ in range(PIECE_BITS + 1)]
    for weight in range(radius + 1):
        for bits in combinations(range(PIECE_BITS), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1
            found[syndrome].append(sum(1 << b for b in bits))
    most = max(map(len, found))
    return np.array([x + x[:1] * (most - len(x)) for x in found], np.uint64)


def syndromes() -> list[np.ndarray]:
    """Syndromes of a piece's four bytes."""
    out = []
    for byte in range(4):
        table = np.zeros(256, np.uint8)
        for bit in range(8):
            number = 8 * byte + bit + 1
            if number <= PIECE_BITS:
                table[(np.arange(256) >> bit) & 1 == 1] ^= np.uint8(number)
        out.append(table)
    return out


class Covering:
    """The anchors of fingerprints for a threshold of differing bits."""

    def __init__(self, threshold: int):
        self.tables = [patterns(1 + threshold // 2), patterns(1 + threshold - threshold // 2 - 1)]
        self.width = [t.shape[1] for t in self.tables]
        self.bytes = syndromes()

    def _syndrome(self, prints: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
        x = (prints >> np.uint64(PIECE_BITS * piece)) & np.uint64((1 << PIECE_BITS) - 1)
        s = np.zeros(len(x), np.uint8)
        for i, table in enumerate(self.bytes):
            s ^= table[((x >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64)]
        return x, s

    def anchors(self, prints: np.ndarray, piece: int) -> np.ndarray:
        """(fingerprints x patterns) anchors; the piece's number is part of an anchor."""
        x, s = self._syndrome(prints, piece)
        return (x[:, None] ^ self.tables[piece][s]) | np.uint64(piece << PIECE_BITS)

    def anchor_at(self, prints: np.ndarray, piece: int, code: np.ndarray) -> np.ndarray:
        """The anchor that one pattern per fingerprint leads to."""
        x, s = self._syndrome(prints, piece)
        return (x ^ self.tables[piece][s, code]) | np.uint64(piece << PIECE_BITS)


def replicate(threshold: int, buckets: int):
    """Batches of fingerprints to packed replicas by bucket of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Covering(threshold)
        for batch in batches:
            every = batch["fingerprint"].to_numpy().view(np.uint64)
            for at in range(0, len(every), STEP):
                prints = every[at : at + STEP]
                prints_of, code_of, bucket_of = [], [], []
                for piece in (0, 1):
                    anchors = cover.anchors(prints, piece)
                    use = anchors != anchors[:, :1]
                    use[:, 0] = True
                    who, code = np.nonzero(use)
                    bucket_of.append(kn.bucket_of(kn.mix(anchors[use]), buckets).astype(np.int32))
                    prints_of.append(prints[who])
                    code_of.append((code + piece * cover.width[0]).astype(np.uint8))
                bucket = np.concatenate(bucket_of)
                order = np.argsort(bucket, kind="stable")
                bucket, x, c = bucket[order], np.concatenate(prints_of)[order], np.concatenate(code_of)[order]
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                bound = np.append(first, len(bucket))
                pairs = list(zip(bound[:-1], bound[1:], strict=True))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(bucket[first], pa.int32()),
                        "prints": ex.binary([kn.pack(x[a:b]) for a, b in pairs]),
                        "codes": ex.binary([kn.pack(c[a:b]) for a, b in pairs]),
                    }
                )

    return run


def grown(prints: np.ndarray, threshold: int) -> np.ndarray:
    """Component (as the place of one member) of each fingerprint; a taken member is not compared again."""
    label = np.full(len(prints), -1, np.int64)
    left = np.arange(len(prints))
    while len(left):
        seed, left = left[0], left[1:]
        label[seed] = seed
        front = [seed]
        while front and len(left):
            near = np.bitwise_count(prints[left] ^ prints[front.pop()]) <= threshold
            taken = left[near]
            label[taken] = seed
            front.extend(taken.tolist())
            left = left[~near]
    return label


def star_edges(threshold: int):
    """A bucket's replicas to edges (fingerprint, fingerprint): a star per component of an anchor."""

    def run(table: pa.Table) -> pa.Table:
        cover = Covering(threshold)
        prints = np.concatenate([kn.unpack(x, np.uint64) for x in table["prints"].to_pylist()])
        codes = np.concatenate([kn.unpack(x, np.uint8) for x in table["codes"].to_pylist()])
        anchor = np.zeros(len(prints), np.uint64)
        home = np.zeros(len(prints), bool)
        for piece in (0, 1):
            here = np.flatnonzero((codes >= cover.width[0]) == bool(piece))
            for at in range(0, len(here), 1 << 16):
                some = here[at : at + (1 << 16)]
                code = codes[some].astype(np.int64) - piece * cover.width[0]
                anchor[some] = cover.anchor_at(prints[some], piece, code)
                home[some] = code == 0
        order = np.lexsort((~home, anchor))
        anchor, prints, home = anchor[order], prints[order], home[order]
        first = np.flatnonzero(np.diff(anchor, prepend=anchor[:1] + np.uint64(1)))
        size = np.diff(np.append(first, len(anchor)))
        homes = np.add.reduceat(home.astype(np.int64), first) if len(first) else size
        left, right = [], []
        small = np.flatnonzero((homes > 0) & (size > 1) & (size <= GROW))
        # every home against every later member of its anchor
        begin = np.repeat(first[small], homes[small])
        stop = np.repeat(first[small] + size[small], homes[small])
        rank = np.arange(len(begin)) - np.repeat(np.cumsum(homes[small]) - homes[small], homes[small])
        who = begin + rank
        n = stop - who - 1
        for at in range(0, len(who), 1 << 16):
            w, k = who[at : at + (1 << 16)], n[at : at + (1 << 16)]
            a = np.repeat(w, k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            near = np.bitwise_count(prints[a] ^ prints[b]) <= threshold
            left.append(prints[a[near]])
            right.append(prints[b[near]])
        for g in np.flatnonzero((homes > 0) & (size > GROW)):
            some = prints[first[g] : first[g] + size[g]]
            label = grown(some, threshold)
            other = np.flatnonzero(label != np.arange(len(some)))
            left.append(some[other])
            right.append(some[label[other]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
        a, b = np.maximum(a, b), np.minimum(a, b)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.table({"u": pairs[:, 0].copy().view(np.int64), "v": pairs[:, 1].copy().view(np.int64)})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex that has an edge, with the smallest vertex of its component.

    Alternating large-star and small-star rounds: vertices are grouped by minima, which combine
    before the shuffle, so a star's centre is no hot group. Each round is written and read again.
    """
    edges = stage_table(edges.where("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage_table(large.where("u != v").distinct(), "links")
        # now u > v everywhere
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = stage_table(small.where("u != v").distinct(), "links")
        after = tuple(
            edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )
        if after == before:
            return edges
        before = after


def grouped(docs: DataFrame, threshold: int, width: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Staged (id, tie, fingerprint) per row, and (fingerprint, root, least_id) per fingerprint; the root names its component.

    ``least_id`` is a struct, so that a null id is the smallest.
    """
    if not 1 <= threshold <= 5:
        raise ValueError("the covering is laid out for 1 to 5 differing bits")
    key = F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tie"))
    source = docs.select(key.alias("key"), F.col(text).alias("text"))
    prints = source.mapInArrow(fingerprints(width), "key struct<id:bigint,tie:bigint>, fingerprint long")
    prints = stage_table(prints.select("key.id", "key.tie", "fingerprint"), "fingerprints")
    distinct = stage_table(
        prints.groupBy("fingerprint").agg(F.min(F.struct("id")).alias("first_id")), "distinct"
    )
    replicas = distinct.count() * sum(Covering(threshold).width)
    buckets = max(48, -(-replicas // BUCKET_ROWS))
    packed = distinct.select("fingerprint").mapInArrow(replicate(threshold, buckets), "bucket int, prints binary, codes binary")
    links = packed.groupBy("bucket").applyInArrow(star_edges(threshold), "u long, v long")
    found = components(links)
    ids = distinct.join(found, F.col("fingerprint") == F.col("u"), "left").select(
        "fingerprint", "first_id", F.coalesce("v", "fingerprint").alias("root")
    )
    smallest = ids.groupBy("root").agg(F.min("first_id").alias("least_id"))
    return prints, ids.join(smallest, "root").select("fingerprint", "root", "least_id")


def near_duplicates(docs: DataFrame, threshold: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row."""
    prints, named = grouped(docs, threshold, width, doc_id, text)
    return prints.join(named, "fingerprint").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("least_id.id").alias("component_id"),
    )


def keep_one(docs: DataFrame, threshold: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with its columns: of the smallest doc_id (null first), then the smallest text hash.

    Of rows that repeat doc_id and text any one stays; they are looked for only if there are some.
    """
    prints, named = grouped(docs, threshold, width, doc_id, text)
    # unlinked groups may share their smallest id (a null or repeated one), so a group is told by its root
    heads = prints.join(named, "fingerprint").where(F.struct("id").eqNullSafe(F.col("least_id")))
    heads = heads.groupBy("root").agg(F.min(F.struct("id", "tie")).alias("head")).select("head.id", "head.tie")
    mark = "keep_one_mark"
    while mark in [c.lower() for c in docs.columns]:
        mark += "_"
    marks = docs.withColumn(mark, F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tie")))
    same = F.col(mark)["id"].eqNullSafe(heads["id"]) & (F.col(mark)["tie"] == heads["tie"])
    kept = marks.join(heads, same, "left_semi")
    if not prints.groupBy("id", "tie").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([mark])
    return kept.select(*docs.columns)
