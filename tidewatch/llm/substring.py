"""Substring deduplication by De Bruijn compaction.

Every run of ``k`` words of a document is an edge between the nodes of its first and last k - 1
words. Only *repeated* edges matter, and they are found in two steps:

1. A window's anchor is the smallest hash of its m-word runs; equal windows have equal anchors.
   Anchors that occur once are dropped: they bound the graph to what can repeat at all.
2. The edges at the other anchors meet by hash. The first occurrence (smaller doc_id, then earlier
   start) becomes the edge's source coordinate, the others point to it.

Consecutive edges of a document whose sources are consecutive too form a nonbranching path: it ends
where the repetition ends or where another source takes over. Paths are compacted to one row each,
joined with the words at their source coordinates, and removed only if the words are equal.

Edges travel packed (see ``exchange``): a part sends a distinct edge once, so neither a document
copied a million times nor a word repeated a million times makes a large group. Texts are shuffled
once, by part, and that exchange is reused by all four passes.

Defined results: a null text has no words; an empty table gives an empty result; rows that share a
doc_id are read one after another in the order of their texts; a null doc_id sorts first and comes
back as null; texts of any length are taken whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import exchange as ex
from tidewatch.llm import kernel as kn

#: places between the words of rows that share a doc_id
ROW_STRIDE = 1 << 40
ANCHOR_WORDS = 8

PIECES = "doc_id long, start long, n long, src_doc long, src_start long"


def _rows_of_part(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The part in order, its doc_ids, and what is added to word positions of each row."""
    table = ex.in_order(table)
    ids = table["doc_id"].to_numpy()
    same = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1) != 0)
    nth = np.arange(len(ids)) - np.repeat(same, np.diff(np.append(same, len(ids))))
    return table, ids, nth * ROW_STRIDE


def _windows(table: pa.Table, k: int, m: int, with_edges: bool):
    """Of all windows in order: anchor, and with ``with_edges`` hash, row and start word."""
    hasher, table_of = kn.Hasher(), kn.is_word_byte()
    out: list[tuple] = []
    for row, data, off in kn.slices(table["text"]):
        start, end, first = kn.find_words(data, off, table_of)
        at = kn.run_starts(first, k)
        if not len(at):
            continue
        word = hasher.word_hash(data, start, end)
        anchor = kn.mix(kn.slide_min(hasher.run_hash(word, m), k - m + 1)[at])
        if with_edges:
            rows = kn.row_of(first)[at]
            out.append((anchor, hasher.run_hash(word, k)[at], rows + row, at - first[rows]))
        else:
            out.append((anchor,))
    if not out:
        out = [tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)[: 4 if with_edges else 1])]
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _groups(anchor: np.ndarray) -> np.ndarray:
    """Stretches of windows with one anchor: the first window of each."""
    return np.flatnonzero(np.diff(anchor, prepend=anchor[:1] + np.uint64(1)))


def _near_repeats(edge: np.ndarray, reach: int) -> np.ndarray:
    """Windows that are repeated a few words further on."""
    out = np.zeros(len(edge), bool)
    for step in range(1, min(reach, len(edge) - 1) + 1):
        out[:-step] |= edge[step:] == edge[:-step]
    return out


def anchors(k: int, m: int, buckets: int):
    """Pass 1: the distinct anchors of a part, packed by bucket."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        (anchor,) = _windows(table, k, m, False)
        keys = np.unique(anchor[_groups(anchor)])
        bucket, bound = ex.by_bucket(keys, buckets)
        packed = [kn.pack(keys[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]
        return pa.table({"bucket": bucket, "part": np.full(len(bucket), part, np.int32), "keys": ex.binary(packed)})

    return run


def shared_anchors(table: pa.Table) -> pa.Table:
    """Pass 1, answer: of each part's anchors, those that another part has too."""
    each = [kn.unpack(x, np.uint64) for x in table["keys"].to_pylist()]
    keys = np.sort(np.concatenate(each))
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
    hits = [x[_found(x, twice)] for x in each]
    have = [i for i, x in enumerate(hits) if len(x)]
    return pa.table(
        {"part": table["part"].to_numpy()[have].astype(np.int32), "keys": ex.binary([kn.pack(hits[i]) for i in have])}
    )


def _found(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def edges(k: int, m: int, buckets: int):
    """Pass 2: distinct edges at repeated anchors, by bucket; later ones of the part point to its first."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table(
            {"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int32())}
            | {c: ex.binary([]) for c in ("edge", "doc", "start", "pieces")}
        )
        if not table.num_rows:
            return empty
        part = table["part"][0].as_py()
        table, ids, shift = _rows_of_part(table)
        anchor, edge, row, start = _windows(table, k, m, True)
        first = np.union1d(_groups(anchor), _groups(row.astype(np.uint64)))
        size = np.diff(np.append(first, len(anchor)))
        values, inverse, times = np.unique(anchor[first], return_inverse=True, return_counts=True)
        # twice in one stretch: it is longer than one anchor's reach, or a window comes again within it
        keep = times > 1
        keep[inverse[size > k - m + 1]] = True
        keep[np.searchsorted(values, anchor[_near_repeats(edge, k - m)])] = True
        if answers.num_rows:
            keep |= _found(values, np.unique(np.concatenate([kn.unpack(x, np.uint64) for x in answers["keys"].to_pylist()])))
        chosen = np.flatnonzero(np.repeat(keep[inverse], size))
        edge, row, start = edge[chosen], row[chosen], start[chosen]
        if not len(edge):
            return empty
        doc, start = ids[row], start + shift[row]
        # windows are in (doc_id, start) order already, so a stable sort keeps the first one in front
        order = np.argsort(edge, kind="stable")
        edge, doc, start = edge[order], doc[order], start[order]
        new = np.diff(edge, prepend=edge[:1] + np.uint64(1)) != 0
        source = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = ~new
        pieces = _merge(doc[later], start[later], doc[source[later]], start[source[later]])
        edge, doc, start = edge[new], doc[new], start[new]
        bucket, bound = ex.by_bucket(edge, buckets)
        cols = {"edge": [], "doc": [], "start": [], "pieces": []}
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            o = a + np.lexsort((start[a:b], doc[a:b]))
            cols["edge"].append(kn.pack(edge[o]))
            cols["doc"].append(kn.pack_steps(doc[o]))
            cols["start"].append(kn.pack_steps(start[o]))
            cols["pieces"].append(b"")
        cols["pieces"][0] = b"".join(kn.pack_steps(x) for x in pieces)
        return pa.table(
            {"bucket": bucket, "part": np.full(len(bucket), part, np.int32)} | {c: ex.binary(x) for c, x in cols.items()}
        )

    return run


def _merge(doc, start, src_doc, src_start, n=None) -> np.ndarray:
    """Edges (or paths of n edges) to nonbranching paths: five rows of doc, start, n, src_doc, src_start."""
    if n is None:
        n = np.ones(len(doc), np.int64)
    order = np.lexsort((start, doc))
    doc, start, src_doc, src_start, n = (x[order] for x in (doc, start, src_doc, src_start, n))
    new = np.ones(len(doc), bool)
    new[1:] = (
        (doc[1:] != doc[:-1])
        | (start[1:] != start[:-1] + n[:-1])
        | (src_doc[1:] != src_doc[:-1])
        | (src_start[1:] != src_start[:-1] + n[:-1])
    )
    first = np.flatnonzero(new)
    total = np.add.reduceat(n, first) if len(first) else n
    return np.stack([doc[first], start[first], total, src_doc[first], src_start[first]]).astype(np.int64)


def first_sources(table: pa.Table) -> pa.Table:
    """Pass 2, answer: each edge occurrence that is not the first, with the first one's coordinates."""
    size = [len(x) // 8 for x in table["edge"].to_pylist()]
    edge = np.concatenate([kn.unpack(x, np.uint64) for x in table["edge"].to_pylist()])
    doc = np.concatenate([kn.unpack_steps(x, np.int64) for x in table["doc"].to_pylist()])
    start = np.concatenate([kn.unpack_steps(x, np.int64) for x in table["start"].to_pylist()])
    sender = np.repeat(np.arange(len(size)), size)
    # only edges sent by two parts: the rest are answered where they are
    order = np.argsort(edge)
    same = edge[order]
    equal = same[1:] == same[:-1]
    pair = np.zeros(len(edge), bool)
    pair[1:] |= equal
    pair[:-1] |= equal
    chosen = order[pair]
    edge, doc, start, sender = edge[chosen], doc[chosen], start[chosen], sender[chosen]
    order = np.lexsort((start, doc, edge))
    edge, doc, start, sender = (x[order] for x in (edge, doc, start, sender))
    new = np.diff(edge, prepend=edge[:1] + np.uint64(1)) != 0
    source = np.flatnonzero(new)[np.cumsum(new) - 1] if len(edge) else np.zeros(0, np.int64)
    later = np.flatnonzero(~new)
    later = later[np.lexsort((start[later], doc[later], sender[later]))]
    bound = np.searchsorted(sender[later], np.arange(len(size) + 1))
    parts, packed, given = table["part"].to_pylist(), [], table["pieces"].to_pylist()
    who = []
    for i in range(len(size)):
        x = later[bound[i] : bound[i + 1]]
        if len(x):
            found = _merge(doc[x], start[x], doc[source[x]], start[source[x]])
            who.append(parts[i])
            packed.append(_packed(found))
        if given[i]:
            who.append(parts[i])
            packed.append(given[i])
    return pa.table({"part": pa.array(who, pa.int32()), "pieces": ex.binary(packed)})


def _packed(found: np.ndarray) -> bytes:
    return b"".join(kn.pack_steps(x) for x in found)


def paths(table: pa.Table) -> pa.Table:
    """Pass 3: the edges of a part's documents compacted to nonbranching paths."""
    each = [np.cumsum(kn.unpack(x, np.int64).reshape(5, -1), axis=1) for x in table["pieces"].to_pylist()]
    doc, start, n, src_doc, src_start = np.concatenate(each, axis=1)
    # an edge can come twice: pointing to the part's first, and to the first of all; the smaller source wins
    if len(n) and n.max() > 1:
        reps = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(reps)) - np.repeat(np.cumsum(n) - n, n)
        doc, start, src_doc, src_start = doc[reps], start[reps] + step, src_doc[reps], src_start[reps] + step
    order = np.lexsort((src_start, src_doc, start, doc))
    doc, start, src_doc, src_start = (x[order] for x in (doc, start, src_doc, src_start))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    out = _merge(doc[new], start[new], src_doc[new], src_start[new])
    return pa.table(dict(zip(("doc_id", "start", "n", "src_doc", "src_start"), out, strict=True)))


def _words_of(table: pa.Table, wanted: pa.Table, digest):
    """Call ``digest`` per row with its words; wanted: (doc_id, start) rows sorted by the caller."""
    table, ids, shift = _rows_of_part(table)
    is_word = kn.is_word_byte()
    for row, data, off in kn.slices(table["text"]):
        start, end, first = kn.find_words(data, off, is_word)
        digest(row, data, start, end, first, ids, shift)


def source_digests(k: int):
    """Pass 4: digests of the words at source coordinates."""

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"doc_id": [], "start": [], "n": [], "digest": []}
        if table.num_rows and asked.num_rows:
            doc, at, n = (asked[c].to_numpy() for c in ("src_doc", "src_start", "n"))
            order = np.lexsort((at, doc))
            doc, at, n = doc[order], at[order], n[order]
            low = np.searchsorted(doc, np.unique(doc))
            where = dict(zip(doc[low].tolist(), zip(low.tolist(), np.append(low[1:], len(doc)).tolist(), strict=True), strict=True))

            def digest(row, data, start, end, first, ids, shift):
                for i in range(len(first) - 1):
                    span = where.get(int(ids[row + i]))
                    if span is None or first[i] == first[i + 1]:
                        continue
                    base, count = int(shift[row + i]), int(first[i + 1] - first[i])
                    for j in range(*span):
                        s = int(at[j]) - base
                        if 0 <= s and s + int(n[j]) + k - 1 <= count:
                            out["doc_id"].append(int(doc[j]))
                            out["start"].append(int(at[j]))
                            out["n"].append(int(n[j]))
                            out["digest"].append(words_digest(data, start, end, first[i] + s, int(n[j]) + k - 1))

            _words_of(table, asked, digest)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), types, strict=True)})

    return run


def words_digest(data, start, end, first: int, n: int) -> bytes:
    """128 bits over n words, independent of the white space between them."""
    s, e = start[first : first + n], end[first : first + n]
    low, high = int(s[0]), int(e[-1])
    text, _ = kn.spaced(data[low:high], s - low, e - low, np.ones(n, bool))
    return hashlib.blake2b(text.tobytes(), digest_size=16).digest()


def cut(k: int, with_text: bool):
    """Last pass: remove the words of paths whose words are those at the source."""

    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        ids_out, words, gone, sums, texts, spans_out = [], [], [], [], [], []
        if table.num_rows:
            doc, at, n = (spans[c].to_numpy() for c in ("doc_id", "start", "n"))
            order = np.lexsort((at, doc))
            doc, at, n = doc[order], at[order], n[order]
            proof = spans["digest"].take(pa.array(order)).to_pylist()
            bounds = np.searchsorted(doc, np.unique(doc))
            where = dict(zip(doc[bounds].tolist(), zip(bounds.tolist(), np.append(bounds[1:], len(doc)).tolist(), strict=True), strict=True)) if len(doc) else {}

            def digest(row, data, start, end, first, ids, shift):
                drop_start, drop_len, kept_spans = [], [], []
                for i in range(len(first) - 1):
                    mine = []
                    span = where.get(int(ids[row + i])) if len(doc) else None
                    if span is not None:
                        base, count = int(shift[row + i]), int(first[i + 1] - first[i])
                        for j in range(*span):
                            s, size = int(at[j]) - base, int(n[j]) + k - 1
                            if 0 <= s and s + size <= count and words_digest(data, start, end, first[i] + s, size) == proof[j]:
                                drop_start.append(first[i] + s)
                                drop_len.append(size)
                                mine.append((s, size))
                    kept_spans.append(mine)
                keep = ~kn.covered(np.array(drop_start, np.int64), np.array(drop_len, np.int64), len(start))
                out, to = kn.spaced(data, start, end, keep)
                raw = out.tobytes()
                kept = np.concatenate([[0], np.cumsum(keep)])[first]
                for i in range(len(first) - 1):
                    a, b = int(to[first[i]]), int(to[first[i + 1]])
                    text = raw[a : max(a, b - 1)]
                    sums.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        texts.append(text.decode())
                ids_out.append(ids[row : row + len(first) - 1])
                words.append(np.diff(first))
                gone.append(np.diff(first) - np.diff(kept))
                spans_out.extend(kept_spans)

            _words_of(table, spans, digest)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        out = {"doc_id": ex.id_column(join(ids_out)), "n_words": join(words), "n_removed": join(gone)}
        out["kept_sha256"] = pa.array(sums, pa.string())
        out["removed_spans"] = pa.array([[{"start": s, "n_words": n} for s, n in x] for x in spans_out], SPANS)
        if with_text:
            out["kept_text"] = pa.array(texts, pa.string())
        return pa.table(out)

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))


def dedup_substrings(
    docs: DataFrame, k: int = 20, anchor_words: int = ANCHOR_WORDS, with_text: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed_spans[, kept_text]), one row per input row.

    A word goes if a window of ``k`` words over it has an equal window that starts earlier.
    ``kept_text`` holds the other words joined by one space.
    """
    m = min(anchor_words, k)
    total = ex.text_bytes(docs, text)
    parts = ex.part_count(total)
    windows = total / 5
    texts = ex.in_parts(docs, parts, doc_id, text)
    grouped = texts.groupBy("part")
    asked = grouped.applyInArrow(anchors(k, m, b := ex.bucket_count(windows / 6)), "bucket int, part int, keys binary")
    shared = asked.groupBy("bucket").applyInArrow(shared_anchors, "part int, keys binary")
    found = grouped.cogroup(shared.groupBy("part")).applyInArrow(
        edges(k, m, max(b, ex.bucket_count(windows / 4))),
        "bucket int, part int, edge binary, doc binary, start binary, pieces binary",
    )
    sources = found.groupBy("bucket").applyInArrow(first_sources, "part int, pieces binary")
    compact = sources.groupBy("part").applyInArrow(paths, PIECES)
    wanted = compact.select("src_doc", "src_start", "n").distinct()
    id_back = lambda c: F.when(F.col(c) != ex.NULL_ID, F.col(c))
    proof = grouped.cogroup(
        wanted.withColumn("part", ex.part_of(id_back("src_doc"), parts)).groupBy("part")
    ).applyInArrow(source_digests(k), "doc_id long, start long, n long, digest binary")
    proof = proof.select(F.col("doc_id").alias("src_doc"), F.col("start").alias("src_start"), "n", "digest")
    checked = compact.join(proof, ["src_doc", "src_start", "n"]).select(
        ex.part_of(id_back("doc_id"), parts).alias("part"), "doc_id", "start", "n", "digest"
    )
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans array<struct<start:long,n_words:long>>"
    return grouped.cogroup(checked.groupBy("part")).applyInArrow(
        cut(k, with_text), schema + ", kept_text string" * with_text
    )
