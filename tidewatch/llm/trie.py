"""Prefix trie of conversations: ternary search trees per range shard, merged where shards meet.

Every conversation becomes the byte string of its turns, a record of 20 bytes each: 16 bytes of the
SHA-256 of (role, text) and the size of the text. Only these records are moved, never the texts.

1. Records are range-partitioned by the conversation whose head is borrowed, so a conversation and the
   one it borrows from meet in one place, and put in order there.
2. Equal conversations that stand in one partition become one row with their ids in order (packed, up to
   ``RUN_IDS``), so a conversation that fills a third of the table crosses once per partition.
3. Rows are range-partitioned by the byte string. Each *shard* therefore holds a contiguous stretch of the
   sorted trie. Runs of one string are joined while they stream by, with the SHA-256 of their ids carried
   along; no list of ids is held.
4. A shard's turns are numbered by a dictionary of its own, its strings are inserted into a ternary search
   tree, medians first, so every binary level of it is balanced, and one iterative pass from the last node
   to the first adds members, children, leaves and tokens to the parents.
5. Only nodes on the common prefix of two neighbouring shards are in several shards. Which they are follows
   from the last string of the shard before and the first of the one behind. A node counts for the first
   shard it is in, so the parts of these *border nodes* are plain sums, merged by one small aggregate
   (some rows of a path per shard). All other nodes are final.

What a node saves is the sum over its subtree of (members - 1) times bytes, kept as two sums: members
times bytes adds up over shards as it is, and bytes count once, at the shard that owns a node.

Defined results: rows without conv_id belong to no conversation and are left out; conversations follow
``turn``, null first, and rows of one turn by the digest of role and text; a null role or text is empty; a
negative conv_id takes its group by truncated division; repeated rows are turns of their own; an empty
table has no nodes, not even a root; texts are taken whole; other columns are ignored. A conversation is
one row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import stage_table

#: bytes of a turn: digest and size of its text
RECORD = 20
#: turns in a partition while conversations are put in order; bytes of strings in a shard; ids in a packed run
PART_TURNS = 400_000
SHARD_BYTES = 4 << 20
RUN_IDS = 1 << 16
LEAST_PARTS = 24


def record(role: Column, text: Column) -> Column:
    """20 bytes of a turn; its length first keeps (role, text) apart from any other split of the same letters."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, base, own): the records of each conversation in order; ``turns`` has conv_id, base, turn and record."""
    grouped = turns.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "record"))).alias("rows"))
    return grouped.select("conv_id", "base", F.col("rows.record").alias("own"))


def rebuilt(turns: DataFrame, heads: int) -> DataFrame:
    """(conv_id, seq): each conversation with its first h records taken from its base, h = crc32(conv_id) % heads."""
    own = in_order(turns)
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, heads))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    own = own.select("conv_id", "own", F.coalesce(head, F.array().cast("array<binary>")).alias("head"), h.alias("h"))
    tail = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    whole = F.concat(F.slice("head", F.lit(1), F.col("h")), tail)
    return own.select("conv_id", F.unhex(F.array_join(F.transform(whole, F.hex), "")).alias("seq"))


def packed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (seq, conv_id) in order to (seq, first_id, ids): equal neighbours are one row of up to RUN_IDS ids."""
    seq, ids = None, []

    def rows(done: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "seq": pa.array([s for s, _ in done], pa.binary()),
                "first_id": pa.array([x[0] for _, x in done], pa.int64()),
                "ids": pa.array([np.array(x, "<i8").tobytes() for _, x in done], pa.binary()),
            }
        )

    for batch in batches:
        done = []
        for s, i in zip(batch["seq"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if s != seq or len(ids) == RUN_IDS:
                if ids:
                    done.append((seq, ids))
                seq, ids = s, []
            ids.append(i)
        if done:
            yield rows(done)
    if ids:
        yield rows([(seq, ids)])


def joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order to one row per string: (shard, seq, n, conv_id, ends); the ids stream through their digest."""
    shard = TaskContext.get().partitionId()
    seq, digest, n, first = None, None, 0, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(done), pa.int32()), *columns], ["shard", "seq", "n", "conv_id", "ends"])

    for batch in batches:
        done = []
        for s, ids in zip(batch["seq"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if s != seq:
                if n:
                    done.append((seq, n, first, digest.hexdigest()))
                seq, digest, n = s, hashlib.sha256(), 0
            some = np.frombuffer(ids, "<i8")
            first = int(some[0]) if n == 0 else first
            digest.update((("," if n else "") + ",".join(map(str, some.tolist()))).encode())
            n += len(some)
        if done:
            yield rows(done)
    if n:
        yield rows([(seq, n, first, digest.hexdigest())])


def common(a: bytes | None, b: bytes | None) -> int:
    """Turns in the common prefix of two strings; -1 if there is none to compare with."""
    if a is None or b is None:
        return -1
    most = min(len(a), len(b)) // RECORD
    return next((d for d in range(most) if a[d * RECORD : (d + 1) * RECORD] != b[d * RECORD : (d + 1) * RECORD]), most)


def medians(n: int) -> Iterator[int]:
    """0..n-1, the middle of every stretch before its halves."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            mid = (low + high) // 2
            yield mid
            todo += [(mid + 1, high), (low, mid)]


class SearchTree:
    """A ternary search tree over numbered turns; node 0 is the root of the trie and holds no turn."""

    def __init__(self):
        self.turn, self.less, self.more, self.next = [-1], [0], [0], [0]
        self.parent, self.depth = [-1], [0]

    def _new(self, turn: int, parent: int) -> int:
        for column, value in ((self.turn, turn), (self.less, 0), (self.more, 0), (self.next, 0), (self.parent, parent), (self.depth, self.depth[parent] + 1)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int]) -> int:
        """The node at which ``turns`` end."""
        node = 0
        for turn in turns:
            at = self.next[node]
            if not at:
                at = self.next[node] = self._new(turn, node)
            while self.turn[at] != turn:
                side = self.less if turn < self.turn[at] else self.more
                if not side[at]:
                    side[at] = self._new(turn, node)
                at = side[at]
            node = at
        return node

    def path(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        out = [node]
        while out[-1]:
            out.append(self.parent[out[-1]])
        return out[::-1]


def numbered(seqs: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
    """Strings as numbers of a dictionary in the order of the records, and the text size of each number."""
    raw = np.frombuffer(bytearray().join(seqs), np.dtype([("a", ">u8"), ("b", ">u8"), ("size", ">u4")]))
    order = np.lexsort((raw["size"], raw["b"], raw["a"]))
    rows = raw[order]
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] != rows[:-1]
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    bounds = np.cumsum([0] + [len(s) // RECORD for s in seqs])
    return [number[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], rows["size"][new].astype(np.int64)


NODE = (
    "shard int, node int, parent int, depth long, border boolean, below_border boolean, key binary, parent_key binary, "
    "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, through long, once long, ends string"
)


def shard_nodes(strings: pa.Table, borders: pa.Table) -> pa.Table:
    """The trie nodes of one shard, those it shares with its neighbours marked and in parts."""
    strings = strings.sort_by("seq")
    seqs = strings["seq"].to_pylist()
    n, first, ends = (strings[c].to_pylist() for c in ("n", "conv_id", "ends"))
    turns, size_of = numbered(seqs)
    tree = SearchTree()
    end_node = [0] * len(seqs)
    for i in medians(len(seqs)):
        end_node[i] = tree.insert(turns[i])

    nodes = len(tree.turn)
    before = common(seqs[0], borders["before"][0].as_py())
    behind = common(seqs[-1], borders["behind"][0].as_py())
    shared_before = set(tree.path(end_node[0])[: before + 1])
    shared_behind = set(tree.path(end_node[-1])[: behind + 1])

    members, conv, digest = [0] * nodes, [None] * nodes, [None] * nodes
    for i, node in enumerate(end_node):
        members[node], conv[node], digest[node] = n[i], first[i], ends[i]
    children, leaves, through, once = ([0] * nodes for _ in range(4))
    # a node is made after its parent, so the last one first is a traversal from the leaves up
    for node in range(nodes - 1, -1, -1):
        if not tree.next[node] and node not in shared_behind:
            leaves[node] = 1
        size = int(size_of[tree.turn[node]]) if node else 0
        through[node] += members[node] * size
        owned = node not in shared_before
        if owned:
            once[node] += size
        up = tree.parent[node]
        if up >= 0:
            members[up] += members[node]
            conv[up] = conv[node] if conv[up] is None else min(conv[up], conv[node])
            leaves[up] += leaves[node]
            through[up] += through[node]
            once[up] += once[node]
            children[up] += owned

    # a border node is known in all its shards by the chained digest of its turns
    key: list[bytes | None] = [None] * nodes
    records = {node: turn for path, seq in ((tree.path(end_node[0]), seqs[0]), (tree.path(end_node[-1]), seqs[-1])) for node, turn in zip(path[1:], (seq[a : a + RECORD] for a in range(0, len(seq), RECORD)), strict=True)}
    for node in sorted(shared_before | shared_behind):
        key[node] = hashlib.sha256(key[tree.parent[node]] + records[node] if node else b"").digest()[:16]
    up = tree.parent
    return pa.table(
        {
            "shard": pa.array([strings["shard"][0].as_py()] * nodes, pa.int32()),
            "node": pa.array(range(nodes), pa.int32()),
            "parent": pa.array(up, pa.int32()),
            "depth": pa.array(tree.depth, pa.int64()),
            "border": pa.array([k is not None for k in key]),
            "below_border": pa.array([p >= 0 and key[p] is not None for p in up]),
            "key": pa.array(key, pa.binary()),
            "parent_key": pa.array([key[p] if p >= 0 else None for p in up], pa.binary()),
            "conv_id": pa.array(conv, pa.int64()),
            "parent_conv_id": pa.array([conv[p] if p >= 0 else None for p in up], pa.int64()),
            "n_convs": pa.array(members, pa.int64()),
            "n_children": pa.array(children, pa.int64()),
            "n_leaves": pa.array(leaves, pa.int64()),
            "through": pa.array(through, pa.int64()),
            "once": pa.array(once, pa.int64()),
            "ends": pa.array(digest, pa.string()),
        }
    )


def merged(nodes: DataFrame) -> DataFrame:
    """Final nodes: border nodes summed over their shards, all nodes with the smallest member of their parent."""
    values = ["conv_id", "n_convs", "n_children", "n_leaves", "through", "once", "ends"]
    border = nodes.where("border").groupBy("depth", "key").agg(
        F.first("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "through", "once")],
        F.max("ends").alias("ends"),
    )
    border = stage_table(border, "trie-borders")
    above = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    shared = border.join(above, "parent_key", "left").select("depth", "parent_conv_id", *values)
    # children meet their border node's smallest member by (shard, node), so those of the root are spread
    here = nodes.where("border").select("shard", F.col("node").alias("parent"), "key")
    known = here.join(above, F.col("key") == F.col("parent_key")).select("shard", "parent", "parent_conv_id")
    below = nodes.where("NOT border AND below_border").drop("parent_conv_id")
    below = below.join(known, ["shard", "parent"]).select("depth", "parent_conv_id", *values)
    inner = nodes.where("NOT border AND NOT below_border").select("depth", "parent_conv_id", *values)
    return inner.unionByName(below).unionByName(shared)


def prefix_trie(
    conversations: DataFrame,
    heads: int = 9,
    group: int = 5,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. A conversation's first ``h`` turns, h = crc32(conv_id) % ``heads``, come from the first one
    of its group of ``group`` consecutive ids; ``heads`` 1 leaves every conversation as it is.
    """
    source = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), record(F.col(role), F.col(text)).alias("record")
    )
    turns = stage_table(source.withColumn("base", F.col("conv_id") - F.col("conv_id") % group), "turns")
    parts = max(LEAST_PARTS, -(-turns.count() // PART_TURNS))
    whole = rebuilt(turns.repartitionByRange(parts, "base"), heads).sortWithinPartitions("seq", "conv_id")
    runs = stage_table(whole.mapInArrow(packed_runs, "seq binary, first_id long, ids binary"), "runs")
    held = runs.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
    shards = max(LEAST_PARTS, -(-held // SHARD_BYTES))
    ranged = runs.repartitionByRange(shards, "seq").sortWithinPartitions("seq", "first_id").select("seq", "ids")
    strings = stage_table(ranged.mapInArrow(joined_runs, "shard int, seq binary, n long, conv_id long, ends string"), "strings")
    # one row per shard
    edges = strings.groupBy("shard").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    by_shard = Window.orderBy("shard")
    borders = edges.select("shard", F.lag("high").over(by_shard).alias("before"), F.lead("low").over(by_shard).alias("behind"))
    nodes = strings.groupBy("shard").cogroup(borders.groupBy("shard")).applyInArrow(shard_nodes, NODE)
    none = hashlib.sha256().hexdigest()
    return merged(stage_table(nodes, "trie-nodes")).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("through") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
    )
