"""The prefix trie against plain loops."""

import random

import brute
import pytest
from conftest import SF

from tidewatch.llm import trie
from tidewatch.llm.queries import QUERIES

SCHEMA = "conv_id long, turn int, role string, text string, shard string, node string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?", "?", "?") for r in rows], SCHEMA).repartition(4)


def check(out, rows, **options):
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(brute.trie(rows, **options), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    first = [("user", "hello"), ("user", "é 漢"), ("", ""), (None, None), ("us", "erhello")]
    rows = []
    for c in [*range(-12, 60), 1 << 40, -(1 << 63), (1 << 63) - 1]:
        for t in range(rng.randrange(7)):
            role, text = first[0] if t == 0 and rng.random() < 0.6 else rng.choice(first)
            rows.append((c, rng.choice([t, t, t, None, 1]), role, text))
    for c in range(1000, 1200):
        rows += [(c, 0, "user", "the same"), (c, 1, "bot", "answer")]
    rows += [(2001, t, "user", f"long {t % 3}") for t in range(250)] + [(2002, t, "user", f"long {t % 3}") for t in range(240)]
    rows += [(None, 1, "user", "no conversation"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("options", [{}, {"heads": 1, "group": 5}, {"heads": 4, "group": 3}])
def test_nodes(spark, rows, options):
    check(trie.prefix_trie(frame(spark, rows), **options), rows, **options)


def test_small_shards_and_runs(spark, rows, monkeypatch):
    """Nearly every node is shared by shards, and runs of equal conversations are cut."""
    some = [r for r in rows if r[0] is None or r[0] < 2000]
    monkeypatch.setattr(trie, "SHARD_BYTES", 60)
    monkeypatch.setattr(trie, "PART_TURNS", 20)
    check(trie.prefix_trie(frame(spark, some)), some)


def test_one_shard(spark, rows, monkeypatch):
    monkeypatch.setattr(trie, "LEAST_PARTS", 1)
    check(trie.prefix_trie(frame(spark, rows)), rows)


def test_runs_are_cut_and_joined(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(trie, "RUN_IDS", 3)
    given = [(b"", 5), *((b"a", i) for i in range(10)), (b"b", 1), (b"b", 9)]
    batches = [pa.RecordBatch.from_pylist([{"seq": s, "conv_id": i} for s, i in given[a : a + 4]]) for a in range(0, len(given), 4)]
    runs = [r for b in trie.packed_runs(iter(batches)) for r in b.to_pylist()]
    assert [(r["seq"], r["first_id"], len(r["ids"]) // 8) for r in runs] == [(b"", 5, 1), (b"a", 0, 3), (b"a", 3, 3), (b"a", 6, 3), (b"a", 9, 1), (b"b", 1, 2)]


def test_medians_balance_the_tree():
    assert sorted(trie.medians(1000)) == list(range(1000))
    tree = trie.SearchTree()
    ends = {i: tree.insert([i]) for i in trie.medians(1000)}
    assert sorted(ends) == list(range(1000)) and len(tree.turn) == 1001

    def height(at):
        return 0 if not at else 1 + max(height(tree.less[at]), height(tree.more[at]))

    assert height(tree.next[0]) == 10


def test_a_conversation_without_turns(spark):
    """Conversation 7 borrows more turns than its base has, and has none of its own left."""
    import zlib

    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "a", "x"), (c, 1, "a", "y")]
    check(trie.prefix_trie(frame(spark, rows)), rows)
    assert trie.prefix_trie(frame(spark, rows)).first().n_convs == 1


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(QUERIES["op13_prefix_trie"](spark, SF), rows)


def test_empty(spark):
    assert trie.prefix_trie(frame(spark, [])).count() == 0
