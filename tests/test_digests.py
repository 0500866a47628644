"""Digest trees of tables, and digests of files by byte ranges."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import digest
from tidewatch.functions.digest import changed_leaves, changed_rows, digest_tree, table_digest
from tidewatch.operators.integrity import IntegrityAudit
from tidewatch.sources import files


@pytest.fixture(params=[1024, 3])
def leaf_rows(request, monkeypatch):
    monkeypatch.setattr(digest, "LEAF_ROWS", request.param)
    return request.param


def table(spark, n=2000):
    k = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, None).otherwise("b")
    return spark.range(n).select("id", k.alias("k"), (F.col("id") % 7).cast("string").alias("s"), F.lit("same").alias("n_rows"))


def test_a_tree_adds_up(spark, leaf_rows):
    nodes = {r.node: (r.n_rows, r.sha) for r in digest_tree(table(spark)).collect()}
    depth = max(map(len, nodes))
    assert depth == {1024: 2, 3: 4}[leaf_rows]
    assert nodes[""][0] == 2000
    for name, (n, sha) in nodes.items():
        below = sorted((k, v) for k, v in nodes.items() if len(k) == len(name) + 2 and k.startswith(name))
        if below:
            assert n == sum(v[0] for _, v in below)
            assert sha == hashlib.sha256(("node|" + ",".join(f"{k}:{v[1]}" for k, v in below)).encode()).hexdigest()


def test_digests_of_a_key_depend_on_its_rows_alone(spark, leaf_rows):
    t = table(spark)
    shas = lambda df: {r.k: r.table_sha for r in table_digest(df, keys=["k"]).collect()}
    want = shas(t)
    assert set(want) == {"a", None, "b"}
    assert shas(t.repartition(13, "s").orderBy(F.desc("id"))) == want
    more = t.unionByName(table(spark, 30_000).where("k = 'a' AND id >= 2000"))
    now = shas(more)
    assert now[None] == want[None] and now["b"] == want["b"] and now["a"] != want["a"]


def test_copies_count(spark, leaf_rows):
    sha = lambda df: table_digest(df).first()["table_sha"]
    t = table(spark, 50)
    one, two = t.unionByName(t.where("id = 1")), t.unionByName(t.where("id = 2"))
    assert len({sha(x) for x in (t, one, two, one.unionByName(t.where("id = 1")), t.where("id <> 1"))}) == 5
    empty = table_digest(t.where("false")).first()
    assert empty.n_rows == 0 and empty.table_sha != sha(t) and table_digest(t.where("false"), keys=["k"]).count() == 0


def test_changed_leaves_name_the_place(spark, leaf_rows):
    t = table(spark)
    other = t.withColumn("s", F.when(F.col("id") == 77, "x").otherwise(F.col("s"))).where("id <> 78")
    a, b = digest_tree(t), digest_tree(other)
    assert changed_leaves(a, digest_tree(t.repartition(3))).isEmpty()
    # a row out, a row in and a row left out: three leaves at most
    assert 1 <= changed_leaves(a, b).count() <= 3
    got = sorted((r.id, r.s, r.side, r.times) for r in changed_rows(t, other).collect())
    assert got == [(77, "0", "before", 1), (77, "x", "now", 1), (78, "1", "before", 1)]
    assert changed_rows(t, t).isEmpty()
    assert changed_rows(t.where("id < 1"), t.where("id < 3").unionByName(t.where("id = 2"))).count() == 2
    keyed = changed_leaves(digest_tree(t, keys=["k"]), digest_tree(other, keys=["k"]), ["k"])
    assert {r.k for r in keyed.collect()} == {"b", "a"}


def test_an_audit_names_changed_lines(spark):
    lines = spark.range(3000).select(F.col("id").alias("line_no"), F.concat_ws(",", "id", F.col("id") * 2).alias("line"))
    audit = IntegrityAudit({"main": lines}, {"threshold": 0.05})
    now = lines.withColumn("line", F.when(F.col("line_no") == 1234, "1234,0").otherwise(F.col("line")))
    assert sorted((r.line_no, r.line, r.side) for r in audit.changed_lines("main", now).collect()) == [
        (1234, "1234,0", "now"),
        (1234, "1234,2468", "before"),
    ]


def test_files_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE_BYTES", 100)
    content = {"a.bin": os.urandom(2500), "b c.bin": b"x", "d.bin": os.urandom(1000)}
    for name, raw in content.items():
        (tmp_path / name).write_bytes(raw)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    name = F.url_decode(F.substring_index("path", "/", -1)).alias("name")
    got = {r.name: (r.bytes, r.sha256) for r in files.file_digests(spark, str(tmp_path)).select(name, "bytes", "sha256").collect()}
    assert got == {k: (len(v), sha(v)) for k, v in content.items()}
    ranges = files.file_ranges(spark, str(tmp_path), 1000).select(name, "start", "size", "sha256").collect()
    for r in ranges:
        assert r.sha256 == sha(content[r.name][r.start : r.start + r.size])
    assert sorted((r.name, r.start, r.size) for r in ranges) == [
        ("a.bin", 0, 1000), ("a.bin", 1000, 1000), ("a.bin", 2000, 500), ("b c.bin", 0, 1), ("d.bin", 0, 1000),
    ]
    trees = {r.name: r for r in files.file_tree_digests(spark, str(tmp_path), 1000).select(name, "bytes", "ranges", "tree_sha256").collect()}
    parts = [sha(content["a.bin"][i : i + 1000]) for i in range(0, 2500, 1000)]
    assert trees["a.bin"].tree_sha256 == sha("\n".join(parts).encode()) and trees["a.bin"].ranges == 3


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """Sparse, so that it takes no disk: no file is refused for its size."""
    path = tmp_path / "large.bin"
    with open(path, "wb") as file:
        file.truncate((2 << 30) + 5)
    ranges = files.file_ranges(spark, str(path), 256 << 20)
    got = ranges.collect()
    zeros = hashlib.sha256(bytes(256 << 20)).hexdigest()
    assert [r.sha256 for r in sorted(got, key=lambda r: r.start)[:8]] == [zeros] * 8
    assert sum(r.size for r in got) == (2 << 30) + 5


def test_rows_are_shuffled_as_bytes_and_digests_shared(spark):
    from tidewatch.functions.digest import _tree
    from tidewatch.operators.integrity import IntegrityAudit

    lines = spark.createDataFrame([(i, f"{i},{i % 7}" if i else "a,b") for i in range(50)], "line_no long, line string")
    plan = _tree(lines, ["line_no", "line"], [], stage=False)[0]._jdf.queryExecution().analyzed().toString()
    assert "unhex(" in plan
    audit = IntegrityAudit({"main": lines}, {"threshold": 0.05})
    reasons, cert = audit.run(audit.base, {"threshold": 0.05}, "r")
    ledger = audit.ledger_entry(cert)
    for now, ok in ((audit.digests({"main": lines}), True), (audit.digests({"main": lines.limit(49)}), False)):
        assert audit.verify(cert, now, reasons, {"threshold": 0.05}, ledger).first()["valid"] is ok
