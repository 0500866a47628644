"""Memory that the tasks of the language model take, and give back."""

from __future__ import annotations

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidewatch.llm import exchange as ex
from tidewatch.llm import kernel as kn
from tidewatch.llm import lm


def test_distinct_keys_are_those_of_numpy():
    rng = np.random.default_rng(2)
    for n, most in ((0, 5), (1, 5), (1000, 50), (1000, 1 << 62)):
        key = rng.integers(0, most, n, dtype=np.uint64)
        values, number, sample = kn.distinct(key)
        expected, inverse = np.unique(key, return_inverse=True)
        assert values.tolist() == expected.tolist() and number.tolist() == inverse.tolist()
        assert key[sample].tolist() == values.tolist()


def part(no: int, texts: int, rng: np.random.Generator) -> pa.Table:
    words = np.array([f"w{i}" for i in range(20_000)])
    text = [" ".join(words[(rng.random(200) ** 3 * len(words)).astype(int)]) for _ in range(texts)]
    return pa.table({"part": pa.array([no] * texts, pa.int32()), "doc_id": np.arange(texts) * 2 + no, "text": text})


def taken(task, *tables: pa.Table) -> tuple[pa.Table, int]:
    """What a task returns, and the most memory it held."""
    tracemalloc.start()
    try:
        out = task(*tables)
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def by(table: pa.Table, column: str) -> list[pa.Table]:
    return [table.filter(pc.equal(table[column], x)) for x in sorted(set(table[column].to_pylist()))]


def test_tasks_hold_few_bytes_a_token():
    rng, order, buckets = np.random.default_rng(5), 3, [2, 2, 2]
    parts, tokens = [part(no, 4000, rng) for no in (0, 1)], 4000 * 201
    asked = pa.concat_tables([lm.ask(order, buckets, 7, 2)(t) for t in parts])
    answered = [(taken(lm.answer, g), sum(len(kn.unpack_gaps(x)) for x in g["keys"].to_pylist())) for g in by(asked, "bucket")]
    assert max(most / keys for (_, most), keys in answered) < 50  # 31 to 40; 61 to 65 with np.unique over all at once
    answers = by(pa.concat_tables([out for (out, _), _ in answered]), "part")
    longest = pa.concat_tables([lm.ask_longest(order, buckets, 7, 2)(t, a) for t, a in zip(parts, answers, strict=True)])
    longest = by(pa.concat_tables([lm.answer(g) for g in by(longest, "bucket")]), "part")[0]
    sums = {"part": 0, "level": -1, "bucket": -1, "counts": None, "shared": None, "total": tokens, "types": 20_000}
    mine = pa.concat_tables([answers[0], longest, pa.Table.from_pylist([sums], answers[0].schema)])
    out, most = taken(lm.walk(order, lm.KAPPA, 7, 2, lm.PIECE), parts[0], mine)
    assert most / tokens < 140  # 116; 175 with arrays of 64 bits kept to the end
    assert out["n_tokens"].to_pylist() == [201] * 4000


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="reads Linux's figures")
def test_freed_memory_goes_back_between_groups():
    def held() -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    arrays = [np.ones(8000) for _ in range(2000)]  # 128 MB in pieces that are no mappings of their own
    kept = arrays[::50]
    before = held()
    del arrays
    # the pieces kept in between hold the heap as it is, until the task of the next group begins
    assert held() > before - 60
    assert len(lm.ask(3, [2, 2, 2], 7, 2)(part(0, 3, np.random.default_rng(1))))
    assert held() < before - 90 and len(kept) == 40


def test_a_task_has_the_texts_of_one_part(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('a text of number ', id) AS text")
    out = lm.score_texts(docs, order=3).select("doc_id", F.spark_partition_id().alias("task"))
    parts = out.withColumn("part", ex.part_of(F.col("doc_id"), 64)).groupBy("task").agg(F.countDistinct("part").alias("n"))
    assert [r.n for r in parts.collect()] == [1] * 64


def test_a_task_has_the_keys_of_one_bucket(spark, monkeypatch, tmp_path):
    answer = lm.answer

    def noted(table):
        assert len(set(table["bucket"].to_pylist())) == 1
        task = TaskContext.get()
        (tmp_path / f"{task.stageId()}-{task.partitionId()}-{table['bucket'][0]}").touch()
        return answer(table)

    monkeypatch.setattr(lm, "answer", noted)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('a text of number ', id, ' ', id % 700) AS text")
    assert lm.score_texts(docs, order=3).count() == 2000
    tasks = [x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()]
    assert len(tasks) >= 3 * 24 and len(set(tasks)) == len(tasks)
