"""Fill-in-middle against a plain loop."""

import hashlib
import random

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewatch.llm import infill
from tidewatch.llm.queries import QUERIES

COLUMNS = ("doc_id", "fim_n", "fim_form", "fim_text", "fim_prefix_chars", "fim_middle_chars")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    gaps = [" ", "  ", "\n", "\t ", "\x0b", "\r\n", "\x1c", "\x85", "\u3000"]
    words = ["a", "é", "漢字", "🙂", "x́", "$1", "\\2", "${prefix}", "\\E\\Q", "<P", "S>", "<", ">", "<m>"]
    texts = [None, "", " ", "\n\t \x0b", "one", " one", "one ", "a <P> b", "a<S>", "<M>", "x" * 100_000, "y " * 60_000, " \n" * 50_000]
    texts += ["".join(rng.choice(words) + rng.choice(gaps) * rng.randrange(3) for _ in range(rng.randrange(60))) for _ in range(300)]
    out = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, "the same id"), (3, "the same id")]
    return out + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(100).collect()]


@pytest.mark.parametrize("rate", [0, 50, 100])
def test_texts(spark, rows, rate):
    df = spark.createDataFrame([(*r, "?", 7) for r in rows], "doc_id long, text string, n string, fim_row int")
    out = infill.fill_in_middle(df, rate=rate)
    assert out.columns == [*df.columns, "fim_n", "fim_form", "fim_text", "fim_prefix_chars", "fim_middle_chars"]
    got = sorted(map(tuple, out.select(*COLUMNS).collect()), key=str)
    assert got == sorted(brute.infill(rows, rate), key=str)
    back = out.where(infill.restored(F.col("fim_text"), F.col("fim_form")) != F.coalesce("text", F.lit("")))
    assert back.isEmpty()


def test_other_markers(spark, rows):
    marks = ("$1(", "\\Q[", "é|")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = infill.fill_in_middle(df, rate=100, markers=marks)
    assert out.where(infill.restored(F.col("fim_text"), F.col("fim_form"), marks) != F.coalesce("text", F.lit(""))).isEmpty()
    assert {r.fim_form for r in out.select("fim_form").distinct().collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("markers", [("a", "a", "b"), ("", "a", "b"), ("ab", "b", "c"), ("aba", "c", "d"), ("ab", "bc", "d")])
def test_markers_that_overlap_are_refused(markers):
    with pytest.raises(ValueError):
        infill.check_markers(markers)


def test_query_and_plan(spark, rows):
    plan = QUERIES["op12_fill_in_middle"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    got = {r.doc_id: r for r in QUERIES["op12_fill_in_middle"](spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(docs)
    for (i, text), (_, n, form, output, prefix, middle) in zip(docs, brute.infill(docs), strict=True):
        assert tuple(got[i]) == (i, n, form, prefix, middle, sha(output), sha(text or ""))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(df).count() == 0
