"""The rule ensemble: statistics against plain loops, accuracy on held-out documents, edge cases."""

import random
import zlib

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidewatch.llm import ruleset
from tidewatch.llm.quality import STOP_WORDS
from tidewatch.llm.queries import QUERIES

STOPS = set().union(*STOP_WORDS.values())
LARGER = "/root/testdata/sf0.1"
TREE = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=13
  If (feature 2 <= 0.5)
   If (feature 0 <= 10.25)
    Predict: 0.0
   Else (feature 0 > 10.25)
    Predict: 1.0
  Else (feature 2 > 0.5)
   If (feature 2 <= 0.75)
    Predict: 1.0
   Else (feature 2 > 0.75)
    Predict: 0.0
"""


def test_statistics(spark):
    rng = random.Random(4)
    letters = ["the", "The", "la", "x", "X", "é", "漢", "!!", "|", "###", "12", "a,b.", "\n", "\n\n", " ", "\t", "\x0b", "\x1c", "&"]
    texts = [None, "", " ", "\n \n", "one", "a a a a", "l\nl\nl", "x" * 100_000, "w " * 50_000]
    texts += ["".join(rng.choice(letters) + rng.choice(["", " "]) for _ in range(rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", ruleset.statistics(F.col("text")).alias("s")).collect():
        assert r.s.asDict() == pytest.approx(brute.statistics(texts[r.i], STOPS)), texts[r.i]


def test_every_node_of_a_tree_is_a_rule(spark):
    rules = list(ruleset.paths(TREE))
    inf = float("inf")
    assert [r.bounds for r in rules] == [
        (("symbols_per_word", -inf, 0.5),),
        (("n_words", -inf, 10.25), ("symbols_per_word", -inf, 0.5)),
        (("n_words", 10.25, inf), ("symbols_per_word", -inf, 0.5)),
        (("symbols_per_word", 0.5, inf),),
        (("symbols_per_word", 0.5, 0.75),),
        (("symbols_per_word", 0.75, inf),),
    ]
    model = ruleset.RuleSet(((rules[2], 2.0), (rules[3], -1.0)), 0.5)
    given = ["one two", "w " * 11, "w# w#"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in given], "text string").select(model.score(F.col("text")).alias("s")).collect()]
    odds = [0.5, 2.5, -0.5]
    assert got == pytest.approx([1 / (1 + 2.718281828459045 ** -x) for x in odds])


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}


def test_held_out_documents(spark, labels):
    out = QUERIES["op11_rule_ensemble"](spark, LARGER)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert brute.auc([(s, y) for s, y, _ in held]) > 0.98
    good = [p for _, y, p in held if y == 1]
    bad = [p for _, y, p in held if y == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_held_out_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert set(ruleset.fit(docs, turned).weights) == set(ruleset.fit(docs, labels).weights)


def test_a_bounded_sample(spark, labels):
    docs, marked = (spark.read.parquet(f"{LARGER}/{n}.parquet") for n in ("documents", "labels"))
    rows = ruleset.training_rows(docs, marked, 5, 500, "doc_id", "text", "quality")
    assert 350 < rows.count() <= 600
    model = ruleset.fit(docs, marked, sample_rows=1000)
    assert 0 < len(model.weights) < 80


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "a text of words", "?"), (1, "a text of words", "?"), (None, "x", "?"), (2, None, "?"), (3, "", "?"), (4, "w " * 50_000, "?")],
        "doc_id long, text string, features string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0), (99, 1)], "doc_id long, quality int")
    out = ruleset.score_documents(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    none = ruleset.score_documents(docs, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    ones = ruleset.score_documents(docs, spark.createDataFrame([(i, 1) for i in range(1, 5)], "doc_id long, quality int"))
    assert all(r.score > 0.99 for r in ones.collect())
    assert ruleset.score_documents(docs.where("false"), labels).count() == 0
