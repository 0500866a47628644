"""Quality classifier: a sparse ensemble of conjunctive rules.

1. Texts are measured by ``statistics``: counts and ratios of words, characters and lines, one struct of
   built-in expressions. Labels, language, source and ids are not among them.
2. A random forest of shallow trees is grown on a bounded sample of labelled rows. Every node of a tree is
   a path of comparisons from its root, and every path becomes a *rule*: bounds on some statistics.
3. A logistic regression with an L1 penalty over the rules as 0/1 columns gives most of them no weight; the
   others, with their weights, are the model.
4. The model is compiled into one column expression. Scoring is one projection of the table: no shuffle, no
   user function.

The sample: ``sample_rows`` bounds the labelled documents (by a hash of their ids, before the table is
read) and, if ids repeat, the rows that go into training. The table is read twice, once for them and once
for all scores. What is broadcast is the sampled ids and labels, at most some 16 bytes times ``sample_rows``.

Defined results: a null text is empty and scored as such, with all statistics zero; texts are taken whole;
a document with several labels counts with the largest; null labels and ids do not train; rows that repeat
are scored alike; without two classes to learn from the score is the share of label 1, or a half where
nothing is labelled; a null doc_id is told as an empty string when folds are dealt; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.quality import STOP_WORDS, WORD_PATTERN, let, split_words, without
from tidewatch.session import stage_table

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
SYMBOLS = "#*$%&<>"
MARKS = ".,;:?"
#: what is not counted by kind
OTHERS = r"[^#*$%&<>.,;:?!|A-Z0-9]++"

#: in the order of the feature vector
STATISTICS = (
    "n_words",
    "mean_word_chars",
    "symbols_per_word",
    "calls_per_word",
    "bars_per_word",
    "capital_share",
    "digit_share",
    "mark_share",
    "repeated_neighbour_share",
    "distinct_word_share",
    "stop_word_share",
    "words_per_line",
    "repeated_line_share",
)


def statistics(text: Column) -> Column:
    """All statistics of a text in one struct of doubles; a ratio over nothing is zero."""
    stops = F.array(*[F.lit(w) for w in sorted(set().union(*STOP_WORDS.values()))])

    def of(t: Column, words: Column, lines: Column, some: Column) -> Column:
        n_words, n_chars, n_lines = F.size(words), F.length(t), F.size(lines)
        # one pass leaves the few characters that are counted
        count = lambda chars: F.length(some) - without(some, chars)
        word_chars = F.length(F.array_join(words, ""))
        again = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
        # distinct words stand for all of them: one look-up each
        distinct = F.array_distinct(words)
        stop = F.size(F.array_intersect(F.transform(distinct, F.lower), stops))
        values = {
            "n_words": (n_words, F.lit(1)),
            "mean_word_chars": (word_chars, n_words),
            "symbols_per_word": (count(SYMBOLS), n_words),
            "calls_per_word": (count("!"), n_words),
            "bars_per_word": (count("|"), n_words),
            "capital_share": (count(CAPITALS), n_chars),
            "digit_share": (count(DIGITS), n_chars),
            "mark_share": (count(MARKS), n_chars),
            "repeated_neighbour_share": (again, n_words),
            "distinct_word_share": (F.size(distinct), n_words),
            "stop_word_share": (stop, F.size(distinct)),
            "words_per_line": (n_words, n_lines),
            "repeated_line_share": (n_lines - F.size(F.array_distinct(lines)), n_lines),
        }
        ratio = lambda a, b: a.cast("double") / F.greatest(b, F.lit(1))
        return F.struct(*[ratio(*values[name]).alias(name) for name in STATISTICS])

    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_PATTERN))
    some = lambda t: F.regexp_replace(t, OTHERS, "")
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(split_words(t), lambda w: let(lines(t), lambda x: let(some(t), lambda s: of(t, w, x, s)))),
    )


@dataclass(frozen=True)
class Rule:
    """Bounds by statistic: low < value <= high for all of them; an infinite bound does not bind."""

    bounds: tuple[tuple[str, float, float], ...]

    def holds(self, stats: Column) -> Column:
        tests = []
        for name, low, high in self.bounds:
            tests += [stats[name] > low] * (low > -math.inf)
            tests += [stats[name] <= high] * (high < math.inf)
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out

    def __str__(self) -> str:
        return " and ".join(f"{low:g} < {name} <= {high:g}" for name, low, high in self.bounds)


@dataclass(frozen=True)
class RuleSet:
    """Rules with their weights, and the score of a text that none of them fits (as log odds)."""

    weights: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, text: Column) -> Column:
        def of(stats: Column) -> Column:
            odds = F.lit(self.intercept)
            for rule, weight in self.weights:
                odds = odds + F.when(rule.holds(stats), weight).otherwise(0.0)
            return 1.0 / (1.0 + F.exp(-odds))

        # without rules no text needs to be read
        return let(statistics(text), of) if self.weights else F.lit(1.0 / (1.0 + math.exp(-self.intercept)))


def paths(description: str) -> Iterable[Rule]:
    """The rules of a tree from its printed form: one for each node below the root."""
    held: list[tuple[int, bool, float]] = []
    base = None
    for line in description.splitlines():
        found = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        # one space more for each level
        base = len(found[1]) if base is None else base
        held = held[: len(found[1]) - base]
        held.append((int(found[2]), found[3] == ">", float(found[4])))
        bounds: dict[str, tuple[float, float]] = {}
        for feature, above, value in held:
            name = STATISTICS[feature]
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (max(low, value), high) if above else (low, min(high, value))
        yield Rule(tuple((name, *bounds[name]) for name in STATISTICS if name in bounds))


def told_apart(doc_id: Column, folds: int) -> Column:
    """True for documents held out: crc32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, sample_rows: int, doc_id: str, text: str, label: str) -> DataFrame:
    """Staged (label, features) of at most ``sample_rows`` labelled rows that are not held out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~told_apart(F.col("id"), folds)).groupBy("id").agg(F.max("label").alias("label"))
    known = stage_table(known, "labels")
    share = min(1.0, sample_rows / max(1, known.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    stats = let(statistics(F.col("text")), lambda s: F.array(*[s[name] for name in STATISTICS]))
    rows = stage_table(source.join(F.broadcast(known), "id").select("label", stats.alias("features")), "training")
    n = rows.count()
    return rows.sample(sample_rows / n, seed=1) if n > sample_rows else rows


def fit(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    sample_rows: int = 200_000,
    trees: int = 16,
    depth: int = 3,
    penalty: float = 0.0005,
    seed: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> RuleSet:
    """A rule set from the labelled documents that are not held out."""
    rows = training_rows(docs, labels, folds, sample_rows, doc_id, text, label)
    size, good = rows.agg(F.count("*"), F.sum("label")).first()
    if not size or good in (0, size):
        share = 0.5 if not size else good / size
        return RuleSet((), math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    spark = docs.sparkSession
    given = rows.repartition(spark.sparkContext.defaultParallelism).select(
        F.col("label").cast("double"), "features", array_to_vector("features").alias("vector")
    )
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="vector", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed,
        featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=max(2, size // 2000),
    ).fit(given)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in paths(tree.toDebugString)))
    if not rules:
        return RuleSet((), math.log(good / (size - good)))
    stats = F.struct(*[F.get("features", F.lit(i)).alias(name) for i, name in enumerate(STATISTICS)])
    fits = let(stats, lambda s: F.array(*[F.when(r.holds(s), 1.0).otherwise(0.0) for r in rules]))
    marked = given.select("label", array_to_vector(fits).alias("fits"))
    lasso = LogisticRegression(labelCol="label", featuresCol="fits", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=30, tol=1e-5)
    model = lasso.fit(marked)
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w]
    return RuleSet(tuple(weights), float(model.intercept))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    threshold: float = 0.3,
    doc_id: str = "doc_id",
    text: str = "text",
    **options,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by rules fitted to those not held out."""
    rules = fit(docs, labels, folds, doc_id=doc_id, text=text, **options)
    scored = docs.select(F.col(doc_id).alias("doc_id"), told_apart(F.col(doc_id), folds).alias("held_out"), rules.score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
