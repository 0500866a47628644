"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the bytes wanted, over the bytes it has. Each
document draws a number from a hash of the seed and its doc_id, which inverts the Poisson
distribution with that rate as mean; the document is exploded to so many copies, and all copies are
sorted by a hash of their own. Draws are independent of partitioning and of other documents, so runs
repeat, and a source grows or shrinks as a whole: nobody ranks or counts its rows.

Rates are one small row per source, staged and joined by Spark's own choice of strategy; a hot source
stays spread, since no shuffle is by source except for the pre-aggregated byte counts. A large rate is
the sum of several smaller Poisson draws.

Defined results: a null text has no bytes but is drawn like others; a source without bytes or without
a weight has rate 0; a null source is a source of its own; rows that share a doc_id draw alike; a null
doc_id draws as the empty string; an empty table gives no rows; input columns are kept, those named
``mix_*`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import stage_table

#: the largest mean of one draw
PART_RATE = 32.0
#: hexadecimal digits of a hash that make a number in [0, 1): 52 bits are exact in a double
DIGITS = 13


def source_key(source: Column) -> Column:
    """Sources as text, told apart from a null one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the hash of the parts."""
    text = F.concat_ws(":", *[F.coalesce(F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, epochs: float, source: str, text: str) -> DataFrame:
    """(mix_source, mix_rate, mix_parts, mix_cdf): per source the rate and the distribution of one draw.

    Without ``weights`` a source weighs its bytes to the power ``alpha``.
    """
    size = docs.groupBy(source_key(F.col(source)).alias("mix_source")).agg(
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("double").alias("size")
    )
    if weights is None:
        weighed = size.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        known = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit("=" + k), F.lit(float(w)))])
        weighed = size.withColumn("weight", F.coalesce(F.try_element_at(known, F.col("mix_source")), F.lit(0.0)))
    # sums over one row per source
    total = weighed.where("size > 0").agg(F.sum("size").alias("all_bytes"), F.sum("weight").alias("all_weights"))
    all_bytes, all_weights = total.select("all_bytes").scalar(), total.select("all_weights").scalar()
    rate = F.when(
        (F.col("size") > 0) & (all_weights > 0),
        F.col("weight") / all_weights * all_bytes * F.lit(float(epochs)) / F.col("size"),
    ).otherwise(0.0)
    out = weighed.select("mix_source", F.coalesce(rate, F.lit(0.0)).alias("mix_rate"))
    out = out.withColumn("mix_parts", F.greatest(F.ceil(F.col("mix_rate") / PART_RATE), F.lit(1)).cast("int"))
    out = out.withColumn("m", F.col("mix_rate") / F.col("mix_parts"))
    # terms that are left out have less than the last bit of the number drawn
    last = (F.ceil(F.col("m") + 14 * F.sqrt("m")) + 30).cast("int")
    start = F.struct(F.exp(-F.col("m")).alias("term"), F.exp(-F.col("m")).alias("sum"), F.array(F.exp(-F.col("m"))).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * F.col("m") / k
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), F.concat(s["cdf"], F.array(s["sum"] + term)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])
    return out.select("mix_source", "mix_rate", "mix_parts", cdf.alias("mix_cdf"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Copies of the documents in a global random order, with mix_source, mix_rate, mix_copy and mix_key.

    ``epochs`` times the bytes of ``docs`` are wanted in all.
    """
    names = [c for c in docs.columns if c not in ("mix_source", "mix_rate", "mix_copy", "mix_key", "mix_parts", "mix_cdf")]
    table = stage_table(rates(docs, weights, alpha, epochs, source, text), "rates")
    keyed = docs.select(*names, source_key(F.col(source)).alias("mix_source")).join(table, "mix_source")
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("mix_parts")),
        F.lit(0),
        lambda n, part: n + F.size(F.filter("mix_cdf", lambda c: c <= uniform(str(seed), F.col(doc_id), part))),
    )
    copies = keyed.withColumn("mix_n", F.when(F.col("mix_rate") > 0, draw).otherwise(0)).where("mix_n > 0")
    copies = copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
    order = F.md5(
        F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("mix_copy"))
    )
    copies = copies.select(*names, "mix_source", "mix_rate", "mix_copy", order.alias("mix_key"))
    return copies.repartitionByRange("mix_key").sortWithinPartitions("mix_key")


#: DuckDB SQL of (doc_id, source, copy, rate, order_key) with the default parameters
ORACLE = """
WITH size AS (SELECT coalesce('=' || source, '') AS s, coalesce(sum(strlen(text)), 0)::DOUBLE AS size FROM documents GROUP BY 1),
total AS (SELECT sum(size) AS b, sum(pow(size, 0.5)) AS w FROM size WHERE size > 0),
rate AS (SELECT s, CASE WHEN size > 0 AND w > 0 THEN pow(size, 0.5) / w * b / size ELSE 0 END AS r FROM size, total),
part AS (SELECT s, r, greatest(ceil(r / 32.0), 1)::INT AS p, r / greatest(ceil(r / 32.0), 1) AS m FROM rate),
term AS (
  SELECT s, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cdf
  FROM part, unnest(generate_series(0, (ceil(m + 14 * sqrt(m)) + 30)::INT)) AS x(k) WHERE m > 0
),
drawn AS (
  SELECT d.doc_id, d.source, part.s, part.r, j,
    ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents d JOIN part ON part.s = coalesce('=' || d.source, ''), unnest(generate_series(1, part.p)) AS y(j)
),
counted AS (
  SELECT doc_id, source, r, sum((SELECT count(*) FROM term WHERE term.s = drawn.s AND cdf <= u)) AS n
  FROM drawn GROUP BY doc_id, source, s, r
)
SELECT doc_id, source, c::INT AS copy, round(r, 6) AS rate,
  md5('17:order:' || coalesce(doc_id::VARCHAR, '') || ':' || c::VARCHAR) AS order_key
FROM counted, unnest(generate_series(0, n::BIGINT - 1)) AS z(c)
"""
