"""What changed between a baseline table or text and the current one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidewatch.functions.text import blank_pairs, float_token, has_number, tokens
from tidewatch.operators.sequence import attach

LINES_PER_CHUNK = 4096


def _long(agg: DataFrame, cols: Sequence[str], fields: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One wide row ``{col}__{field}`` to one row per column."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"`{c}__{f}`").cast(t).alias(f) for f, t in fields.items()],
        )
        for c in cols
    ]
    return agg.select(*keep, F.explode(F.array(*rows)).alias("_r")).select(*keep, "_r.*")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, missing rate, mean and sample deviation (numbers only).

    All columns come from one aggregate over one scan.  ``bad_numbers`` is the share
    of rows that do not read as a number, for columns of any type.
    """
    numeric = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in df.columns:
        x = F.col(f"`{c}`")
        aggs.append(F.count_if(x.isNull()).alias(f"{c}__nulls"))
        if c in numeric:
            aggs.append(F.avg(x).alias(f"{c}__mean"))
            aggs.append(F.stddev_samp(x).alias(f"{c}__std"))
            aggs.append(F.count_if(x.isNull() | F.isnan(x.cast("double"))).alias(f"{c}__nan"))
        else:
            aggs += [F.lit(None).cast("double").alias(f"{c}__{s}") for s in ("mean", "std")]
            aggs.append(F.count_if(x.cast("string").try_cast("double").isNull()).alias(f"{c}__nan"))
    wide = df.agg(*aggs)
    out = _long(
        wide, df.columns, {"nulls": "bigint", "mean": "double", "std": "double", "nan": "bigint"}, ["n_rows"]
    )
    is_num = F.col("column").isin(sorted(numeric)) if numeric else F.lit(False)
    rate = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_rows").cast("double")), F.lit(0.0))
    fill = lambda c: F.when(is_num, F.coalesce(c, F.lit(0.0)))
    return out.select(
        "column",
        "n_rows",
        "nulls",
        rate("nulls").alias("missing_rate"),
        is_num.alias("is_numeric"),
        fill("mean").alias("mean"),
        fill("std").alias("std"),
        rate("nan").alias("bad_numbers"),
    )


def contract_diff(current: DataFrame, base: DataFrame) -> DataFrame:
    """Violations of ``current`` against the profile of ``base``: ``rule, column, value``.

    Both inputs are profiles, so this joins as many rows as there are columns.
    """
    b = base.select("column", *[F.col(c).alias(f"b_{c}") for c in base.columns if c != "column"])
    d = b.join(current, "column", "left")
    gone = F.col("n_rows").isNull()
    more_null = F.col("missing_rate") - F.col("b_missing_rate")
    more_bad = F.col("bad_numbers") - F.col("b_missing_rate")
    rule = lambda name, bad, v: F.when(bad, F.struct(F.lit(name).alias("rule"), v.cast("double").alias("value")))
    per_column = d.select(
        "column",
        F.explode(
            F.array_compact(
                F.array(
                    rule("missing_column", gone, F.lit(1)),
                    rule("missing_rate", more_null > 0.10, more_null),
                    rule("numeric_corruption", F.col("b_is_numeric") & (more_bad > 0.05), more_bad),
                )
            )
        ).alias("_r"),
    ).select("column", "_r.*")
    rows = d.agg(F.max("b_n_rows").alias("b"), F.coalesce(F.max("n_rows"), F.lit(0)).alias("c"))
    short = rows.where(F.col("c") < F.col("b") * 0.5).select(
        F.lit(None).cast("string").alias("column"),
        F.lit("row_count").alias("rule"),
        F.col("c").cast("double").alias("value"),
    )
    return per_column.unionByName(short)


def column_diff(
    base: DataFrame, current: DataFrame, on: Sequence[str], cols: Sequence[str] | None = None
) -> DataFrame:
    """Per column: ``l1_diff, l1_base, diff_score, max_rel_change, null_delta``.

    One join of aligned rows and one aggregate for all columns.  Values that are not
    numbers count as 0.
    """
    cols = [c for c in (cols or base.columns) if c in current.columns and c not in on]
    num = lambda c: F.coalesce(
        F.nanvl(c.cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0)
    )
    b = base.select(*on, *[F.col(c).alias(f"b_{c}") for c in cols])
    d = b.join(current.select(*on, *cols), list(on))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        x, y = num(F.col(f"b_{c}")), num(F.col(c))
        delta = F.abs(y - x)
        aggs += [
            F.sum(delta).alias(f"{c}__l1_diff"),
            F.sum(F.abs(x)).alias(f"{c}__l1_base"),
            F.max(delta / F.greatest(F.abs(x), F.lit(1e-9))).alias(f"{c}__max_rel_change"),
            (F.count_if(F.col(c).isNull()) - F.count_if(F.col(f"b_{c}").isNull())).alias(f"{c}__null_delta"),
        ]
    out = _long(
        d.agg(*aggs),
        cols,
        {"l1_diff": "double", "l1_base": "double", "max_rel_change": "double", "null_delta": "bigint"},
        ["n_rows"],
    )
    return out.select(
        "column",
        "n_rows",
        "l1_diff",
        "l1_base",
        F.when(F.col("l1_base") > 0, F.col("l1_diff") / F.col("l1_base")).alias("diff_score"),
        "max_rel_change",
        "null_delta",
        F.try_divide(F.col("null_delta").cast("double"), F.col("n_rows").cast("double")).alias("null_rate_delta"),
    )


def column_reasons(
    diff: DataFrame, threshold: float, spike: float = 0.08, near: float = 0.01, null_rate: float = 0.001
) -> DataFrame:
    """Spikes, sums that land near the threshold, and new nulls, per column."""
    rule = lambda name, metric, bad, v: F.when(
        bad,
        F.struct(F.lit(name).alias("rule_id"), F.lit(metric).alias("metric"), v.alias("value")),
    )
    score = F.col("diff_score")
    rules = F.array(
        rule("local_spike_detected", "max_rel_change", F.col("max_rel_change") >= spike, F.col("max_rel_change")),
        rule(
            "near_threshold_perturbation",
            "l1_diff_score",
            (score > 0) & (F.abs(score - threshold) <= near),
            score,
        ),
        rule(
            "missing_injection_detected",
            "null_rate_delta",
            F.col("null_rate_delta") > null_rate,
            F.col("null_rate_delta"),
        ),
    )
    long = diff.select("column", F.explode(F.array_compact(rules)).alias("_r"))
    return long.select("_r.rule_id", "_r.metric", "_r.value", "column")


def token_diff(
    base: DataFrame, current: DataFrame, on: Sequence[str] = ("line_no",), by: Sequence[str] = (), sep: str = ","
) -> DataFrame:
    """``diff_score, changed_tokens, max_rel_change`` over tokens in the same place.

    Lines are joined, tokens are paired inside the joined row: one row per line is
    shuffled, not one per token.
    """
    b = base.select(*on, F.col("line").alias("_b"))
    d = b.join(current.select(*on, F.col("line").alias("_c")), list(on))
    numbers = lambda c: F.transform(tokens(F.col(c), sep), float_token)
    pairs = F.explode(F.arrays_zip(numbers("_b").alias("x"), numbers("_c").alias("y")))
    d = d.select(*by, pairs.alias("_p")).select(*by, "_p.x", "_p.y")
    d = d.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    delta = F.abs(F.col("y") - F.col("x"))
    rel = F.when(F.abs("x") < 1e-9, delta).otherwise(delta / F.abs("x"))
    total = F.sum(F.abs("x"))
    return d.groupBy(*by).agg(
        F.coalesce(F.when(total > 0, F.sum(delta) / total), F.lit(0.0)).alias("diff_score"),
        F.count_if(delta != 0).alias("changed_tokens"),
        F.coalesce(F.max(rel), F.lit(0.0)).alias("max_rel_change"),
    )


def token_reasons(diff: DataFrame, threshold: float) -> DataFrame:
    """A few tokens far off, or many tokens that together land near the threshold."""
    few = F.col("changed_tokens").between(1, 6) & (F.col("max_rel_change") >= 0.08)
    many = (F.col("changed_tokens") >= 50) & (F.abs(F.col("diff_score") - threshold) <= 0.01)
    rules = F.array_compact(
        F.array(
            F.when(
                few,
                F.struct(
                    F.lit("local_spike_detected").alias("rule_id"),
                    F.lit("max_rel_change").alias("metric"),
                    F.col("max_rel_change").alias("value"),
                ),
            ),
            F.when(
                many,
                F.struct(
                    F.lit("near_threshold_perturbation").alias("rule_id"),
                    F.lit("diff_score").alias("metric"),
                    F.col("diff_score").alias("value"),
                ),
            ),
        )
    )
    return diff.select(F.explode(rules).alias("_r")).select("_r.*")


def blank_count(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return lines.groupBy(*by).agg(blank_fields().alias("blank_fields"))


def blank_fields() -> Column:
    return F.coalesce(F.sum(blank_pairs(F.col("line"))), F.lit(0))


def header_count(sep: str = ",") -> Column:
    first = F.min(F.when(has_number(F.col("line"), sep), F.col("line_no")))
    return F.coalesce(first, F.max("line_no") + 1)


def header_lines(lines: DataFrame, by: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """``header_count, n_lines``: the header ends at the first line with a number."""
    return lines.groupBy(*by).agg(
        header_count(sep).alias("header_count"), F.count(F.lit(1)).alias("n_lines")
    )


def split_header(lines: DataFrame, by: Sequence[str] = (), sep: str = ",") -> tuple[DataFrame, DataFrame]:
    d = attach(lines, header_lines(lines, by, sep).select(*by, "header_count"), list(by))
    body = d.where("line_no >= header_count")
    return d.where("line_no < header_count"), body.withColumn("row_no", F.col("line_no") - F.col("header_count"))


def header_digest(
    lines: DataFrame, by: Sequence[str] = (), sep: str = ",", header: DataFrame | None = None
) -> DataFrame:
    """Digest of the header without blank lines around it, the same at every size.

    Lines lose white space at their end, the first one also in front.  From the first
    line with content on, every 4096 lines are joined and digested (SHA-256), and the
    digest of the joined chunk digests is the header's.  An empty header has the digest
    of the empty text.
    """
    header = split_header(lines, by, sep)[0] if header is None else header
    keys = list(by)
    text = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["t"]), "\n")
    written = F.when(F.col("line").rlike(r"\S"), F.col("line_no"))
    ends = header.groupBy(*keys).agg(F.min(written).alias("_a"), F.max(written).alias("_b"))
    d = attach(header, ends, keys).where("line_no between _a and _b")
    line = F.regexp_replace("line", r"\s+$", "")
    line = F.when(F.col("line_no") == F.col("_a"), F.regexp_replace(line, r"^\s+", "")).otherwise(line)
    chunk = F.floor((F.col("line_no") - F.col("_a")) / LINES_PER_CHUNK).alias("_chunk")
    chunks = d.groupBy(*keys, chunk).agg(text(F.struct("line_no", line.alias("t"))).alias("_text"))
    whole = chunks.groupBy(*keys).agg(text(F.struct("_chunk", F.sha2("_text", 256).alias("t"))).alias("_all"))
    found = whole.select(*keys, F.sha2("_all", 256).alias("header_sha"))
    if not keys:
        # no header line at all is an empty header
        return found.agg(F.coalesce(F.max("header_sha"), F.sha2(F.lit(""), 256)).alias("header_sha"))
    every = lines.select(*keys).distinct()
    return every.join(found, keys, "left").select(
        *keys, F.coalesce("header_sha", F.sha2(F.lit(""), 256)).alias("header_sha")
    )


def truncation(base_rows: Column, current_rows: Column) -> Column:
    """True when rows are gone but not all of them."""
    return (current_rows > 0) & (current_rows < base_rows)
