"""Faults to test an audit with.  Lines are ``(line_no, line)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import float_token, has_number, is_number, tokens
from tidewatch.operators.diff import header_lines
from tidewatch.operators.sequence import attach


def _edit_first_number(lines: DataFrame, edit) -> DataFrame:
    """Change the first numeric token of the first line that has one."""
    first = lines.agg(F.min(F.when(has_number(F.col("line")), F.col("line_no"))).alias("_at"))
    d = attach(lines, first, [])
    toks = tokens(F.col("line"))
    at = F.array_position(F.transform(toks, is_number), F.lit(True)) - 1
    new = F.array_join(F.transform(toks, lambda t, i: F.when(i == at, edit(t)).otherwise(t)), ",")
    changed = F.when(F.col("line_no") == F.col("_at"), new).otherwise(F.col("line"))
    return d.withColumn("line", changed).drop("_at")


def spike(lines: DataFrame, factor: float = 1.15) -> DataFrame:
    return _edit_first_number(lines, lambda t: F.format_string("%.2f", float_token(t) * factor))


def blank(lines: DataFrame) -> DataFrame:
    return _edit_first_number(lines, lambda t: F.lit(""))


def rotate(lines: DataFrame, by: int = 24) -> DataFrame:
    """Move the first rows of the body to its end."""
    counts = header_lines(lines)
    d = attach(lines, counts, [])
    n = F.col("n_lines") - F.col("header_count")
    step = F.when(n > by, by).otherwise(1)
    moved = F.col("header_count") + F.pmod(F.col("line_no") - F.col("header_count") - step, n)
    no = F.when(F.col("line_no") < F.col("header_count"), F.col("line_no")).otherwise(moved)
    return d.withColumn("line_no", no).drop("header_count", "n_lines")


def _rescaled(token: Column, factor: float) -> Column:
    v = float_token(token) * factor
    places = F.greatest(F.lit(3), F.least(F.lit(6), F.length(F.substring_index(token, ".", -1))))
    places = F.when(F.instr(token, ".") > 0, places).otherwise(3)
    text = F.format_string("%.3f", v)
    for p in (4, 5, 6):
        text = F.when(places == p, F.format_string(f"%.{p}f", v)).otherwise(text)
    return F.when(is_number(token), text).otherwise(token)


def rescale(lines: DataFrame, factor: float = 1.05) -> DataFrame:
    """Scale every number of the body a little."""
    d = attach(lines, header_lines(lines).select("header_count"), [])
    new = F.array_join(F.transform(tokens(F.col("line")), lambda t: _rescaled(t, factor)), ",")
    line = F.when(F.col("line_no") < F.col("header_count"), F.col("line")).otherwise(new)
    return d.withColumn("line", line).drop("header_count")


def truncate(lines: DataFrame, rows: int = 5) -> DataFrame:
    d = attach(lines, lines.agg(F.max("line_no").alias("_last")), [])
    keep = (F.col("line_no") <= F.col("_last") - rows) | (F.col("_last") < rows)
    return d.where(keep).drop("_last")


def break_header(lines: DataFrame) -> DataFrame:
    """Rename the first non-empty token of the last header line."""
    d = attach(lines, header_lines(lines).select("header_count"), [])
    at_line = F.greatest(F.col("header_count"), F.lit(1)) - 1
    toks = tokens(F.col("line"))
    filled = F.transform(toks, lambda t: F.trim(t) != "")
    at = F.array_position(filled, F.lit(True)) - 1
    new = F.array_join(
        F.transform(toks, lambda t, i: F.when(i == at, F.concat(F.trim(t), F.lit("_broken"))).otherwise(t)), ","
    )
    return d.withColumn("line", F.when(F.col("line_no") == at_line, new).otherwise(F.col("line"))).drop(
        "header_count"
    )


# ---- the same faults on typed tables, aligned by a key -----------------------


def table_spike(df: DataFrame, order: str, col: str, factor: float = 1.15) -> DataFrame:
    d = attach(df, df.agg(F.min(order).alias("_at")), [])
    return d.withColumn(col, F.when(F.col(order) == F.col("_at"), F.col(col) * factor).otherwise(F.col(col))).drop("_at")


def table_blank(df: DataFrame, order: str, col: str) -> DataFrame:
    d = attach(df, df.agg(F.min(order).alias("_at")), [])
    return d.withColumn(col, F.when(F.col(order) != F.col("_at"), F.col(col))).drop("_at")


def table_rescale(df: DataFrame, cols: list[str], factor: float = 1.05) -> DataFrame:
    return df.withColumns({c: F.col(c) * factor for c in cols})


def tamper(cert: DataFrame, column: str, field: str, value: str) -> DataFrame:
    """Overwrite one field of a certificate."""
    return cert.withColumn(column, F.col(column).withField(field, F.lit(value)))
