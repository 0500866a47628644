"""Text files as numbered lines, and CSV dialects on top of them."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import ContractError
from tidewatch.functions.text import NULL_TOKENS, null_if_token
from tidewatch.operators.features import dedupe_first
from tidewatch.session import allow_charsets, prepare

# Names a column may have in a file, and the name it gets here.
COVARIATE_ALIASES = {
    "年月日時": "ts",
    "気温(℃)": "temp",
    "湿度(％)": "humid",
    "相対湿度(％)": "humid",
    "相対湿度(%)": "humid",
    "日照時間(h)": "sun",
    "日照時間(時間)": "sun",
    "日照時間": "sun",
    "電力需要": "y",
    "需要": "y",
    "需要(万kW)": "y",
    "当日実績(万kW)": "y",
    "DATETIME": "ts",
    "TEMP": "temp",
    "HUMID": "humid",
    "SUN": "sun",
    "DEMAND": "y",
}
TARGET_NAMES = ("DEMAND", "当日実績(万kW)", "実績(万kW)", "需要(万kW)", "電力需要", "需要")
TIME_COLUMNS = (("DATETIME",), ("DATE", "TIME"), ("日付", "時刻"))
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-M-d H:mm[:ss]",
    "yyyy/M/d H:mm[:ss]",
    "yyyy-MM-dd'T'HH:mm[:ss]",
    "yyyy-M-d",
    "yyyy/M/d",
)


def parse_ts(col: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """Bad values become null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(col), F.lit(f)) for f in formats])


def read_lines(spark: SparkSession, path: str | list[str], charset: str = "utf-8") -> DataFrame:
    """``path, line_no, line`` of text files of any size, numbered from 0 per file.

    Files are read in splits; lines are ranked inside their split and offset by the
    counts of the splits before it, so no file has to fit in one task.
    """
    prepare(spark)
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        raw.groupBy("path", "_split")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select("path", "_split", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    )
    rank = Window.partitionBy("path", "_split").orderBy("_id")
    line = F.col("line")
    if charset.lower() not in ("utf-8", "utf8", "utf-8-sig"):
        allow_charsets(spark)
        line = F.decode(line.cast("binary"), charset)
    numbered = raw.join(offsets, ["path", "_split"]).select(
        "path", (F.row_number().over(rank) - 1 + F.col("_off")).alias("line_no"), line.alias("line")
    )
    bom = F.when(F.col("line_no") == 0, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    return numbered.withColumn("line", bom)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    return prepare(spark).read.schema(schema).option("header", True).csv(path)


def alias_names(names: Sequence[str], aliases: dict[str, str]) -> dict[int, str]:
    """Position -> new name.  A name matches by prefix; each new name is used once."""
    out: dict[int, str] = {}
    for i, name in enumerate(names):
        for prefix, target in aliases.items():
            if name.startswith(prefix) and target not in out.values():
                out[i] = target
                break
    return out


def first_present(columns: Sequence[str], wanted: Sequence[str], contains: bool = False) -> str | None:
    for w in wanted:
        for c in columns:
            if c == w or (contains and w in c):
                return c
    return None


def _fields(lines: DataFrame, width: int) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(width))
    return lines.withColumn("_f", F.from_csv("line", schema, {"mode": "PERMISSIVE"}))


def read_aliased_csv(
    spark: SparkSession,
    path: str | list[str],
    aliases: dict[str, str] = COVARIATE_ALIASES,
    marker: str = "年月日時",
    charset: str = "cp932",
    required: Sequence[str] = ("ts", "temp"),
    header_within: int | None = None,
) -> DataFrame:
    """CSV with lines of preamble: the header is the first line with a marker.

    ``header_within`` bounds the preamble, in lines; by default nothing does.
    """
    lines = read_lines(spark, path, charset)
    at = lines.where(F.col("line").contains(marker))
    if header_within is not None:
        at = at.where(F.col("line_no") < header_within)
    heads = at.groupBy("path").agg(
        F.min("line_no").alias("_h"), F.min_by("line", "line_no").alias("_head")
    )
    found = heads.select("_head").distinct().limit(2).collect()
    if len(found) != 1:
        raise ContractError(f"need one common header line with {marker!r}, found {len(found)}")
    names = [n.strip() for n in next(csv.reader([found[0]["_head"]]))]
    picked = alias_names(names, aliases)
    missing = [r for r in required if r not in picked.values()]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    body = lines.join(heads.select("path", "_h"), "path").where(
        (F.col("line_no") > F.col("_h")) & (F.trim("line") != "")
    )
    cols = []
    for i, target in picked.items():
        f = F.col("_f")[f"c{i}"]
        cols.append((parse_ts(f) if target == "ts" else F.trim(f).try_cast("double")).alias(target))
    return _fields(body, len(names)).select(*cols, "line_no")


def read_target_csv(
    spark: SparkSession,
    path: str | list[str],
    charset: str = "utf-8",
    value_names: Sequence[str] = TARGET_NAMES,
    time_columns: Sequence[Sequence[str]] = TIME_COLUMNS,
) -> DataFrame:
    """``ts, y``: complete rows on whole hours, first of each hour, no negatives."""
    from tidewatch.operators.contracts import off_grid

    lines = read_lines(spark, path, charset)
    heads = lines.where("line_no = 0").select("line").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ContractError("files have different headers")
    names = [n.replace("﻿", "").strip() for n in next(csv.reader([heads[0]["line"]]))]
    when = next((t for t in time_columns if all(c in names for c in t)), None)
    value = first_present(names, value_names)
    if when is None or value is None:
        raise ContractError(f"no time or value column among {names}")
    field = lambda c: F.trim(F.col("_f")[f"c{names.index(c)}"])
    d = _fields(lines.where((F.col("line_no") > 0) & (F.trim("line") != "")), len(names)).select(
        parse_ts(F.concat_ws(" ", *[field(c) for c in when])).alias("ts"),
        field(value).try_cast("double").alias("y"),
        F.struct("path", "line_no").alias("ingest_no"),
    )
    d = d.na.drop(subset=["ts", "y"])
    bad = d.agg(F.count_if(off_grid("ts")).alias("g"), F.count_if(F.col("y") < 0).alias("n")).first()
    if bad["g"] or bad["n"]:
        raise ContractError(f"{bad['g']} rows off the hourly grid, {bad['n']} negative values")
    return dedupe_first(d).select("ts", "y")


def field_count(line: Column) -> Column:
    """Fields of a CSV line; separators inside quotes are text."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def loose_lines(spark: SparkSession, path: str | list[str], charset: str = "utf-8") -> tuple[list[str], DataFrame, DataFrame]:
    """Column names, the lines that fit them, and the lines with too many fields.

    Which lines are bad is decided on their text, whatever columns are read later.
    """
    lines = read_lines(spark, path, charset)
    heads = lines.where("line_no = 0").select("line").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ContractError("files have different headers")
    names = [c.replace("\ufeff", "").strip() for c in next(csv.reader([heads[0]["line"]]))]
    body = lines.where((F.col("line_no") > 0) & (F.trim("line") != ""))
    body = body.withColumn("n_fields", field_count(F.col("line")))
    return names, body.where(F.col("n_fields") <= len(names)), body.where(F.col("n_fields") > len(names))


def read_loose_csv(
    spark: SparkSession,
    path: str | list[str],
    null_tokens: Sequence[str] = NULL_TOKENS,
    charset: str = "utf-8",
) -> DataFrame:
    """CSV of unknown types: own null tokens, lines with too many fields skipped.

    ``loose_lines`` gives the skipped ones.  A column becomes a number when all of its
    non-null values read as one.
    """
    names, good, _ = loose_lines(spark, path, charset)
    table = _fields(good, len(names)).select(
        *[null_if_token(F.col("_f")[f"c{i}"], tuple(null_tokens)).alias(c) for i, c in enumerate(names)]
    )
    return promote_numbers(table)


def promote_numbers(df: DataFrame) -> DataFrame:
    """One scan decides for all columns which of them are numeric."""
    num = lambda c: F.trim(F.col(f"`{c}`")).try_cast("double")
    verdict = df.agg(
        *[
            (F.count(F.col(f"`{c}`")) == F.count(num(c))).alias(f"n{i}")
            for i, c in enumerate(df.columns)
        ]
    ).first()
    return df.select(
        *[num(c).alias(c) if verdict[f"n{i}"] else F.col(f"`{c}`") for i, c in enumerate(df.columns)]
    )


def lines_table(lines: DataFrame, columns: Sequence[str], header_count: int, numeric: Sequence[str] | None = None) -> DataFrame:
    """Body lines as a table ``row_no, columns...`` with null tokens applied."""
    body = lines.where(F.col("line_no") >= header_count)
    d = _fields(body, len(columns)).select(
        (F.col("line_no") - header_count).alias("row_no"),
        *[null_if_token(F.col("_f")[f"c{i}"]).alias(c) for i, c in enumerate(columns)],
    )
    if numeric is None:
        return d
    return d.withColumns({c: F.trim(c).try_cast("double") for c in numeric if c in d.columns})


def table_lines(df: DataFrame, columns: dict[str, Column], order: str, span: int | None = None) -> DataFrame:
    """A table as CSV lines with one header line: ``line_no, line``."""
    from tidewatch.operators.sequence import index_rows

    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns.values()]
    body = index_rows(df.select(order, F.concat_ws(",", *parts).alias("line")), [], order, span)
    head = df.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("line_no"), F.lit(",".join(columns)).alias("line")
    )
    return head.unionByName(body.select((F.col("row_no") + 1).cast("bigint").alias("line_no"), "line"))
