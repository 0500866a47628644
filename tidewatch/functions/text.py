"""Expressions over lines and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, and the tokens read as null.
NUMBER = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
NULL_TOKENS = ("", " ", "N/A", "NaN", "NA", "--")


def is_number(token: Column) -> Column:
    return F.trim(token).rlike(NUMBER)


def float_token(token: Column) -> Column:
    """The number a token stands for, null when it is none."""
    return F.when(is_number(token), F.trim(token).try_cast("double"))


def tokens(line: Column, sep: str = ",") -> Column:
    return F.split(line, sep)


def has_number(line: Column, sep: str = ",") -> Column:
    return F.exists(tokens(line, sep), is_number)


def blank_pairs(text: Column) -> Column:
    """How often two separators stand next to each other, without overlap."""
    return F.regexp_count(text, F.lit(",,"))


def null_if_token(col: Column, null_tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.when(~col.isin(list(null_tokens)), col)
