"""Quality rules: a table of thresholds compiled into one Spark projection.

``RULES`` names a measure and its bounds. ``measures`` holds every measure as a column expression
over the words and lines of a text, ``verdict`` turns the table into one boolean expression. All of
it is built-in Spark functions inside one narrow projection: no user function, no shuffle.

Repeated 8-word windows are found per text by sorted 64-bit window hashes with their positions; the
sort is skipped for texts whose window hashes are all different.

Defined results: a null text has no words and is rejected like an empty one; texts are taken whole;
repeated rows are judged alike; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words end at these: space, and tab to carriage return
GAPS = " \t\n\x0b\x0c\r"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: fixed values: frequent function words of the four languages of the corpus
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "that", "is", "was", "for", "on", "with", "as", "by", "from", "this", "are", "be", "not", "it", "at"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "dans", "pour", "par", "sur", "pas", "au", "est"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "nicht", "ein", "eine", "dem"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al"),
}


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``low <= measure <= high``; a bound of None does not bind."""

    measure: str
    low: float | None = None
    high: float | None = None


#: what is rejected; the first two are the base, the others catch junk and leave prose alone
BASE = (Rule("n_words", low=20), Rule("repeat_word_percent", high=30))
RULES = BASE + (
    Rule("mean_word_chars", low=2.0, high=20.0),
    Rule("symbol_word_ratio", high=0.35),
    Rule("stop_word_ratio", low=0.05),
    Rule("dup_line_ratio", high=0.5),
)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, inside one expression.

    Steps in columns of their own would be copied into each other by the optimizer wherever a filter
    is pushed below them.
    """
    return F.get(F.transform(F.array(value), use), 0)


def split_words(text: Column) -> Column:
    """Words of a text; none for white space alone."""
    return F.filter(F.split(text, GAP_PATTERN), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    """How many characters are left when those of ``chars`` are taken out."""
    return F.length(F.translate(text, chars, "")).cast("long")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda t, x: t + x)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` that come twice or more, the first included.

    Equal windows are neighbours once (hash, place) pairs are sorted. Their places, in order, cover
    min(width, distance to the next place) words each, and the last one ``width``.
    """

    def windows(hashes: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(hashes) - (width - 1))
        found = F.transform(places, lambda i: F.xxhash64(F.slice(hashes, i, width)))
        return F.when(F.size(hashes) >= width, found).otherwise(F.array().cast("array<bigint>"))

    def equal_places(pairs: Column) -> Column:
        def has_equal(x: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(pairs, k - 1)["h"] == x["h"])
            return before | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, has_equal), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        return total(
            F.transform(
                places,
                lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))).cast("long"),
            )
        )

    def count(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = let(pairs, lambda p: let(equal_places(p), covered))
        return F.when(F.size(found) > F.size(F.array_distinct(found)), some).otherwise(F.lit(0).cast("long"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count))


def measures(text: Column) -> Column:
    """All measures of a text in one struct."""
    stops = F.array(*[F.lit(w) for w in sorted(set().union(*STOP_WORDS.values()))])

    def of(t: Column, words: Column, lines: Column) -> Column:
        stop = F.size(F.filter(words, lambda w: F.array_contains(stops, F.lower(w))))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            without(t, GAPS).alias("word_chars"),
            (F.length(t).cast("long") - without(t, SYMBOLS)).alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            stop.cast("long").alias("n_stop_words"),
        )

    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_PATTERN))
    return let(F.coalesce(text, F.lit("")), lambda t: let(split_words(t), lambda w: let(lines(t), lambda x: of(t, w, x))))


#: measure of a rule -> numerator, denominator and factor; a ratio over nothing is zero
MEASURES = {
    "n_words": ("n_words", None, 1),
    "repeat_word_percent": ("n_repeat_words", "n_words", 100),
    "mean_word_chars": ("word_chars", "n_words", 1),
    "symbol_word_ratio": ("n_symbols", "n_words", 1),
    "stop_word_ratio": ("n_stop_words", "n_words", 1),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1),
}


def broken(rule: Rule, m: Column) -> Column:
    """True where a text breaks the rule; compared without a division, so nothing is rounded."""
    top, below, factor = MEASURES[rule.measure]
    value = m[top] * factor
    unit = F.lit(1) if below is None else F.greatest(m[below], F.lit(1))
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < unit * rule.low)
    if rule.high is not None:
        out = out | (value > unit * rule.high)
    return out


def any_broken(rules: tuple[Rule, ...], m: Column) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | broken(rule, m)
    return out


def verdict(text: Column, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> Column:
    """One struct of the measures, base_failed, kept, and the measures of the broken rules."""

    def of(m: Column) -> Column:
        names = F.array_compact(F.array(*[F.when(broken(r, m), F.lit(r.measure)) for r in rules]))
        fields = [m[c].alias(c) for c in FIELDS]
        return F.struct(
            *fields,
            any_broken(base, m).alias("base_failed"),
            (~any_broken(base, m) & ~any_broken(rules, m)).alias("kept"),
            names.alias("broken"),
        )

    return let(measures(text), of)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """The input with the verdict in a column ``quality``; an input column of that name is replaced."""
    return docs.withColumn("quality", verdict(F.col(text), rules, base))


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text") -> DataFrame:
    """The documents that break no rule, with their columns."""
    return docs.where(verdict(F.col(text), rules, base)["kept"])
