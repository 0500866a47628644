"""Fill-in-middle texts by one regular expression with counted quantifiers.

``regexp_count`` gives the number n of units in a text (a word with the white space before it, or the
white space at the end). Two hashed draws in 0..n are the cuts a <= b, and each row gets a pattern of
its own,

    (unit{a}) (unit{b-a}) (rest)

whose single match captures prefix, middle and suffix; the replacement text of the same match puts them
into the order of the row's form. Units and counted groups are possessive, so that the matcher loops over
a text and neither backtracks nor recurses, however long it is. Everything is built-in Spark functions in
one projection: no shuffle, no user function.

Because no text with a marker in it is rearranged and markers cannot overlap each other, the markers of
an output are found again unambiguously, and ``restored`` gives back the text.

Defined results: a null text counts as empty, has no units and stays plain; a null doc_id draws as an
empty string; rows that share a doc_id draw alike; texts are taken whole; an empty table gives an empty
result; other columns are kept, but those named as the results are replaced.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.quality import let

#: a word with the white space before it, or white space behind the last word
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
#: what stands before prefix, suffix and middle
MARKERS = ("<P>", "<S>", "<M>")


def check_markers(markers: tuple[str, str, str]) -> None:
    """Refuse markers that could be found where none was put."""
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers are needed")
    for a, b in product(markers, markers):
        inside = a != b and a in b
        if inside or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b) + (a != b)))):
            raise ValueError(f"markers {a!r} and {b!r} can overlap")


def literal(text: str) -> str:
    """A pattern that matches just this text."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in text)


def replacement(text: str) -> str:
    """``text`` in a replacement string."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return let(digest, lambda d: F.array(*[F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]))


def infilled(
    doc_id: Column,
    text: Column,
    rate: int = 50,
    spm: int = 80,
    seed: int = 42,
    markers: tuple[str, str, str] = MARKERS,
) -> Column:
    """Struct of n, form, output, prefix_chars and middle_chars.

    Of a hundred texts ``rate`` are rearranged, of a hundred of these ``spm`` to suffix, prefix, middle
    and the others to prefix, suffix, middle.
    """
    check_markers(markers)
    prefix, suffix, middle = (replacement(m) for m in markers)
    orders = {
        "psm": f"{prefix}${{prefix}}{suffix}${{suffix}}{middle}${{middle}}",
        "spm": f"{suffix}${{suffix}}{prefix}${{prefix}}{middle}${{middle}}",
    }

    def form(t: Column, h: Column) -> Column:
        held = F.lit(False)
        for m in markers:
            held = held | t.contains(m)
        plain = (t == "") | held | (h[2] % 100 >= rate)
        return F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")

    def rearranged(t: Column, n: Column, h: Column, form: Column) -> Column:
        cuts = F.array_sort(F.array(h[0] % (n + 1), h[1] % (n + 1)))
        counted = lambda name, k: F.concat(F.lit(f"(?<{name}>{UNIT}{{"), k.cast("string"), F.lit("}+)"))
        pattern = let(
            cuts,
            lambda c: F.concat(F.lit(r"\A"), counted("prefix", c[0]), counted("middle", c[1] - c[0]), F.lit(r"(?<suffix>(?s:.*+))\z")),
        )
        order = F.when(form == "spm", orders["spm"]).otherwise(orders["psm"])
        return F.when(form == "plain", t).otherwise(F.regexp_replace(t, pattern, order))

    def described(n: Column, form: Column, output: Column) -> Column:
        def of(p: Column) -> Column:
            chars = lambda k: F.when(form != "plain", F.length(k).cast("long"))
            return F.struct(
                n.cast("long").alias("n"),
                form.alias("form"),
                output.alias("output"),
                chars(p["prefix"]).alias("prefix_chars"),
                chars(p["middle"]).alias("middle_chars"),
            )

        return let(parts(output, form, markers), of)

    def of(t: Column, h: Column) -> Column:
        return let(
            F.struct(F.regexp_count(t, F.lit(UNIT)).alias("n"), form(t, h).alias("form")),
            lambda s: let(rearranged(t, s["n"], h, s["form"]), lambda output: described(s["n"], s["form"], output)),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(draws(doc_id, seed), lambda h: of(t, h)))


def parts(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """Struct of prefix, middle and suffix of an output; null where it is plain."""
    cut = F.split(output, "|".join(map(literal, markers)), -1)

    def of(p: Column) -> Column:
        spm = form == "spm"
        return F.struct(
            F.get(p, F.when(spm, 2).otherwise(1)).alias("prefix"),
            F.get(p, F.lit(3)).alias("middle"),
            F.get(p, F.when(spm, 1).otherwise(2)).alias("suffix"),
        )

    return F.when(form != "plain", let(cut, of))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    joined = let(parts(output, form, markers), lambda p: F.concat(p["prefix"], p["middle"], p["suffix"]))
    return F.when(form == "plain", output).otherwise(joined)


def fill_in_middle(
    docs: DataFrame,
    rate: int = 50,
    spm: int = 80,
    seed: int = 42,
    markers: tuple[str, str, str] = MARKERS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The input with fim_n, fim_form, fim_text, fim_prefix_chars and fim_middle_chars."""
    made = {"fim_n": "n", "fim_form": "form", "fim_text": "output", "fim_prefix_chars": "prefix_chars", "fim_middle_chars": "middle_chars"}
    names = [c for c in docs.columns if c.lower() not in made]
    out = infilled(F.col(doc_id), F.col(text), rate, spm, seed, markers)
    whole = F.struct(*[F.col(c) for c in names], out.alias("fim_all"))
    rows = docs.select(whole.alias("row"))
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        *[F.col("row.fim_all").getField(field).alias(c) for c, field in made.items()],
    )
