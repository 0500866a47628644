"""Format-preserving Feistel pseudonyms for personal data and secrets.

A finder proposes a value, a validator accepts it (Luhn for cards, mod 97 for IBANs, ranges of phone
and social security numbers, octets of addresses, the calendar for dates), and the value is replaced
by another of its format: a card stays a card with a right check digit, a date a date, an address an
address. The map is a keyed permutation of all values of the format, so equal values get equal
pseudonyms in every document, different ones stay different, and the key's holder can go back.

Values are numbers below a modulus: each free character is a digit of its own radix (10 for digits,
26 for letters, 16 for hexadecimal ones). A Feistel network with a keyed hash permutes the next larger
power of four and is walked until it lands inside (cycle walking). Conjugating a step of one with that
permutation leaves no value as it is.

Texts are changed one by one inside Arrow batches; nothing is shuffled and no value is collected.

Defined results: a null text stays null; an empty one stays empty; texts are taken whole; repeated rows
change alike; an empty table gives no rows; other columns are kept by ``pseudonymise``, those named
``pii_*`` are replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

ROUNDS = 8
DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())


class Permutation:
    """A keyed permutation without fixed points of the numbers below a modulus."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, number: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        person = hashlib.blake2b(tweak, digest_size=14).digest() + number.to_bytes(2, "big")
        out, block = b"", 0
        message = half.to_bytes(size, "big")
        while len(out) < size:
            out += hashlib.blake2b(block.to_bytes(4, "big") + message, key=self.key, person=person, digest_size=32).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _network(self, tweak: bytes, x: int, bits: int, forward: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for number in range(ROUNDS) if forward else reversed(range(ROUNDS)):
            if forward:
                left, right = right, left ^ self._round(tweak, number, right, bits)
            else:
                left, right = right ^ self._round(tweak, number, left, bits), left
        return (left << bits) | right

    def _walk(self, tweak: bytes, x: int, modulus: int, forward: bool) -> int:
        bits = max(1, ((modulus - 1).bit_length() + 1) // 2)
        x = self._network(tweak, x, bits, forward)
        while x >= modulus:
            x = self._network(tweak, x, bits, forward)
        return x

    def shift(self, tweak: bytes, x: int, modulus: int, step: int = 1) -> int:
        """``step`` 1 maps a value to its pseudonym, -1 back."""
        if modulus < 2:
            return x
        return self._walk(tweak, (self._walk(tweak, x, modulus, True) + step) % modulus, modulus, False)


DIGIT, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KINDS_OF_CHAR = {c: a for a in (DIGIT, LOWER, UPPER) for c in a}
HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}


def permute_chars(
    p: Permutation, tweak: str, value: str, step: int, alphabets: list[str | None] | None = None, classes: dict[str, str] = KINDS_OF_CHAR
) -> str:
    """Permute the free characters of a value; ``alphabets`` may name the choices of each place."""
    if alphabets is None:
        alphabets = [classes.get(c) for c in value]
    number, modulus = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        if a:
            number, modulus = number * len(a) + a.index(c), modulus * len(a)
    shape = "".join(chr(33 + len(a)) if a else "!" for a in alphabets)
    number = p.shift(f"{tweak}:{shape}".encode(), number, modulus, step)
    out = list(value)
    for i in range(len(value) - 1, -1, -1):
        if a := alphabets[i]:
            number, k = divmod(number, len(a))
            out[i] = a[k]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 * (n > 9)
    return -total % 10


def refill(value: str, digits: str) -> str:
    """The value's separators with other digits."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in value)


def card(p: Permutation, value: str, step: int) -> str | None:
    digits = "".join(c for c in value if c.isdigit())
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or digits[0] == "0":
        return None
    body = permute_chars(p, "card", digits[:-1], step, [DIGIT[1:]] + [DIGIT] * (len(digits) - 2))
    return refill(value, body + str(luhn(body)))


def phone(p: Permutation, value: str, step: int) -> str | None:
    digits = "".join(c for c in value if c.isdigit())
    lead, national = digits[:-10], digits[-10:]
    if lead not in ("", "1") or len(national) != 10 or national[0] in "01" or national[3] in "01":
        return None
    first = DIGIT[2:]
    return refill(value, lead + permute_chars(p, "phone", national, step, [first, DIGIT, DIGIT, first] + [DIGIT] * 6))


def social(p: Permutation, value: str, step: int) -> str | None:
    area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
    if area in (0, 666) or area > 899 or group == 0 or serial == 0:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    number = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    number = p.shift(b"social", number, len(areas) * 99 * 9999, step)
    rest, serial = divmod(number, 9999)
    area, group = divmod(rest, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def iban(p: Permutation, value: str, step: int) -> str | None:
    plain = value.replace(" ", "")
    as_number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_chars(p, "iban" + plain[:2], plain[4:], step)
    new = plain[:2] + f"{98 - as_number(body + plain[:2] + '00') % 97:02d}" + body
    rest = iter(new)
    return "".join(c if c == " " else next(rest) for c in value)


def address(p: Permutation, value: str, step: int) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    number = 0
    for o in octets:
        number = number << 8 | int(o)
    number = p.shift(b"address", number, 1 << 32, step)
    return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))


def date(p: Permutation, value: str, step: int) -> str | None:
    parts = re.split(r"[-/.]", value)
    sign = value[4] if len(parts[0]) == 4 else value[2]
    year, month, day = (parts if len(parts[0]) == 4 else parts[::-1])
    swapped = sign == "/" and len(parts[0]) == 2 and int(month) > 12
    if swapped:
        month, day = day, month
    try:
        number = datetime.date(int(year), int(month), int(day)).toordinal() - DAYS[0]
    except ValueError:
        return None
    if not 0 <= number < DAYS[1] - DAYS[0]:
        return None
    while True:
        number = p.shift(b"date", number, DAYS[1] - DAYS[0], step)
        new = datetime.date.fromordinal(DAYS[0] + number)
        # month first is only told by a day beyond 12: walk inside those
        if not swapped or new.day > 12:
            break
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    if len(parts[0]) == 4:
        return sign.join((y, m, d))
    return sign.join((m, d, y) if swapped else (d, m, y))


def mail(p: Permutation, value: str, step: int) -> str | None:
    local, host = value.rsplit("@", 1)
    return f"{permute_chars(p, 'mail', local, step)}@{host}"


def access_key(p: Permutation, value: str, step: int) -> str | None:
    return value[:4] + permute_chars(p, "key", value[4:], step, [UPPER + DIGIT] * (len(value) - 4))


def secret(p: Permutation, value: str, step: int) -> str | None:
    is_hex = re.compile(r"(?=.*\d)(?=.*[a-f])[0-9a-f]{8,}").fullmatch
    tweak, classes = ("hex", HEX) if is_hex(value) else ("secret", KINDS_OF_CHAR)
    kind = bool(is_hex(value))
    while True:
        # a value keeps its kind, so that it can be told which way leads back
        value = permute_chars(p, tweak, value, step, classes=classes)
        if bool(is_hex(value)) == kind:
            return value


#: kind, pattern (its first group, or all of it, is the value), validator and map; the first match from the left wins
DIGIT_FINDERS: list[tuple[str, str, Callable]] = [
    ("secret", r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]{6,})", secret),
    ("access_key", r"(?<![A-Za-z0-9])(A(?:KIA|SIA)[A-Z0-9]{16})(?![A-Za-z0-9])", access_key),
    ("iban", r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", iban),
    ("date", r"(?<![\d./-])(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./-]\d{2}[./-]\d{4})(?![\d/-]|\.\d)", date),
    ("social", r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])", social),
    ("card", r"(?<![\d.-])(\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|\d{13,19}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-]|\.\d)", card),
    ("phone", r"(?<![\w.+-])((?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-]|\.\d)", phone),
    ("address", r"(?<![\w.-])(\d{1,3}(?:\.\d{1,3}){3})(?![\w-]|\.\d)", address),
]
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"


class Pseudonyms:
    """Replace, or with ``step`` -1 restore, what is found in texts."""

    def __init__(self, key: bytes, step: int = 1):
        self.permutation, self.step = Permutation(key), step
        self.maps = {kind: fn for kind, _, fn in DIGIT_FINDERS}
        self.pattern = re.compile("|".join(f"(?P<{k}>{self._named(p, k)})" for k, p, _ in DIGIT_FINDERS))
        self.mail = re.compile(MAIL)

    @staticmethod
    def _named(pattern: str, kind: str) -> str:
        """Group 1 of a finder under a name of its own, and references to group 2 by name."""
        out, opened = "", 0
        for piece in re.split(r"(\\.|\(\?|\(|\[[^\]]*\])", pattern):
            if piece == "(":
                opened += 1
                out += f"(?P<{kind}_{opened}>"
            elif piece == r"\2":
                out += f"(?P={kind}_2)"
            else:
                out += piece
        return out

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}

        def change(m: re.Match) -> str:
            kind = next(k for k in self.maps if m.group(k) is not None)
            new = self.maps[kind](self.permutation, m.group(f"{kind}_1"), self.step)
            if new is None:
                return m.group()
            counts[kind] = counts.get(kind, 0) + 1
            low = m.start(f"{kind}_1") - m.start()
            return m.group()[:low] + new + m.group()[low + len(m.group(f"{kind}_1")) :]

        def change_mail(m: re.Match) -> str:
            counts["mail"] = counts.get("mail", 0) + 1
            return mail(self.permutation, m.group(), self.step)

        if "@" in text:
            text = self.mail.sub(change_mail, text)
        if any(d in text for d in DIGIT) or re.search("(?i)passw|passp|pwd|secret|token|key", text):
            text = self.pattern.sub(change, text)
        return text, counts


def _replaced(key: bytes, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, step)
        for batch in batches:
            texts, counts = [], []
            for text in batch["text"]:
                text = text.as_py()
                new, found = (None, {}) if text is None else names.replace(text)
                texts.append(new)
                counts.append(sorted(found.items()))
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch["row"],
                    "text": pa.array(texts, pa.string()),
                    "counts": pa.array(counts, pa.map_(pa.string(), pa.int64())),
                }
            )

    return run


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """The input with pseudonyms in ``text``, and pii_counts: replaced values by kind."""
    names = [c for c in docs.columns if c not in ("pii_counts",)]
    source = docs.select(F.struct(*[c for c in names if c != text] or [F.lit(0).alias("pii_none")]).alias("row"), F.col(text).alias("text"))
    schema = StructType([source.schema["row"], StructField("text", StringType()), StructField("counts", MapType(StringType(), LongType()))])
    out = source.mapInArrow(_replaced(key, -1 if back else 1), schema)
    columns = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names]
    return out.select(*columns, F.col("counts").alias("pii_counts"))
