"""Integers as variable-length bytes, dates and lists of options, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shift(kind: str, n: Column, places: Column) -> Column:
    return F.call_function(kind, n, places)


def zigzag(n: Column) -> Column:
    """A signed long as one whose small magnitudes are small."""
    n = n.cast("bigint")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(1))


def leb128(n: Column) -> Column:
    """A long, taken as unsigned, as hex digits of its groups of seven bits, the lowest first, all but the last marked."""
    n = n.cast("bigint")
    groups = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: _shift("shiftrightunsigned", n, i * 7))
    used = F.filter(groups, lambda g, i: (i == 0) | (g != 0))
    return F.array_join(F.transform(used, lambda g, i: F.lpad(F.lower(F.hex(g.bitwiseAND(127) + F.when(i < F.size(used) - 1, 128).otherwise(0))), 2, "0")), "")


def from_leb128(digits: Column) -> Column:
    """The number that hex digits begin with."""
    pairs = F.regexp_extract_all(F.regexp_extract(digits, "^(?:[89a-f].)*[0-7].", 0), F.lit(".."), F.lit(0))
    parts = F.transform(pairs, lambda p, i: _shift("shiftleft", F.conv(p, 16, 10).cast("bigint").bitwiseAND(127), i * 7))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def date_of(days: Column) -> Column:
    """Days since 1970-01-01 as a date and time in UTC, as text."""
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string"), F.lit("T00:00:00Z"))


def parse_floors(text: str, periods: int = 6) -> list[int]:
    """One whole number for each period, separated by commas."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != periods or not all(p.isascii() and p.isdigit() for p in parts):
        raise ValueError(f"{periods} whole numbers are needed, one for each period, not {text!r}")
    return [int(p) for p in parts]


def parse_share(text: str) -> float:
    """A finite number from 0 to 1."""
    value = float(text)
    if not 0 <= value <= 1:
        raise ValueError(f"a share is from 0 to 1, not {text!r}")
    return value
