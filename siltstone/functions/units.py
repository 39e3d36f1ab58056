"""Units and number words."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Picoseconds in a unit of time.
PICOSECONDS = {"fs": 1e-3, "ps": 1.0, "ns": 1e3, "us": 1e6, "µs": 1e6, "μs": 1e6, "ms": 1e9}
#: Bar in a standard atmosphere; kelvin at 0 °C.
ATMOSPHERE_BAR, ZERO_CELSIUS_K = 1.01325, 273.15
#: Number words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


#: Decimal digits of other scripts, which patterns take for digits, and what they stand for.
_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def ascii_digits(text: Column) -> Column:
    """The text with digits of any script as 0 to 9."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, "".join(_DIGITS), _VALUES)).otherwise(text)


def number(text: Column) -> Column:
    """A decimal number in digits of any script; null where it is none, so that no text ends a job."""
    return ascii_digits(text).try_cast("double")


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def duration_ps(value: Column, unit: Column) -> Column:
    return number(value) * lookup(PICOSECONDS, F.lower(unit))


def pressure_bar(value: Column, unit: Column) -> Column:
    return number(value) * F.when(F.lower(unit) == "atm", ATMOSPHERE_BAR).otherwise(1.0)


def timestep_fs(value: Column, unit: Column) -> Column:
    return number(value) * F.when(F.lower(unit) == "ps", 1000.0).otherwise(1.0)


def count_of(word: Column) -> Column:
    """Digits of any script or a number word; null where the number is beyond an int."""
    digits = ascii_digits(word)
    return F.coalesce(F.when(digits.rlike("^[0-9]+$"), digits.try_cast("int")), lookup(NUMBER_WORDS, F.lower(word)))


def whole(word: str) -> int | None:
    """`count_of` for one text."""
    if word.isdecimal():
        digits = word.lstrip("".join(c for c in set(word) if unicodedata.decimal(c) == 0))
        return int(digits or "0") if len(digits) <= 10 and int(digits or "0") < 1 << 31 else None
    return NUMBER_WORDS.get(word.lower())
