"""Scalar cleaning rules as column expressions (no Python per row)."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in raw text, as a regular
# expression class and one by one. It is the Unicode set plus U+001C to U+001F.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same set written for speed: one table look-up for Latin-1, other spaces are tried from U+1680 on only.
_WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_ANY_SPACE = rf"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0{_WIDE}]"
SPACES = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

# Layouts that are read as dates, the first that fits wins. Of two numbers with a slash the
# first is the month.
DATE_FORMATS = (
    "yyyy-M-d",
    "d MMM yyyy",
    "M/d/yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyy/M/d",
    "yyyyMMdd",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
)


def trim_spaces(text: Column) -> Column:
    """Strip leading and trailing Unicode white space."""
    return F.trim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_text(text: Column) -> Column:
    """Collapse white space to single spaces and trim; empty text becomes NULL."""
    return blank_to_null(single_spaced(text))


def single_spaced(text: Column) -> Column:
    """``clean_text`` that leaves empty text empty."""
    # A single plain space stays as it is, so only longer runs and odd spaces are replaced.
    return F.trim(F.regexp_replace(text, rf"{_ANY_SPACE}(?:{_ANY_SPACE}++|(?<!\x20))", " "))


def clean_int(text: Column) -> Column:
    """Integer text with thousands separators to INT; NULL when empty or unparseable."""
    return digits_of(text).try_cast("int")


def digits_of(text: Column) -> Column:
    """What integer text holds, without thousands separators; NULL when empty."""
    return blank_to_null(bare_digits(text))


def bare_digits(text: Column) -> Column:
    """``digits_of`` that leaves empty text empty."""
    return trim_spaces(F.replace(text, F.lit(","), F.lit("")))


def is_bad_int(text: Column) -> Column:
    """True when the text holds something, but not a 32-bit integer."""
    return digits_of(text).isNotNull() & clean_int(text).isNull()


def clean_status(text: Column) -> Column:
    """Map a status label to its domain value; other text is kept in lower case."""
    label = F.lower(trim_spaces(text))
    return (
        F.when(label.startswith("completed"), F.lit("completed"))
        .when(label.startswith("updated"), F.lit("on_going"))
        .otherwise(blank_to_null(label))
    )


def clean_date(text: Column, formats=DATE_FORMATS) -> Column:
    """First layout that parses wins; NULL when none does."""
    return date_of(trim_spaces(text), formats)


def date_of(trimmed: Column, formats=DATE_FORMATS) -> Column:
    """``clean_date`` of a text without white space around it."""
    return F.coalesce(*[F.when(_may_fit(trimmed, f), F.try_to_date(trimmed, f)) for f in formats])


def _may_fit(text: Column, layout: str) -> Column:
    """False only where the layout cannot read the text: a mark of the layout, or any digit, is absent.

    Finding that out is far cheaper than a failed parse.
    """
    bare = re.sub("'[^']*'", "", layout)
    fits = F.lit(True)
    if re.search("[][{}#']", bare):  # optional parts and other syntax: nothing is known
        return fits
    marks = set(re.sub("[A-Za-z]", "", bare))
    for mark in sorted(marks):
        fits &= F.contains(text, F.lit(mark))
    if not marks and re.fullmatch("yyyyMMdd", layout):
        return fits & text.rlike("^[+-]?[0-9]{8,}$")
    return fits & text.rlike("[0-9]") if re.search("[yd]", bare) else fits


def is_bad_date(text: Column, formats=DATE_FORMATS) -> Column:
    """True when the text holds something that no layout reads."""
    return blank_to_null(trim_spaces(text)).isNotNull() & clean_date(text, formats).isNull()


def na_to_null(text: Column, tokens) -> Column:
    """Exact-match markers for "no value" become NULL."""
    return F.when(~text.isin(*tokens), text)


def split_chapters(text: Column) -> tuple[Column, Column]:
    """``current/total`` to two texts; unknown totals and malformed text give NULL."""
    parts = F.split(trim_spaces(text), "/")
    well_formed = F.size(parts) == 2
    current = F.when(well_formed, blank_to_null(parts[0]))
    total = F.when(well_formed & (parts[1] != "?"), parts[1])
    return current, total


def format_score(score: Column) -> Column:
    """Four decimals, as printed in a result list."""
    return F.format_string("%.4f", score)


def text_prefix(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def vector_prefix(vector: Column, length: int) -> Column:
    return F.slice(vector, 1, length)
