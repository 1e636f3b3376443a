"""Whole-frame cleaning of raw works."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lists import with_items
from ..schemas import (
    INTEGER_COLUMNS,
    RAW_COLUMNS,
    STATUS_DOMAIN,
    TAG_KINDS,
    TEXT_COLUMNS,
    ZERO_DEFAULT_COLUMNS,
)
from ..session import spread


BAD_ROW = "bad_row"  # the fault, and the scan's column that marks it


_GIVEN = "given:"  # columns with the text of an integer column, kept beside its value until faults are noted


def fault_of(columns: list[str]):
    """Why a row cannot be stored: ``bad_row`` (more or fewer cells than the header), or the first
    value that holds something unusable, ``bad_int:<column>`` or ``bad_status``.

    Reads cleaned values and, for integers, the texts they were read from."""
    fault = F.when(F.lit(False), F.lit(""))
    if BAD_ROW in columns:
        fault = fault.when(F.col(BAD_ROW), F.lit(BAD_ROW))
    for c in INTEGER_COLUMNS:
        if c in columns:
            fault = fault.when(F.col(f"{_GIVEN}{c}").isNotNull() & F.col(c).isNull(), F.lit(f"bad_int:{c}"))
    if "status" in columns:
        fault = fault.when(~F.col("status").isin(*STATUS_DOMAIN), F.lit("bad_status"))
    return fault


def clean_works(raw: DataFrame) -> DataFrame:
    """Typed columns from text columns, in narrow projections.

    Columns that are missing from ``raw`` stay missing. ``fault`` names the first
    unusable value, which must be noted before absent counts turn into zeros;
    ``date_lost`` marks a date text that no layout reads (the date becomes NULL).
    Each projection refers to values of the one before by name, so a text is
    cleaned once, however many outputs depend on it.
    """
    columns = raw.columns
    integers = [c for c in INTEGER_COLUMNS if c in columns]
    trimmed = [c for c in columns if c == "last_date" or c in TAG_KINDS and _is_text(raw, c)]
    tidy = _tidy(spread(raw), trimmed, integers)
    listed = with_items(tidy, [c for c in trimmed if c in TAG_KINDS])
    if "last_date" in columns:
        dates = {"last_date": X.date_of(F.col("last_date")), f"{_GIVEN}last_date": X.blank_to_null(F.col("last_date")).isNotNull()}
        lost = F.col(f"{_GIVEN}last_date") & F.col("last_date").isNull()
    else:
        dates, lost = {}, F.lit(False)
    typed = listed.withColumns(dates | {c: F.col(f"{_GIVEN}{c}").try_cast("int") for c in integers}).withColumn("date_lost", lost)
    if "status" in columns:
        typed = typed.withColumn("status", X.clean_status(F.col("status")))
    cleaned = [F.coalesce(c, F.lit(0)).alias(c) if c in ZERO_DEFAULT_COLUMNS else F.col(c) for c in columns]
    return typed.select(*cleaned, fault_of(columns).alias("fault"), "date_lost")


def _tidy(frame: DataFrame, trimmed: list[str], integers: list[str]) -> DataFrame:
    """Values without stray white space; the texts of integers come beside them, see ``_GIVEN``.

    Columns that are treated alike go through one expression over an array of them: written out per column, with the
    shapes of the lists after them, they made a generated method of 8,317 bytes, and the JVM compiles none above 8,000.
    One or two columns are written out.
    """
    texts = [c for c in TEXT_COLUMNS if c in frame.columns]
    lists = [c for c in TAG_KINDS if c in frame.columns and c not in trimmed]
    alike = {"texts:": (texts, X.single_spaced), "trims:": (trimmed, X.trim_spaces), "digits:": (integers, X.bare_digits)}
    few = {c: rule(F.col(c).cast("string")) for columns, rule in alike.values() if len(columns) < 3 for c in columns}
    alike = {name: (columns, rule) for name, (columns, rule) in alike.items() if len(columns) > 2}
    others = [c for c in frame.columns if c not in (*texts, *trimmed, *integers)]
    tidied = frame.select(
        *[(_trimmed(F.col(c)) if c in lists else F.col(f"`{c}`")).alias(c) for c in others],
        *[value.alias(c) for c, value in few.items()],
        *[F.transform(F.array(*[F.col(c).cast("string") for c in columns]), rule).alias(name) for name, (columns, rule) in alike.items()],
    )
    values = {c: F.get(name, F.lit(at)) for name, (columns, _) in alike.items() for at, c in enumerate(columns)}
    values |= {c: F.col(c) for c in few}
    values |= {c: X.blank_to_null(values[c]) for c in (*texts, *integers)}
    return tidied.select(
        *[values.get(c, F.col(f"`{c}`")).alias(c) for c in frame.columns if c not in integers],
        *[values[c].alias(f"{_GIVEN}{c}") for c in integers],
    )


def with_missing_columns(frame: DataFrame) -> DataFrame:
    """Add absent raw columns as NULL text or empty lists; all other columns stay."""
    columns = list(frame.columns)
    for c in RAW_COLUMNS:
        if c not in frame.columns:
            kind = "array<string>" if c in TAG_KINDS else "string"
            columns.append((F.array() if c in TAG_KINDS else F.lit(None)).cast(kind).alias(c))
    return frame.select(*columns)


def _is_text(frame: DataFrame, column: str) -> bool:
    return frame.schema[column].dataType.typeName() == "string"


def _trimmed(items):
    none = F.array().cast("array<string>")
    trimmed = F.transform(F.coalesce(items, none), X.trim_spaces)
    return F.filter(trimmed, lambda item: item != "")
