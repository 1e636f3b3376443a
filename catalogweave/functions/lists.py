"""List columns stored as literal text, e.g. ``['a', "it's"]``.

Nearly all such text has no escapes, or escapes that JSON knows too, and is parsed by Spark's own
expressions, as is plain text that begins with a word. Whatever has none of these shapes goes through
one Arrow function, all list columns of a row at once.
"""

import ast
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import trim_spaces

# Possessive repetition keeps the match iterative: no stack growth on long lists.
_QUOTED = r"""(?:'[^'\\\n\r\x00]*+'|"[^"\\\n\r\x00]*+")"""
_SIMPLE_LIST = rf"^\[ *+{_QUOTED}(?: *+, *+{_QUOTED})*+ *+\]$"

# Text whose first token is a name is never a literal, whatever follows: at best its syntax tree has that name as a
# leaf. Not names are constants, set(), a string's prefix, and letters that Unicode folds to others.
_BARE_TEXT = r"""^(?!(?:True|False|None|set)(?![A-Za-z0-9_]))[A-Za-z_][A-Za-z0-9_]*+(?!['"]|[^\x00-\x7f])"""

# Lists of quoted items with escapes that mean the same everywhere.
_ESCAPE = r"""\\(?:['"\\abfnrtv]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4})"""
_ESCAPED = rf"""(?:'(?:[^'\\\n\r\x00]|{_ESCAPE})*+'|"(?:[^"\\\n\r\x00]|{_ESCAPE})*+")"""
_ITEM = re.compile(_ESCAPED)
_ESCAPED_LIST = re.compile(rf"\[ *+{_ESCAPED}(?: *+, *+{_ESCAPED})*+ *+\]")

# The same shape for Spark's expressions, without halves of surrogate pairs. Such a text is one step from JSON: ``_AS_JSON``
# writes escapes that JSON lacks, in this order, so that what is left of the backslashes begins an escape each.
_JSON_ESCAPE = r"""\\(?:['"\\abfnrtv]|x[0-9a-fA-F]{2}|u(?![dD][89a-fA-F])[0-9a-fA-F]{4})"""
_JSON_ITEM = (
    rf"""(?:'[^'\\\n\r\x00]*+(?:{_JSON_ESCAPE}[^'\\\n\r\x00]*+)*+'|"[^"\\\n\r\x00]*+(?:{_JSON_ESCAPE}[^"\\\n\r\x00]*+)*+")"""
)
_JSON_LIST = rf"^\[ *+{_JSON_ITEM}(?: *+, *+{_JSON_ITEM})*+ *+\]$"
_AS_JSON = (("\\\\", "\\u005c"), ("\\x", "\\u00"), ("\\'", "\\u0027"), ("\\a", "\\u0007"), ("\\v", "\\u000b"))
_JSON_OPTIONS = {"allowSingleQuotes": "true", "allowUnquotedControlChars": "true"}

# Whole texts that mean "no items".
_EMPTY_TEXTS = ("", "[]", "nan", "None")


def _unescaped(text: str) -> str:
    return text.encode("latin-1", "backslashreplace").decode("unicode_escape") if "\\" in text else text


def _items_of(text: str) -> list[str]:
    """Items of one literal that needs Python's own reading of the text."""
    if _ESCAPED_LIST.fullmatch(text):
        return [item for item in (_unescaped(quoted[1:-1]).strip() for quoted in _ITEM.findall(text)) if item]
    try:
        parsed = ast.literal_eval(text)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        parsed = re.split(",", text)
    if not isinstance(parsed, list):
        parsed = [parsed]
    return [item for item in (str(part).strip() for part in parsed) if item]


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _parse_rest(texts: pa.Array) -> pa.Array:
    """Items of every text of every row's list of texts; a text is read once, however often a batch has it."""
    coded = texts.flatten().dictionary_encode()
    parsed = [None if text is None else _items_of(text) for text in coded.dictionary.to_pylist()]
    items = pa.array(parsed, pa.list_(pa.string())).take(coded.indices)
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(ends, items, mask=texts.is_null())


def _is_empty(trimmed: Column) -> Column:
    return trimmed.isNull() | trimmed.isin(*_EMPTY_TEXTS)


def _odd_text(trimmed: Column) -> Column:
    """The text where it is neither a list without escapes nor plain text, else NULL."""
    plain = trimmed.rlike(_SIMPLE_LIST) | trimmed.rlike(_BARE_TEXT)
    return F.when(~_is_empty(trimmed) & ~plain, trimmed)


def _decoded(odd: Column) -> Column:
    """Items of a list whose escapes JSON can say too, else NULL."""
    json = odd
    for given, known in _AS_JSON:
        json = F.replace(json, F.lit(given), F.lit(known))
    items = F.from_json(json, T.ArrayType(T.StringType()), _JSON_OPTIONS)
    return F.when(odd.rlike(_JSON_LIST), drop_blank(F.transform(items, trim_spaces)))


def _plain_items(trimmed: Column) -> Column:
    quoted = F.regexp_extract_all(trimmed, F.lit(_QUOTED), F.lit(0))
    listed = F.transform(quoted, lambda q: trim_spaces(F.substring(q, F.lit(2), F.length(q) - 2)))
    split = F.transform(F.split(trimmed, ","), trim_spaces)
    items = F.when(trimmed.startswith("["), drop_blank(listed)).otherwise(drop_blank(split))
    return F.coalesce(F.when(~_is_empty(trimmed), items), F.array().cast("array<string>"))


def parse_list(text: Column) -> Column:
    """List literal text to ARRAY<STRING>: items trimmed, blanks dropped, never NULL."""
    return items_of(trim_spaces(text))


def items_of(trimmed: Column) -> Column:
    """``parse_list`` of a text without white space around it."""
    odd = _odd_text(trimmed)
    decoded = _decoded(odd)
    # A Python function is evaluated for every row, so it is fed NULL for all
    # the rows that do not need it; what it returns is never NULL otherwise.
    rest = _parse_rest(F.when(odd.isNotNull() & decoded.isNull(), F.array(odd)))
    return F.coalesce(decoded, F.get(rest, F.lit(0)), _plain_items(trimmed))


def with_items(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``items_of`` several text columns, in their places.

    Each projection refers to the one before by name, so a text's shape is found once; the texts of a
    row that Spark cannot read share one call of the Python function.
    """
    if not columns:
        return frame
    odd, decoded = {c: f"odd:{c}" for c in columns}, {c: f"decoded:{c}" for c in columns}
    found = frame.select("*", *[_odd_text(F.col(c)).alias(odd[c]) for c in columns])
    found = found.select("*", *[_decoded(F.col(odd[c])).alias(decoded[c]) for c in columns])
    left = [F.when(F.col(decoded[c]).isNull(), F.col(odd[c])) for c in columns]
    found = found.withColumn("rest:", F.when(F.coalesce(*left).isNotNull(), F.array(*left)))
    found = found.withColumn("rest:", _parse_rest(F.col("rest:")))
    items = {c: F.coalesce(decoded[c], F.get("rest:", F.lit(at)), _plain_items(F.col(c))) for at, c in enumerate(columns)}
    return found.select(*[items[c].alias(c) if c in items else F.col(f"`{c}`") for c in frame.columns])


def drop_blank(items: Column) -> Column:
    return F.filter(items, lambda item: item != "")


def list_text(items: Column) -> Column:
    """Write an array as literal text that ``parse_list`` reads back."""

    def quote(item):
        escaped = F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        escaped = F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        return F.concat(F.lit("'"), escaped, F.lit("'"))

    return F.concat(F.lit("["), F.array_join(F.transform(items, quote), ", "), F.lit("]"))


