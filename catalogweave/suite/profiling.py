"""Profiles of documents with labels and of orders."""

from pyspark.sql import functions as F

from ..operators.profile import (
    preview,
    profile,
    profile_nulls,
    profile_numeric,
    profile_samples,
    profile_shape,
    profile_values,
)
from .inputs import table

FIGURES = ("mean", "std", "min", "p25", "p50", "p75", "max")


def labelled_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def nulls(spark, sf_dir):
    return profile_nulls(labelled_documents(spark, sf_dir))


def numeric(spark, sf_dir):
    found = profile_numeric(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    return found.select("column", "count", *[F.round(c, 4).alias(c) for c in FIGURES])


def values(spark, sf_dir):
    return profile_values(table(spark, sf_dir, "orders"), "o_orderpriority")


def values_with_null(spark, sf_dir):
    return profile_values(labelled_documents(spark, sf_dir), "quality")


def samples(spark, sf_dir):
    return profile_samples(labelled_documents(spark, sf_dir), ["lang", "source", "quality", "toxic"], ["doc_id"])


def shape(spark, sf_dir):
    return profile_shape(table(spark, sf_dir, "orders"))


def first_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return preview(orders, ["o_orderkey"], 5)


def whole_profile(spark, sf_dir):
    frame = labelled_documents(spark, sf_dir)
    return profile(frame, ["doc_id"], value_columns=["lang"], sample_columns=["source"])


QUERIES = {
    "profile_nulls": nulls,
    "profile_numeric": numeric,
    "profile_values": values,
    "profile_values_null": values_with_null,
    "profile_samples": samples,
    "profile_shape": shape,
    "preview": first_rows,
    "profile": whole_profile,
}

_DOCS = "d AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
_DOC_COLUMNS = ("doc_id", "lang", "source", "n_chars", "quality", "toxic")


def _numeric(relation, column):
    return f"""SELECT '{column}' AS "column", count({column}) AS count, avg({column})::DOUBLE AS mean,
        stddev_samp({column}) AS std, min({column})::DOUBLE AS min,
        quantile_cont({column}::DOUBLE, 0.25) AS p25, quantile_cont({column}::DOUBLE, 0.5) AS p50,
        quantile_cont({column}::DOUBLE, 0.75) AS p75, max({column})::DOUBLE AS max FROM {relation}"""


def _numeric_all(relation, columns):
    return " UNION ALL ".join(_numeric(relation, c) for c in columns)


_NULLS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls FROM d""" for c in _DOC_COLUMNS
)
_ROUNDED = ", ".join(f"round({f}, 4) AS {f}" for f in FIGURES)
_FIGURE_ROWS = " UNION ALL ".join(
    f"""SELECT 'numeric' AS section, "column" || ' {f}' AS item, printf('%.6f', {f}) AS detail FROM num"""
    for f in FIGURES
)
_SAMPLES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY doc_id)::INT AS place, {c}::VARCHAR AS value
        FROM d WHERE {c} IS NOT NULL QUALIFY place <= 3"""
    for c in ("lang", "source", "quality", "toxic")
)
_DOC_TYPES = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}
_ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": None, "o_orderpriority": "string",
}


def _shape(relation, types):
    rows = [f"SELECT 'rows' AS item, count(*)::VARCHAR AS detail FROM {relation}", f"SELECT 'columns', '{len(types)}'"]
    rows += [f"SELECT 'column {c}', '{t}'" for c, t in types.items()]
    return " UNION ALL ".join(rows)


ORACLES = {
    "profile_nulls": f"WITH {_DOCS} {_NULLS}",
    "profile_numeric": f"""SELECT "column", count, {_ROUNDED}
        FROM ({_numeric_all('orders', ('o_orderkey', 'o_custkey', 'o_totalprice'))})""",
    "profile_values": "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1",
    "profile_values_null": f"WITH {_DOCS} SELECT quality AS value, count(*) AS n FROM d GROUP BY 1",
    "profile_samples": f"WITH {_DOCS} {_SAMPLES}",
    "profile_shape": _shape("orders", {**_ORDER_TYPES, "o_orderdate": "timestamp_ntz"}),
    "preview": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5",
    "profile": f"""WITH {_DOCS}, num AS ({_numeric_all('d', ('doc_id', 'n_chars', 'quality', 'toxic'))})
        SELECT 'shape' AS section, item, detail FROM ({_shape('d', _DOC_TYPES)})
        UNION ALL SELECT 'nulls', "column", nulls::VARCHAR FROM ({_NULLS})
        UNION ALL {_FIGURE_ROWS}
        UNION ALL SELECT 'values', 'lang ' || coalesce(lang, 'NULL'), count(*)::VARCHAR FROM d GROUP BY lang
        UNION ALL (SELECT 'samples', 'source ' || row_number() OVER (ORDER BY doc_id), source FROM d
                   WHERE source IS NOT NULL QUALIFY row_number() OVER (ORDER BY doc_id) <= 3)""",
}
