"""Schemas, column lists and other fixed values of the catalogue.

Everything in this module is data that has to agree with existing files and
tables: column names, their order, types, table names and text markers.
"""

from pyspark.sql import types as T

# --- fixed values: raw records ------------------------------------------------
RAW_COLUMNS = (
    "title",
    "author",
    "summary",
    "words",
    "current_chapters",
    "total_chapters",
    "kudos",
    "bookmarks",
    "hits",
    "rating",
    "language",
    "status",
    "last_date",
    "warning",
    "category",
    "fandom",
    "relationship",
    "character",
    "freeform",
    "url",
)
TEXT_COLUMNS = ("title", "author", "summary", "rating", "language", "status", "url")
INTEGER_COLUMNS = ("words", "kudos", "bookmarks", "hits", "current_chapters", "total_chapters")
ZERO_DEFAULT_COLUMNS = ("hits", "kudos", "bookmarks")
TAG_KINDS = ("warning", "category", "fandom", "relationship", "character", "freeform")

# --- fixed values: core table ---------------------------------------------------
CORE_TABLE = "fics"
CORE_SCHEMA = T.StructType(
    [
        T.StructField("fic_id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("author", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("hits", T.IntegerType(), False),
        T.StructField("bookmarks", T.IntegerType(), False),
        T.StructField("kudos", T.IntegerType(), False),
        T.StructField("current_chapters", T.IntegerType(), False),
        T.StructField("total_chapters", T.IntegerType()),
        T.StructField("words", T.IntegerType(), False),
        T.StructField("last_date", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("language", T.StringType(), False),
        T.StructField("rating", T.StringType(), False),
    ]
)
CORE_COLUMNS = tuple(CORE_SCHEMA.fieldNames())
REQUIRED_COLUMNS = (
    "url",
    "name",
    "hits",
    "bookmarks",
    "kudos",
    "current_chapters",
    "words",
    "language",
    "rating",
)
STATUS_DOMAIN = ("completed", "on_going")

# --- fixed values: tag tables, per kind: dictionary, pairs, id and value column -----
TAG_TABLES = {
    "warning": ("warning_value", "warning_join", "warning_id", "warning"),
    "category": ("categories_value", "categories_join", "categories_id", "categories"),
    "fandom": ("fandom_value", "fandom_join", "fandom_id", "fandom"),
    "relationship": ("relationship_value", "relationship_join", "relationship_id", "relationship"),
    "character": ("characters_value", "characters_join", "characters_id", "characters"),
    "freeform": ("freeform_value", "freeform_join", "freeform_id", "freeform"),
}

# --- fixed values: text that stands for "no value" in a raw CSV file ----------------
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- fixed values: recommendation ---------------------------------------------------
SCORE_WEIGHTS = {"embedding": 0.70, "fandom": 0.15, "relationship": 0.10, "popularity": 0.05}
DEFAULT_TOP_K = 10
DEFAULT_RETRIEVAL_SIZE = 100
WORKS_PER_LISTING_PAGE = 20

# --- physical layout ------------------------------------------------------------
# The six dictionaries share one table and the six pair tables another, both
# partitioned by ``kind``; readers prune to the kind they ask for.
RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)
PAIR_SCHEMA = T.StructType(
    [
        T.StructField("fic_id", T.LongType()),
        T.StructField("id", T.IntegerType()),
        T.StructField("kind", T.StringType()),
    ]
)
# Kept up to date by loads: one row per work, per bucket of works, and per load and tag.
SCORED_KINDS = ("fandom", "relationship")
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("fic_id", T.LongType()),
        *[CORE_SCHEMA[c] for c in ("kudos", "bookmarks")],
        *[T.StructField(k, T.ArrayType(T.IntegerType())) for k in SCORED_KINDS],
    ]
)
MAXIMA_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("works", T.LongType()),
        *[T.StructField(f"max_{c}", CORE_SCHEMA[c].dataType) for c in ("kudos", "bookmarks")],
    ]
)
COUNT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("works", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)
INVALID_SCHEMA = T.StructType(
    [
        T.StructField("row_number", T.LongType()),
        T.StructField("fic_id", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
EMBEDDING_SCHEMA = T.StructType(
    [
        T.StructField("fic_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model_name", T.StringType()),
        T.StructField("dim", T.IntegerType()),
    ]
)
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
