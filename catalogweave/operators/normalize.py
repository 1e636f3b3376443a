"""Core table, tag vocabulary, stable ids and work-tag pairs."""

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import derive_id
from ..schemas import CORE_COLUMNS, TAG_KINDS
from ..session import staged
from .joins import absent_rows, lookup_join
from .ranges import with_position


class NormalizedWorks(NamedTuple):
    works: DataFrame
    core: DataFrame
    vocabulary: DataFrame
    duplicates: DataFrame


def with_identity(works: DataFrame) -> DataFrame:
    """Derive ``fic_id`` from the URL and call the title ``name``."""
    return works.withColumn("fic_id", derive_id(F.col("url"))).withColumnRenamed("title", "name")


def core_projection(works: DataFrame) -> DataFrame:
    return works.select(*CORE_COLUMNS)


def dedupe_first(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in the given order.

    The rank filter is pushed below the shuffle as a group limit: each map task
    sends at most one row per key, however many copies a key has.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def count_duplicates(frame: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key; NULL keys form one group."""
    per_key = frame.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def explode_tags(works: DataFrame, kinds=TAG_KINDS) -> DataFrame:
    """(fic_id, kind, value) for every list item of every kind, in one pass."""
    tagged = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("items")) for k in kinds]
    lists = works.select("fic_id", F.inline(F.array(*tagged)))
    return lists.select("fic_id", "kind", F.explode(F.array_distinct("items")).alias("value"))


def flatten_values(frame: DataFrame, column: str) -> DataFrame:
    return frame.select(F.explode(column).alias("value"))


def build_vocabulary(frame: DataFrame, column: str) -> DataFrame:
    """Distinct values of one list column, sorted by code point."""
    return flatten_values(frame, column).distinct().orderBy("value")


def assign_ids(values: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Dense ids per kind for (kind, value), in value order.

    Known values keep their id; new ones continue after the largest id of their
    kind. Returns only the new (kind, id, value) rows.
    """
    fresh = values.select("kind", "value").distinct()
    if existing is not None:
        fresh = absent_rows(fresh, existing, ["kind", "value"])
    placed = with_position(fresh, ["kind", "value"])
    starts = placed.groupBy("kind").agg(F.min("position").alias("start"))
    if existing is not None:
        used = existing.groupBy("kind").agg(F.max("id").alias("used"))
        starts = starts.join(used, "kind", "left")
    else:
        starts = starts.withColumn("used", F.lit(0))
    # One row per kind.
    numbered = placed.join(F.broadcast(starts), "kind")
    id_ = F.col("position") - F.col("start") + 1 + F.coalesce(F.col("used"), F.lit(0))
    return numbered.select("kind", id_.cast("int").alias("id"), "value")


def count_tags(tags: DataFrame) -> DataFrame:
    """Stored (kind, value, n): the vocabulary with its frequencies, from one pass over the tags.

    It serves ``assign_ids`` as values and ``encode_tags`` as the key counts that find hot tags.
    """
    return staged(tags.groupBy("kind", "value").agg(F.count("*").alias("n")), "counted-tags")


def encode_tags(tags: DataFrame, dictionary: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(fic_id, kind, value) to distinct (fic_id, kind, id).

    Values are encoded first and made distinct afterwards, so the second shuffle
    moves numbers instead of texts. ``counts`` come from ``count_tags``.
    """
    values = tags.select("fic_id", "kind", "value")
    encoded = lookup_join(values, dictionary.select("kind", "value", "id"), ["kind", "value"], counts=counts)
    return encoded.select("fic_id", "kind", "id").distinct()


def unknown_tags(tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tag values without a dictionary entry; must be empty before encoding."""
    return absent_rows(tags.select("kind", "value").distinct(), dictionary, ["kind", "value"])


def lookup_and_pairs(works: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Dictionary and sorted pairs of one kind, with ids local to this frame."""
    tags = explode_tags(works, [kind])
    counts = count_tags(tags)
    dictionary = assign_ids(counts)
    pairs = encode_tags(tags, dictionary, counts).orderBy("fic_id", "id")
    return dictionary.drop("kind"), pairs.drop("kind")


def normalize_works(works: DataFrame, order: list) -> NormalizedWorks:
    """Valid works to unique works, core rows, tag vocabulary and the duplicate count."""
    duplicates = count_duplicates(works, "fic_id")
    unique = dedupe_first(works, ["fic_id"], order)
    vocabulary = explode_tags(unique).select("kind", "value").distinct()
    return NormalizedWorks(unique, core_projection(unique), vocabulary, duplicates)
