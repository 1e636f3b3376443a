"""The published catalogue: a core table, six dictionaries and six pair tables.

Physically there are three tables of immutable parts named by a manifest.
Dictionaries and pairs only ever grow: a new snapshot reuses their parts and adds
one more. The core table is kept in buckets of ``fic_id``; a load rewrites the buckets
that hold one of its works and reuses the folders of all others.

Beside them are aggregates that loads keep up to date (see ``operators.summaries``): profiles in the
same buckets, a row of maxima per bucket, and tag counts as one more part per load.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import (
    CORE_SCHEMA,
    CORE_TABLE,
    COUNT_SCHEMA,
    DICTIONARY_SCHEMA,
    MAXIMA_SCHEMA,
    PAIR_SCHEMA,
    PROFILE_SCHEMA,
    TAG_TABLES,
)
from ..operators.summaries import merged_counts, overall_maxima
from .manifest import current_snapshot, new_folder, publish, read_parts, write_buckets

_SCHEMAS = {
    "core": CORE_SCHEMA,
    "dictionary": DICTIONARY_SCHEMA,
    "pairs": PAIR_SCHEMA,
    "profiles": PROFILE_SCHEMA,
    "maxima": MAXIMA_SCHEMA,
    "counts": COUNT_SCHEMA,
}


def read_part(spark: SparkSession, snapshot: dict, name: str) -> DataFrame:
    """One physical table (core, dictionary, pairs, profiles, maxima or counts) of a snapshot."""
    return read_parts(spark, snapshot["parts"].get(name, []), _SCHEMAS[name])


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A logical table by name: the core table, a dictionary or a pair table."""
    snapshot = current_snapshot(spark, root)
    if table == CORE_TABLE:
        return read_part(spark, snapshot, "core")
    for kind, (dictionary, pairs, id_column, value_column) in TAG_TABLES.items():
        if table == dictionary:
            rows = read_part(spark, snapshot, "dictionary").where(F.col("kind") == kind)
            return rows.select(F.col("id").alias(id_column), F.col("value").alias(value_column))
        if table == pairs:
            rows = read_part(spark, snapshot, "pairs").where(F.col("kind") == kind)
            return rows.select("fic_id", F.col("id").alias(id_column))
    raise KeyError(f"unknown table {table}")


def read_dictionary(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return read_table(spark, root, TAG_TABLES[kind][0])


def read_profiles(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, one row of overall maxima) of the published catalogue."""
    snapshot = current_snapshot(spark, root)
    return read_part(spark, snapshot, "profiles"), overall_maxima(read_part(spark, snapshot, "maxima"))


def read_tag_counts(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(id, works): in how many works a tag of this kind occurs."""
    counts = read_part(spark, current_snapshot(spark, root), "counts").where(F.col("kind") == kind)
    return merged_counts(counts).select("id", "works")


PART_SLICES = 8  # files per kind of a new part, at most
MOST_PARTS = 32  # parts of a table from which a load compacts it


def write_core(frame: DataFrame, root: str, name: str = "core") -> list[str]:
    """Write rows of a table in buckets (core or profiles) under fresh folders and return the folders."""
    return list(write_buckets(frame.select(*_SCHEMAS[name].fieldNames()), "fic_id", root, name).values())


def write_maxima(frame: DataFrame, root: str) -> str:
    """Write the maxima, a row per bucket at most, as one file under a fresh folder and return the folder."""
    folder = new_folder(root, "maxima")
    frame.select(*MAXIMA_SCHEMA.fieldNames()).coalesce(1).write.parquet(folder)
    return folder


def write_part(frame: DataFrame, root: str, name: str) -> str:
    """Write one new part of the dictionary or the pairs under a fresh folder and return the folder.

    Rows are dealt by kind and a hash first, so a part is a few files per kind, however many tasks made it.
    """
    folder = new_folder(root, name)
    rows = frame.select(*_SCHEMAS[name].fieldNames())
    slice_of = F.pmod(F.xxhash64(*rows.columns), F.lit(PART_SLICES))
    rows.repartition("kind", slice_of).write.partitionBy("kind").parquet(folder)
    return folder


def compact(spark: SparkSession, root: str) -> dict:
    """Rewrite the many small parts left by many loads as one part per table; core has one folder per bucket anyway."""
    snapshot = current_snapshot(spark, root)
    order = {"dictionary": ["kind", "id"], "pairs": ["kind", "fic_id", "id"], "counts": ["kind", "id"]}
    parts = dict(snapshot["parts"])
    for name, keys in order.items():
        if len(parts.get(name, [])) > 1:
            rows = read_part(spark, snapshot, name)
            rows = merged_counts(rows) if name == "counts" else rows
            rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
            folder = new_folder(root, name)
            rows.write.partitionBy("kind").parquet(folder)
            parts[name] = [folder]
    return publish(spark, root, snapshot, parts)


def compact_when_many(spark: SparkSession, root: str, most: int = MOST_PARTS) -> None:
    """Compact once a table has more than ``most`` parts."""
    parts = current_snapshot(spark, root)["parts"]
    if max((len(parts.get(name, [])) for name in ("dictionary", "pairs")), default=0) > most:
        compact(spark, root)
