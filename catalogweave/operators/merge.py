"""Keyed, idempotent merges of new rows into stored tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CORE_COLUMNS, EMBEDDING_SCHEMA, ZERO_DEFAULT_COLUMNS
from .joins import absent_rows, fits_broadcast
from .normalize import assign_ids


class EmbeddingMismatch(ValueError):
    """Vectors that must not enter the store."""


def upsert_works(old: DataFrame, new: DataFrame, keep_old_when_missing: bool = False) -> DataFrame:
    """Insert new works; on a known id take each non-NULL new value, but keep the old URL.

    Absent counts were cleaned to 0 and therefore overwrite stored counts;
    ``keep_old_when_missing`` treats those zeros as absent instead. ``new`` must
    be unique on ``fic_id``.
    """
    values = [c for c in CORE_COLUMNS if c != "fic_id"]

    def merged(column):
        stored, given = F.col(f"o.{column}"), F.col(f"n.{column}")
        if column == "url":
            return F.coalesce(stored, given)
        if keep_old_when_missing and column in ZERO_DEFAULT_COLUMNS:
            return F.coalesce(F.nullif(given, F.lit(0)), stored, given)
        return F.coalesce(given, stored)

    columns = [merged(c).alias(c) for c in values]
    o, n = old.alias("o"), new.alias("n")
    key = F.col("o.fic_id") == F.col("n.fic_id")
    if fits_broadcast(new) and not fits_broadcast(old):
        # A small delta: stored rows are updated in place, without a shuffle.
        updated = o.join(F.broadcast(n), key, "left").select(F.col("o.fic_id").alias("fic_id"), *columns)
        inserted = absent_rows(new, old, ["fic_id"]).select(*CORE_COLUMNS)
        return updated.unionByName(inserted)
    fic_id = F.coalesce(F.col("o.fic_id"), F.col("n.fic_id")).alias("fic_id")
    return o.join(n, key, "full_outer").select(fic_id, *columns)


def merge_dictionary(old: DataFrame, values: DataFrame) -> DataFrame:
    """Stored (kind, id, value) rows plus new values under the next free ids."""
    return old.select("kind", "id", "value").unionByName(assign_ids(values, old))


def new_pairs(old: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct pairs that are not stored yet."""
    return absent_rows(pairs.distinct(), old, pairs.columns)


def merge_pairs(old: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored pairs plus new ones; a stored pair is never removed."""
    return old.unionByName(new_pairs(old, pairs))


def embedding_faults(vectors: DataFrame, model_name: str, dim: int) -> DataFrame:
    """(fic_id, fault) for vectors of another model, another length, or with NaN or NULL elements."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    fault = (
        F.when(F.col("embedding").isNull(), F.lit("no vector"))
        .when(F.col("model_name") != model_name, F.lit("other model"))
        .when(F.size("embedding") != dim, F.lit("other dimension"))
        .when(broken, F.lit("not a number"))
    )
    single = vectors.select("fic_id", fault.alias("fault")).where("fault is not null")
    repeated = vectors.groupBy("fic_id").agg(F.count("*").alias("n")).where("n > 1")
    return single.unionByName(repeated.select("fic_id", F.lit("duplicate id").alias("fault")))


def _require_sound(vectors: DataFrame, model_name: str, dim: int) -> None:
    fault = embedding_faults(vectors, model_name, dim).first()
    if fault is not None:
        raise EmbeddingMismatch(f"work {fault['fic_id']}: {fault['fault']}")


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace or add vectors; the first stored vector fixes model and dimension."""
    first = old.select("model_name", "dim").first() or new.select("model_name", "dim").first()
    if first is not None:
        _require_sound(new, first["model_name"], first["dim"])
    columns = EMBEDDING_SCHEMA.fieldNames()
    return absent_rows(old.select(*columns), new, ["fic_id"]).unionByName(new.select(*columns))


def replace_embeddings(new: DataFrame) -> DataFrame:
    """A whole new store, checked to be of one model and dimension."""
    first = new.select("model_name", "dim").first()
    if first is not None:
        _require_sound(new, first["model_name"], first["dim"])
    return new.select(*EMBEDDING_SCHEMA.fieldNames())
