"""Embedding store: one table (fic_id, embedding, model_name, dim) in buckets of the id, behind a manifest."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EMBEDDING_SCHEMA
from .manifest import bucket_of, current_snapshot, in_buckets, publish, read_parts, write_buckets


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The current store at ``path``; an empty frame when nothing was stored yet."""
    folders = current_snapshot(spark, path)["parts"].get("embeddings", [])
    return read_parts(spark, folders, EMBEDDING_SCHEMA)


def as_store(vectors: DataFrame, model_name: str) -> DataFrame:
    """Shape (fic_id, embedding) into store rows; vectors become FLOAT."""
    return vectors.select(
        F.col("fic_id").cast("bigint").alias("fic_id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        F.lit(model_name).alias("model_name"),
        F.size("embedding").alias("dim"),
    )


def write_embeddings(store: DataFrame, path: str) -> None:
    """Publish a whole new store in buckets of ``fic_id``, sorted inside, so a lookup touches few row groups.

    The previous store stays in place, so the new one may be computed from it.
    """
    spark = store.sparkSession
    snapshot = current_snapshot(spark, path)
    folders = write_buckets(store.select(*EMBEDDING_SCHEMA.fieldNames()), "fic_id", path, "embeddings")
    publish(spark, path, snapshot, {"embeddings": list(folders.values())})


def merge_embeddings(fresh: DataFrame, path: str, upsert) -> None:
    """Publish ``upsert(stored, fresh)`` for the buckets that ``fresh`` touches; all other buckets keep their files.

    ``fresh`` should be a stored table: it is read for its buckets and for the merge.
    """
    spark = fresh.sparkSession
    snapshot = current_snapshot(spark, path)
    touched = {r[0] for r in fresh.select(bucket_of("fic_id")).distinct().collect()}
    folders = snapshot["parts"].get("embeddings", [])
    stale, reused = in_buckets(folders, touched)
    merged = upsert(read_parts(spark, stale or folders[:1], EMBEDDING_SCHEMA), fresh)
    if not stale and folders:  # only model and dimension were taken from the stored rows
        merged = merged.join(fresh.select("fic_id"), "fic_id", "left_semi")
    written = write_buckets(merged.select(*EMBEDDING_SCHEMA.fieldNames()), "fic_id", path, "embeddings")
    publish(spark, path, snapshot, {"embeddings": reused + list(written.values())})


def get_embedding(store: DataFrame, fic_id: int) -> list[float]:
    """One vector, read through a pushed-down filter; ``KeyError`` when absent."""
    row = store.where(F.col("fic_id") == F.lit(fic_id)).select("embedding").first()
    if row is None:
        raise KeyError(f"no embedding stored for work {fic_id}")
    return list(row["embedding"])
