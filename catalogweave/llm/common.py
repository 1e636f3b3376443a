"""Small helpers shared by the operators: staging, folds, bounded label samples."""

import ctypes
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# One MB of slots: a share of the labels is drawn by comparing a hash with a slot number.
HASH_SLOTS = 1 << 20


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once, compressed, into the shared folder and continue from the table.

    The table cuts the lineage: a lost executor costs the tasks it ran, not the
    stages before the table.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def stage_by(frame: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``stage`` as a table bucketed by ``key``: grouping or joining by it later needs no shuffle.

    The catalogue entry is dropped again at once; the files stay in the shared folder.
    """
    spark = frame.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    writer = frame.write.format("parquet").bucketBy(buckets, key)
    writer.option("compression", "zstd").option("path", scratch_path(spark, name)).saveAsTable(table)
    staged = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return staged


def text_key(text: Column) -> Column:
    """A name for a text by its content; a null text counts as an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def keep_one(docs: DataFrame, key: str, text: str, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``groups`` (text_key, component).

    It is the row with the smallest id, rows without an id coming last and ties going by the
    text. Rows that repeat an id in different texts are told apart by the text.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("key"), text_key(F.col(text)).alias("text_key"))
    # A name for (id, text) that is never null, so that rows without an id join like any other.
    name = F.concat_ws(" ", "text_key", F.col("key").cast("string"))
    best = F.min(F.struct(F.col("key").isNull().alias("last"), F.col("key"), F.col("text_key"), name.alias("name")))
    known = rows.select("key", "text_key").distinct().join(groups, "text_key")
    kept = stage(known.groupBy("component").agg(best.alias("best")).select("best.name"), "kept-rows")
    # Repeated rows are cut to one on the map side, before they meet the kept names.
    return rows.withColumn("name", name).dropDuplicates(["name"]).join(kept, "name", "left_semi").select("doc.*")


def remainder(key: Column, mod: int) -> Column:
    """crc32 of the key written as text, modulo ``mod``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def is_remainder(key: Column, mod: int, value: int) -> Column:
    """True where the key's remainder is ``value``; a null key is never."""
    return F.coalesce(remainder(key, mod) == value, F.lit(False))


def label_sample(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """About ``limit`` labelled keys at most, as (key, label); repeated keys keep their largest label.

    Rows are drawn by a hash of the key, so the draw is the same on every run. The
    result has a proven size bound and may be broadcast. Null keys and labels are left out.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("sample_key"))
        .agg(F.max(F.col(label)).cast("int").alias("sample_label"))
    )
    total = known.count()
    if total > limit:
        slot = F.pmod(F.xxhash64("sample_key"), F.lit(HASH_SLOTS))
        known = known.where(slot < int(HASH_SLOTS * limit / total))
    return known


def sampled_texts(docs: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    """(sample_key, sample_label, sample_text): one row for each key of a ``label_sample`` that ``docs`` holds.

    The sample is bounded, so it is broadcast. Of the rows that repeat a key the smallest text
    counts, which is decided on the map side first: the bound on keys is one on rows.
    """
    known = docs.select(F.col(key).alias("sample_key"), F.col(text).alias("sample_text"))
    return known.join(F.broadcast(sample), "sample_key").groupBy("sample_key", "sample_label").agg(F.min("sample_text").alias("sample_text"))


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, shared by all its tasks."""
    module = sys.modules.setdefault("_corpus_worker_cache", types.ModuleType("_corpus_worker_cache"))
    return module.__dict__.setdefault(name, {})


def release_memory() -> None:
    """Give what a finished task has freed back to the system: its Python worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
