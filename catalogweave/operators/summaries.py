"""Aggregates of a catalogue that a load updates instead of recomputing.

* Profiles: a row per work with its counts and its set of tags of each scored kind. A load only adds pairs, so the
  sets of its works grow by union; the counts come from the merged core rows.
* Maxima: the largest counts and the number of works of every bucket of ids. Counts may also fall, so a
  bucket that a load touches is computed again from its profiles; the maximum over all works is the
  maximum over the buckets.
* Tag counts: works per tag. Stored pairs are distinct and never removed, so counts of added pairs just add up.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SCORED_KINDS
from ..sources.manifest import bucket_of


def pair_sets(pairs: DataFrame) -> DataFrame:
    """(fic_id, a sorted set of tag ids per scored kind) from (fic_id, kind, id) pairs."""
    return pairs.where(F.col("kind").isin(*SCORED_KINDS)).groupBy("fic_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("id")))).alias(k) for k in SCORED_KINDS]
    )


def merged_profiles(core: DataFrame, old: DataFrame, added: DataFrame) -> DataFrame:
    """Profiles of the works in ``core``: their sets in ``old`` joined with those of the ``added`` pairs."""
    none = F.array().cast("array<int>")
    sets = pair_sets(added).select("fic_id", *[F.col(k).alias(f"added_{k}") for k in SCORED_KINDS])
    joined = core.select("fic_id", "kudos", "bookmarks").join(old.select("fic_id", *SCORED_KINDS), "fic_id", "left")
    return joined.join(sets, "fic_id", "left").select(
        "fic_id",
        "kudos",
        "bookmarks",
        *[F.array_sort(F.array_union(F.coalesce(k, none), F.coalesce(f"added_{k}", none))).alias(k) for k in SCORED_KINDS],
    )


def bucket_maxima(profiles: DataFrame) -> DataFrame:
    """(bucket, works, max_kudos, max_bookmarks): at most a row per bucket."""
    return profiles.groupBy(bucket_of("fic_id").alias("bucket")).agg(
        F.count("*").alias("works"), F.max("kudos").alias("max_kudos"), F.max("bookmarks").alias("max_bookmarks")
    )


def merged_maxima(old: DataFrame, fresh: DataFrame, touched: set[int]) -> DataFrame:
    """``fresh`` for the touched buckets, ``old`` for all others."""
    return old.where(~F.col("bucket").isin(sorted(touched))).unionByName(fresh)


def overall_maxima(maxima: DataFrame) -> DataFrame:
    """One row (max_kudos, max_bookmarks) over all works; 0 for an empty catalogue."""
    return maxima.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("max_kudos", "max_bookmarks")])


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(kind, id, works) of distinct pairs; counts of disjoint sets of pairs may be added up."""
    return pairs.groupBy("kind", "id").agg(F.count("*").alias("works"))


def merged_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("kind", "id").agg(F.sum("works").alias("works"))
