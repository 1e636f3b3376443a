"""Metadata of candidate works and the weighted score."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..schemas import SCORED_KINDS
from ..session import staged
from .joins import lookup_join


def max_popularity(core: DataFrame) -> DataFrame:
    """Largest kudos and bookmarks over all works; 0 for an empty table."""
    return core.agg(
        F.coalesce(F.max("kudos"), F.lit(0)).alias("max_kudos"),
        F.coalesce(F.max("bookmarks"), F.lit(0)).alias("max_bookmarks"),
    )


def tag_sets(pairs: DataFrame, dictionary: DataFrame, kind: str) -> DataFrame:
    """(fic_id, values): the set of tag values of one kind per work."""
    named = lookup_join(
        pairs.where(F.col("kind") == kind).select("fic_id", "id"),
        dictionary.where(F.col("kind") == kind).select("id", "value"),
        ["id"],
    )
    return named.groupBy("fic_id").agg(F.collect_set("value").alias("values"))


def batch_metadata(ids: DataFrame, core: DataFrame, tags: DataFrame) -> DataFrame:
    """Counts and tag sets for each asked-for id; zeros and empty sets where nothing is stored.

    ``tags`` is (fic_id, kind, value). It is cut down to the asked-for ids before
    the sets are built.
    """
    ids = ids.select("fic_id").distinct()
    wanted = tags.where(F.col("kind").isin(*SCORED_KINDS)).join(ids, "fic_id", "left_semi")
    sets = wanted.groupBy("fic_id").agg(
        *[F.collect_set(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in SCORED_KINDS]
    )
    counts = core.select("fic_id", "kudos", "bookmarks")
    none = F.array().cast("array<string>")
    return (
        ids.join(counts, "fic_id", "left")
        .join(sets, "fic_id", "left")
        .select(
            "fic_id",
            F.coalesce("kudos", F.lit(0)).alias("kudos"),
            F.coalesce("bookmarks", F.lit(0)).alias("bookmarks"),
            *[F.coalesce(k, none).alias(k) for k in SCORED_KINDS],
        )
    )


def scored_tags(tags: DataFrame) -> DataFrame:
    """One row per work with its tags of each scored kind as a sorted set."""
    return tags.where(F.col("kind").isin(*SCORED_KINDS)).groupBy("fic_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("tag")))).alias(k) for k in SCORED_KINDS]
    )


def score_candidates(
    candidates: DataFrame, core: DataFrame, tags: DataFrame, weights: dict | None = None, maxima=None
) -> DataFrame:
    """Score (query_id, fic_id, sim) rows by similarity, shared tags and popularity.

    ``tags`` is distinct (fic_id, kind, tag). A candidate without a core row
    counts as unpopular and untagged. Maxima span all works, not only candidates.
    Each work's tags and counts are brought into one row once; that row meets the
    candidates and the queries, and works that are candidates of very many queries
    are salted (``lookup_join``).
    """
    of_work = staged(scored_tags(tags).join(core.select("fic_id", "kudos", "bookmarks"), "fic_id", "full"), "scored-works")
    return score_profiles(candidates, of_work, max_popularity(core) if maxima is None else maxima, weights)


def score_profiles(candidates: DataFrame, of_work: DataFrame, maxima: DataFrame, weights: dict | None = None) -> DataFrame:
    """``score_candidates`` with a stored row per work: fic_id, kudos, bookmarks and a tag set per scored kind."""
    of_query = of_work.select(F.col("fic_id").alias("query_id"), *[F.col(k).alias(f"query_{k}") for k in SCORED_KINDS])
    top = maxima.select(F.struct("max_kudos", "max_bookmarks")).scalar()
    joined = lookup_join(candidates, of_work, ["fic_id"], how="left")
    joined = lookup_join(joined, of_query, ["query_id"], how="left")

    def count(name):
        return F.coalesce(F.col(name), F.lit(0))

    def size(tags):
        return F.coalesce(F.size(tags), F.lit(0))

    jaccard = {
        k: S.jaccard_from_counts(size(F.array_intersect(k, f"query_{k}")), size(F.col(k)), size(F.col(f"query_{k}")))
        for k in SCORED_KINDS
    }
    popularity = S.popularity_score(
        S.min_max_normalize(count("kudos"), 0, F.col("top.max_kudos")),
        S.min_max_normalize(count("bookmarks"), 0, F.col("top.max_bookmarks")),
    )
    parts = joined.withColumn("top", top).select(
        "query_id",
        "fic_id",
        "sim",
        jaccard["fandom"].alias("fandom_score"),
        jaccard["relationship"].alias("relationship_score"),
        popularity.alias("popularity"),
    )
    score = S.final_score(
        F.col("sim"), F.col("fandom_score"), F.col("relationship_score"), F.col("popularity"), weights
    )
    return parts.withColumn("score", score)
