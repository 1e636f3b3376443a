"""Which works are like this one: retrieve by similarity, then re-rank."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieve import retrieve, retrieve_vector
from ..operators.score import max_popularity, score_candidates, score_profiles
from ..schemas import DEFAULT_RETRIEVAL_SIZE, DEFAULT_TOP_K
from ..session import pin, staged
from ..sources.catalogue import read_profiles
from ..sources.embeddings import get_embedding, read_embeddings

SCORE_DECIMALS = 12

RESULT_COLUMNS = (
    "fic_id",
    "score",
    "sim",
    "fandom_score",
    "relationship_score",
    "popularity",
)


def recommend(
    store: DataFrame,
    core: DataFrame,
    tags: DataFrame,
    fic_id: int,
    top_k: int = DEFAULT_TOP_K,
    retrieval_size: int = DEFAULT_RETRIEVAL_SIZE,
    weights: dict | None = None,
) -> DataFrame:
    """(rank, fic_id, score, components) for one work; ``KeyError`` when it has no vector."""
    _require_sizes(top_k, retrieval_size)
    found = staged(retrieve_vector(store, fic_id, get_embedding(store, fic_id), retrieval_size), "found")
    # A stored table of at most ``retrieval_size`` ids: Spark knows its size and broadcasts it when it may.
    asked = store.sparkSession.range(fic_id, fic_id + 1).select(F.col("id").alias("fic_id"))
    ids = found.select("fic_id").union(asked)
    few_tags, few_works = tags.join(ids, "fic_id", "left_semi"), core.join(ids, "fic_id", "left_semi")
    scored = score_candidates(found, few_works, few_tags, weights, maxima=max_popularity(core))
    return rank_results(scored, top_k).drop("query_id")


def recommend_from(
    spark: SparkSession,
    root: str,
    store_path: str,
    fic_id: int,
    top_k: int = DEFAULT_TOP_K,
    retrieval_size: int = DEFAULT_RETRIEVAL_SIZE,
    weights: dict | None = None,
) -> DataFrame:
    """``recommend`` over the published catalogue at ``root`` and the vectors at ``store_path``.

    Tag sets and maxima are those that the loads keep up to date; neither pairs nor core rows are read.
    """
    _require_sizes(top_k, retrieval_size)
    store = read_embeddings(spark, store_path)
    found = staged(retrieve_vector(store, fic_id, get_embedding(store, fic_id), retrieval_size), "found")
    profiles, maxima = read_profiles(spark, root)
    asked = spark.range(fic_id, fic_id + 1).select(F.col("id").alias("fic_id"))
    few = staged(profiles.join(found.select("fic_id").union(asked), "fic_id", "left_semi"), "profiles")
    return rank_results(score_profiles(found, few, maxima, weights), top_k).drop("query_id")


def recommend_batch_from(
    spark: SparkSession,
    root: str,
    store_path: str,
    query_ids: DataFrame,
    top_k: int = DEFAULT_TOP_K,
    retrieval_size: int = DEFAULT_RETRIEVAL_SIZE,
    weights: dict | None = None,
) -> DataFrame:
    """``recommend_batch`` over a published catalogue, from the profiles that its loads keep up to date."""
    _require_sizes(top_k, retrieval_size)
    found = _retrieved(read_embeddings(spark, store_path), query_ids, retrieval_size)
    return rank_results(score_profiles(found, *read_profiles(spark, root), weights), top_k)


def recommend_batch(
    store: DataFrame,
    core: DataFrame,
    tags: DataFrame,
    query_ids: DataFrame,
    top_k: int = DEFAULT_TOP_K,
    retrieval_size: int = DEFAULT_RETRIEVAL_SIZE,
    weights: dict | None = None,
) -> DataFrame:
    """(query_id, rank, fic_id, score, components) for many works at once.

    Query ids without a vector are left out; ``missing_queries`` reports them.
    """
    _require_sizes(top_k, retrieval_size)
    found = _retrieved(store, query_ids, retrieval_size)
    return rank_results(score_candidates(found, core, tags, weights), top_k)


def _retrieved(store: DataFrame, query_ids: DataFrame, retrieval_size: int) -> DataFrame:
    asked = query_ids.select("query_id").distinct()
    vectors = store.select(F.col("fic_id").alias("query_id"), "embedding")
    queries = vectors.join(asked, "query_id", "left_semi")
    return pin(retrieve(store, queries, retrieval_size).drop("place"))


def rank_results(scored: DataFrame, top_k: int) -> DataFrame:
    """Best ``top_k`` per query: score first, then similarity, then the lower id."""
    exact = F.round("score", SCORE_DECIMALS)
    order = Window.partitionBy("query_id").orderBy(F.desc(exact), F.desc("sim"), "fic_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", *RESULT_COLUMNS)


def _require_sizes(top_k: int, retrieval_size: int) -> None:
    if top_k < 1 or retrieval_size < 1:
        raise ValueError("top_k and retrieval_size must be at least 1")
