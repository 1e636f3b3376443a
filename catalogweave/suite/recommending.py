"""Retrieval and recommendation over parts and vectors."""

from pyspark.sql import functions as F

from ..functions.scores import (
    cosine_similarity,
    jaccard_similarity,
    min_max_normalize,
    popularity_score,
)
from ..functions.text import format_score, vector_prefix
from ..operators.index import build_index, lists_read, read_index, retrieve_indexed, write_index
from ..operators.normalize import assign_ids, count_tags, encode_tags
from ..operators.pairwise import pairwise_similarity
from ..operators.pruned import pairwise_pruned, pairwise_work
from ..operators.retrieve import retrieve, retrieve_vector
from ..operators.score import batch_metadata, max_popularity, score_candidates, tag_sets
from ..operators.similar_sets import set_classes, similar_sets
from ..plans.recommend import recommend, recommend_batch
from ..session import scratch_path
from ..sources.embeddings import get_embedding
from .inputs import part_core, part_tags, part_words, vectors

QUERY_ID = 7
COMPONENTS = ("score", "sim", "fandom_score", "relationship_score", "popularity")


def _rounded(frame):
    kept = [F.round(c, 6).alias(c) if c in COMPONENTS else F.col(c) for c in frame.columns]
    return frame.select(*kept)


def recommend_one(spark, sf_dir):
    store, core, tags = vectors(spark, sf_dir), part_core(spark, sf_dir), part_tags(spark, sf_dir)
    return _rounded(recommend(store, core, tags, QUERY_ID))


def recommend_for_all(spark, sf_dir):
    store, core, tags = vectors(spark, sf_dir), part_core(spark, sf_dir), part_tags(spark, sf_dir)
    queries = store.select(F.col("fic_id").alias("query_id"))
    return _rounded(recommend_batch(store, core, tags, queries))


def cosine_topk(spark, sf_dir):
    store = vectors(spark, sf_dir)
    found = retrieve_vector(store, QUERY_ID, get_embedding(store, QUERY_ID), 100)
    return found.select("fic_id", F.round("sim", 6).alias("sim"))


def cosine_topk_all(spark, sf_dir):
    store = vectors(spark, sf_dir)
    queries = store.withColumnRenamed("fic_id", "query_id")
    found = retrieve(store, queries, 5, broadcast_limit=0, block_rows=256)
    return found.select("query_id", "place", "fic_id", F.round("sim", 6).alias("sim"))


def _similarity_to_one(spark, sf_dir):
    store = vectors(spark, sf_dir)
    query = F.array(*[F.lit(x) for x in get_embedding(store, QUERY_ID)])
    return store.select("fic_id", cosine_similarity(F.col("embedding"), query).alias("sim"))


def cosine_to_one(spark, sf_dir):
    return _similarity_to_one(spark, sf_dir).select("fic_id", F.round("sim", 6).alias("sim"))


def cosine_pairs_above(spark, sf_dir):
    pairs = pairwise_similarity(vectors(spark, sf_dir), 0.3)
    return pairs.select("left_id", "right_id", F.round("sim", 6).alias("sim"))


def cosine_pairs_pruned(spark, sf_dir):
    pairs = pairwise_pruned(vectors(spark, sf_dir), 0.3)
    return pairs.select("left_id", "right_id", F.round("sim", 6).alias("sim"))


def cosine_pairs_work(spark, sf_dir):
    """How few of all pairs are multiplied out at a similarity of 0.93, without losing any."""
    store = vectors(spark, sf_dir)
    n = store.select(F.count("*")).scalar()
    found = F.broadcast(pairwise_pruned(store, 0.93).agg(F.count("*").alias("found")))
    work = pairwise_work(store, 0.93).select(n.alias("vectors"), "products").withColumn("pairs", F.expr("vectors * (vectors - 1) div 2"))
    few = (F.col("products") < 0.25 * F.col("pairs")).alias("few_products")
    return work.join(found, F.lit(True)).select("vectors", "pairs", "found", few)


def _stored_index(spark, sf_dir):
    path = scratch_path(spark, "index")
    write_index(build_index(vectors(spark, sf_dir), 32), path)
    return read_index(spark, path)


def index_topk(spark, sf_dir):
    """The best five for every stored vector, through an index that was written and read again."""
    queries = vectors(spark, sf_dir).withColumnRenamed("fic_id", "query_id")
    found = retrieve_indexed(_stored_index(spark, sf_dir), queries, 5, block_rows=256)
    return found.select("query_id", "place", "fic_id", F.round("sim", 6).alias("sim"))


def index_lists_read(spark, sf_dir):
    """Searching copies of stored vectors for their one best match: few lists are read, and the match is found."""
    store = vectors(spark, sf_dir)
    index = _stored_index(spark, sf_dir)
    copies = store.select((-F.col("fic_id") - 1).alias("query_id"), "embedding")
    read = lists_read(index, copies, 1)
    best = retrieve_indexed(index, copies, 1).select("query_id", F.round("sim", 6).alias("sim"))
    return best.join(read, "query_id").select("query_id", "sim", (F.col("visited") <= 8).alias("few_lists"))


def jaccard_tags(spark, sf_dir):
    works = part_words(spark, sf_dir)
    query = works.where(F.col("fic_id") == QUERY_ID).select(F.array_distinct("words")).scalar()
    return works.select("fic_id", F.round(jaccard_similarity(F.col("words"), query), 6).alias("jaccard"))


def _word_sets(spark, sf_dir):
    return part_words(spark, sf_dir).select("fic_id", F.col("words").alias("values"))


def tag_set_pairs(spark, sf_dir):
    """All works at once: pairs of different tag sets that share half of their tags or more."""
    found = similar_sets(_word_sets(spark, sf_dir), 0.5)
    return found.select("left_id", "right_id", "shared", F.round("jaccard", 6).alias("jaccard"))


def tag_set_classes(spark, sf_dir):
    return set_classes(_word_sets(spark, sf_dir))


def popularity(spark, sf_dir):
    core = part_core(spark, sf_dir)
    top = max_popularity(core).select(F.struct("max_kudos", "max_bookmarks")).scalar()
    value = popularity_score(
        min_max_normalize(F.col("kudos"), 0, F.col("top.max_kudos")),
        min_max_normalize(F.col("bookmarks"), 0, F.col("top.max_bookmarks")),
    )
    return core.withColumn("top", top).select("fic_id", F.round(value, 6).alias("popularity"))


def weighted_score_components(spark, sf_dir):
    store, core, tags = vectors(spark, sf_dir), part_core(spark, sf_dir), part_tags(spark, sf_dir)
    found = retrieve_vector(store, QUERY_ID, get_embedding(store, QUERY_ID), 100)
    return _rounded(score_candidates(found, core, tags).drop("query_id"))


def collect_tag_sets(spark, sf_dir):
    tags = part_tags(spark, sf_dir).withColumnRenamed("tag", "value")
    counts = count_tags(tags)
    dictionary = assign_ids(counts)
    pairs = encode_tags(tags, dictionary, counts)
    fandoms = tag_sets(pairs, dictionary, "fandom").withColumnRenamed("values", "fandoms")
    related = tag_sets(pairs, dictionary, "relationship").withColumnRenamed("values", "related")
    return fandoms.join(related, "fic_id", "left").select(
        "fic_id",
        F.array_join(F.array_sort("fandoms"), ",").alias("fandoms"),
        F.coalesce(F.array_join(F.array_sort("related"), ","), F.lit("")).alias("related"),
    )


def batch_metadata_of_vectors(spark, sf_dir):
    tags = part_tags(spark, sf_dir).withColumnRenamed("tag", "value")
    found = batch_metadata(vectors(spark, sf_dir), part_core(spark, sf_dir), tags)
    return found.select(
        "fic_id",
        "kudos",
        "bookmarks",
        F.array_join(F.array_sort("fandom"), ",").alias("fandom"),
        F.array_join(F.array_sort("relationship"), ",").alias("relationship"),
    )


def embedding_prefix(spark, sf_dir):
    prefix = vector_prefix(F.col("embedding"), 5)
    texts = F.transform(prefix, lambda x: format_score(x.cast("double")))
    return vectors(spark, sf_dir).select("fic_id", F.array_join(texts, " ").alias("prefix"))


def score_text(spark, sf_dir):
    return _similarity_to_one(spark, sf_dir).select("fic_id", format_score(F.col("sim")).alias("text"))


QUERIES = {
    "recommend_one": recommend_one,
    "recommend_batch": recommend_for_all,
    "cosine_topk": cosine_topk,
    "cosine_topk_blocks": cosine_topk_all,
    "cosine_to_one": cosine_to_one,
    "cosine_pairs_above": cosine_pairs_above,
    "cosine_pairs_pruned": cosine_pairs_pruned,
    "cosine_pairs_work": cosine_pairs_work,
    "index_topk": index_topk,
    "index_lists_read": index_lists_read,
    "jaccard_tags": jaccard_tags,
    "tag_set_pairs": tag_set_pairs,
    "tag_set_classes": tag_set_classes,
    "popularity_score": popularity,
    "weighted_score_components": weighted_score_components,
    "collect_tag_sets": collect_tag_sets,
    "batch_metadata": batch_metadata_of_vectors,
    "embedding_lookup": embedding_prefix,
    "format_score": score_text,
}

_SIM = "round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12)"

_ITEMS = """
sold AS (SELECT l_partkey AS id, count(*) AS kudos, count(DISTINCT l_orderkey) AS bookmarks,
                list(DISTINCT l_suppkey) AS rels FROM lineitem GROUP BY l_partkey),
item AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ')) AS tags,
                coalesce(rels, []) AS rels, coalesce(kudos, 0) AS kudos, coalesce(bookmarks, 0) AS bookmarks
         FROM part LEFT JOIN sold ON sold.id = p_partkey),
top AS (SELECT max(kudos) AS mk, max(bookmarks) AS mb FROM item)
"""


def _jaccard(a, b):
    shared = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {shared})"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE {shared}::DOUBLE / {union} END"


_SETS = "cls AS (SELECT list_sort(tags) AS s, min(id) AS class_id FROM item GROUP BY 1)"

_SCORED = f"""
sides AS (SELECT query_id, ret.id AS fic_id, sim,
                 coalesce(i.tags, []) AS tags, coalesce(i.rels, []) AS rels,
                 coalesce(i.kudos, 0) AS kudos, coalesce(i.bookmarks, 0) AS bookmarks,
                 coalesce(q.tags, []) AS qtags, coalesce(q.rels, []) AS qrels
          FROM ret LEFT JOIN item i ON i.id = ret.id LEFT JOIN item q ON q.id = ret.query_id),
parts AS (SELECT query_id, fic_id, sim, {_jaccard('tags', 'qtags')} AS fandom_score,
                 {_jaccard('rels', 'qrels')} AS relationship_score,
                 (kudos::DOUBLE / mk + bookmarks::DOUBLE / mb) / 2 AS popularity
          FROM sides, top),
scored AS (SELECT *, 0.70::DOUBLE * sim + 0.15::DOUBLE * fandom_score
                     + 0.10::DOUBLE * relationship_score + 0.05::DOUBLE * popularity AS score FROM parts)
"""

_RETRIEVED_ONE = f"""
ret AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_SIM} AS sim
        FROM embeddings c, embeddings q WHERE q.vec_id = {QUERY_ID} AND c.vec_id <> q.vec_id
        ORDER BY sim DESC, c.vec_id LIMIT 100)
"""

_RETRIEVED_ALL = f"""
ret AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, {_SIM} AS sim
                       FROM embeddings c JOIN embeddings q ON c.vec_id <> q.vec_id)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 100)
"""

_COMPONENT_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in COMPONENTS)
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, sim DESC, fic_id)"

ORACLES = {
    "recommend_one": f"""WITH {_ITEMS}, {_RETRIEVED_ONE}, {_SCORED}
        SELECT {_RANK}::INT AS rank, fic_id, {_COMPONENT_COLUMNS} FROM scored QUALIFY {_RANK} <= 10""",
    "recommend_batch": f"""WITH {_ITEMS}, {_RETRIEVED_ALL}, {_SCORED}
        SELECT query_id, {_RANK}::INT AS rank, fic_id, {_COMPONENT_COLUMNS} FROM scored QUALIFY {_RANK} <= 10""",
    "cosine_topk": f"WITH {_RETRIEVED_ONE} SELECT id AS fic_id, round(sim, 6) AS sim FROM ret",
    "cosine_topk_blocks": f"""
        WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS fic_id, {_SIM} AS sim
                   FROM embeddings c JOIN embeddings q ON c.vec_id <> q.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, fic_id)::INT AS place,
               fic_id, round(sim, 6) AS sim FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, fic_id) <= 5""",
    "cosine_to_one": f"""SELECT c.vec_id AS fic_id, round({_SIM}, 6) AS sim
        FROM embeddings c, embeddings q WHERE q.vec_id = {QUERY_ID}""",
    "cosine_pairs_above": f"""SELECT q.vec_id AS left_id, c.vec_id AS right_id, round({_SIM}, 6) AS sim
        FROM embeddings q JOIN embeddings c ON q.vec_id < c.vec_id WHERE {_SIM} >= 0.3""",
    "cosine_pairs_pruned": f"""SELECT q.vec_id AS left_id, c.vec_id AS right_id, round({_SIM}, 6) AS sim
        FROM embeddings q JOIN embeddings c ON q.vec_id < c.vec_id WHERE {_SIM} >= 0.3""",
    "cosine_pairs_work": f"""SELECT (SELECT count(*) FROM embeddings) AS vectors, count(*) AS pairs,
        count(*) FILTER (WHERE {_SIM} >= 0.93) AS found, true AS few_products
        FROM embeddings q JOIN embeddings c ON q.vec_id < c.vec_id""",
    "index_topk": f"""
        WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS fic_id, {_SIM} AS sim
                   FROM embeddings c JOIN embeddings q ON c.vec_id <> q.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, fic_id)::INT AS place,
               fic_id, round(sim, 6) AS sim FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, fic_id) <= 5""",
    "index_lists_read": """SELECT -vec_id - 1 AS query_id, 1.0::DOUBLE AS sim, true AS few_lists FROM embeddings""",
    "jaccard_tags": f"""WITH {_ITEMS} SELECT i.id AS fic_id, round({_jaccard('i.tags', 'q.tags')}, 6) AS jaccard
        FROM item i, item q WHERE q.id = {QUERY_ID}""",
    "tag_set_pairs": f"""WITH {_ITEMS}, {_SETS},
        p AS (SELECT a.class_id AS left_id, b.class_id AS right_id, len(list_intersect(a.s, b.s)) AS shared,
                     {_jaccard('a.s', 'b.s')} AS jaccard
              FROM cls a JOIN cls b ON a.class_id < b.class_id)
        SELECT left_id, right_id, shared, round(jaccard, 6) AS jaccard FROM p WHERE jaccard >= 0.5""",
    "tag_set_classes": f"""WITH {_ITEMS}, {_SETS}
        SELECT id AS fic_id, class_id FROM item JOIN cls ON list_sort(tags) = s""",
    "popularity_score": f"""WITH {_ITEMS} SELECT id AS fic_id,
        round((kudos::DOUBLE / mk + bookmarks::DOUBLE / mb) / 2, 6) AS popularity FROM item, top""",
    "weighted_score_components": f"""WITH {_ITEMS}, {_RETRIEVED_ONE}, {_SCORED}
        SELECT fic_id, {_COMPONENT_COLUMNS} FROM scored""",
    "collect_tag_sets": f"""WITH {_ITEMS} SELECT id AS fic_id, array_to_string(list_sort(tags), ',') AS fandoms,
        array_to_string(list_sort(rels::VARCHAR[]), ',') AS related FROM item""",
    "batch_metadata": f"""WITH {_ITEMS} SELECT vec_id AS fic_id, coalesce(kudos, 0)::INT AS kudos,
        coalesce(bookmarks, 0)::INT AS bookmarks,
        coalesce(array_to_string(list_sort(tags), ','), '') AS fandom,
        coalesce(array_to_string(list_sort(rels::VARCHAR[]), ','), '') AS relationship
        FROM embeddings LEFT JOIN item ON item.id = vec_id""",
    "embedding_lookup": """SELECT vec_id AS fic_id, array_to_string(
        list_transform(embedding[1:5], lambda x: printf('%.4f', x::DOUBLE)), ' ') AS prefix FROM embeddings""",
    "format_score": f"""SELECT c.vec_id AS fic_id, printf('%.4f', {_SIM}) AS text
        FROM embeddings c, embeddings q WHERE q.vec_id = {QUERY_ID}""",
}
