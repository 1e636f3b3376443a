"""Keyed merges and quality checks."""

from pyspark.sql import functions as F

from ..operators.merge import merge_dictionary, merge_pairs, upsert_embeddings, upsert_works
from ..operators.normalize import assign_ids
from ..operators.quality import check_catalogue, empty_pair_tables
from ..operators.retrieve import missing_queries
from ..schemas import TAG_KINDS
from ..sources.embeddings import as_store
from .inputs import table, vectors
from .tagging import document_tokens

SHIFT = 250


def _core(frame, **columns):
    """Core rows from a few columns; the rest stay NULL."""
    given = {
        "url": F.lit(None).cast("string"), "name": F.lit(None).cast("string"),
        "author": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"),
        "hits": F.lit(0), "bookmarks": F.lit(0), "kudos": F.lit(0),
        "current_chapters": F.lit(1), "total_chapters": F.lit(None).cast("int"),
        "words": F.lit(None).cast("int"), "last_date": F.lit(None).cast("date"),
        "status": F.lit(None).cast("string"), "language": F.lit("English"), "rating": F.lit("General"),
        **columns,
    }
    fic_id = given.pop("fic_id")
    return frame.select(fic_id.alias("fic_id"), *[v.alias(k) for k, v in given.items()])


def _upsert_sides(spark, sf_dir):
    """Stored works from parts; new works from customers, on every second part and beyond."""
    old = _core(
        table(spark, sf_dir, "part"),
        fic_id=F.col("p_partkey"), url=F.concat(F.lit("old/"), F.col("p_name")), name=F.col("p_name"),
        author=F.col("p_brand"), kudos=F.col("p_size"), words=F.col("p_size"), rating=F.col("p_type"),
    )
    new = _core(
        table(spark, sf_dir, "customer"),
        fic_id=F.col("c_custkey") * 2, url=F.concat(F.lit("new/"), F.col("c_name")),
        name=F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")),
        summary=F.col("c_mktsegment"), hits=F.col("c_nationkey"),
        kudos=F.when(F.col("c_acctbal") < 0, F.lit(0)).otherwise(F.col("c_nationkey")),
        words=F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("int")),
        rating=F.when(F.col("c_nationkey") > 10, F.col("c_mktsegment")),
    )
    return old, new


UPSERT_COLUMNS = ("fic_id", "url", "name", "author", "summary", "hits", "kudos", "words", "rating")


def upserted(spark, sf_dir):
    return upsert_works(*_upsert_sides(spark, sf_dir)).select(*UPSERT_COLUMNS)


def upserted_keeping(spark, sf_dir):
    merged = upsert_works(*_upsert_sides(spark, sf_dir), keep_old_when_missing=True)
    return merged.select("fic_id", "hits", "kudos")


def dictionary_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    known = turns.select(F.lit("en").alias("kind"), F.explode(F.split(F.trim("text"), r"\s+")).alias("value"))
    return merge_dictionary(assign_ids(known), document_tokens(spark, sf_dir))


def pair_merge(spark, sf_dir):
    """Stored: customer and order year; new: customer and shipping year."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    old = orders.select(F.col("o_custkey").alias("fic_id"), F.year("o_orderdate").alias("id")).distinct()
    shipped = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    new = shipped.select(F.col("o_custkey").alias("fic_id"), F.year("l_shipdate").alias("id"))
    return merge_pairs(old, new)


def _shifted(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        (F.col("fic_id") + SHIFT).alias("fic_id"), F.transform("embedding", lambda x: -x).alias("embedding")
    )


def embedding_merge(spark, sf_dir):
    old = as_store(vectors(spark, sf_dir), "given")
    merged = upsert_embeddings(old, as_store(_shifted(spark, sf_dir), "given"))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return merged.select("fic_id", "dim", F.round(total, 5).alias("total"))


def queries_without_vector(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"))
    return missing_queries(vectors(spark, sf_dir), asked)


def _flawed_catalogue(spark, sf_dir):
    """A catalogue that breaks every check, for every kind of tag: orders are dealt to the kinds."""
    customer, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    core = _core(
        customer,
        fic_id=F.when(F.col("c_nationkey") > 3, key - key % 3), url=F.col("c_name"), words=F.col("c_nationkey"),
        name=F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")),
    )
    kind = F.get(F.array(*[F.lit(k) for k in TAG_KINDS]), (F.col("o_orderkey") % len(TAG_KINDS)).cast("int"))
    orders = table(spark, sf_dir, "orders").withColumn("kind", kind)
    dictionary = orders.select(
        "kind", (F.col("o_orderkey") / 4).cast("int").alias("id"), F.concat("o_orderstatus", F.col("o_custkey").cast("string")).alias("value")
    )
    pairs = orders.select((F.col("o_custkey") + SHIFT).alias("fic_id"), "kind", F.year("o_orderdate").alias("id"))
    return core, dictionary, pairs


def quality_report(spark, sf_dir):
    return check_catalogue(*_flawed_catalogue(spark, sf_dir))


def empty_tables(spark, sf_dir):
    return empty_pair_tables(_flawed_catalogue(spark, sf_dir)[2].where("kind IN ('freeform', 'fandom')"))


QUERIES = {
    "upsert_coalesce": upserted,
    "upsert_keep_old_counts": upserted_keeping,
    "dictionary_insert_absent": dictionary_merge,
    "pairs_insert_absent": pair_merge,
    "embedding_upsert": embedding_merge,
    "missing_queries": queries_without_vector,
    "quality_report": quality_report,
    "empty_pair_tables": empty_tables,
}

_SIDES = """
WITH o AS (SELECT p_partkey AS fic_id, 'old/' || p_name AS url, p_name AS name, p_brand AS author, p_size AS kudos,
                  p_size AS words, p_type AS rating FROM part),
n AS (SELECT c_custkey * 2 AS fic_id, 'new/' || c_name AS url, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS name,
             c_mktsegment AS summary, c_nationkey AS hits, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_nationkey END AS kudos,
             CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::INT END AS words,
             CASE WHEN c_nationkey > 10 THEN c_mktsegment END AS rating FROM customer)
"""
_KINDS = "(VALUES ('warning', 'warning'), ('category', 'categories'), ('fandom', 'fandom'), ('relationship', 'relationship'), ('character', 'characters'), ('freeform', 'freeform')) k(kind, stem)"

ORACLES = {
    "upsert_coalesce": f"""{_SIDES}
        SELECT coalesce(o.fic_id, n.fic_id) AS fic_id, coalesce(o.url, n.url) AS url, coalesce(n.name, o.name) AS name,
               o.author, n.summary, coalesce(n.hits, 0) AS hits, coalesce(n.kudos, o.kudos) AS kudos,
               coalesce(n.words, o.words) AS words, coalesce(n.rating, o.rating) AS rating
        FROM o FULL JOIN n ON o.fic_id = n.fic_id""",
    "upsert_keep_old_counts": f"""{_SIDES}
        SELECT coalesce(o.fic_id, n.fic_id) AS fic_id,
               CASE WHEN n.hits <> 0 THEN n.hits ELSE 0 END AS hits,
               CASE WHEN n.kudos <> 0 THEN n.kudos ELSE coalesce(o.kudos, n.kudos) END AS kudos
        FROM o FULL JOIN n ON o.fic_id = n.fic_id""",
    "dictionary_insert_absent": r"""
        WITH known AS (SELECT value, row_number() OVER (ORDER BY value)::INT AS id FROM (
                         SELECT DISTINCT unnest(string_split_regex(trim(text), '\s+')) AS value FROM conversations)),
        given AS (SELECT DISTINCT lang AS kind, unnest(string_split_regex(trim(text), '\s+')) AS value FROM documents),
        fresh AS (SELECT * FROM given WHERE NOT (kind = 'en' AND value IN (SELECT value FROM known)))
        SELECT 'en' AS kind, id, value FROM known
        UNION ALL
        SELECT kind, ((row_number() OVER (PARTITION BY kind ORDER BY value))
                      + CASE WHEN kind = 'en' THEN (SELECT max(id) FROM known) ELSE 0 END)::INT, value FROM fresh""",
    "pairs_insert_absent": """
        SELECT o_custkey AS fic_id, year(o_orderdate)::INT AS id FROM orders
        UNION
        SELECT o_custkey, year(l_shipdate)::INT FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "embedding_upsert": f"""
        WITH new AS (SELECT vec_id + {SHIFT} AS fic_id, len(embedding)::INT AS dim,
                            round(-list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings)
        SELECT * FROM new
        UNION ALL
        SELECT vec_id, len(embedding)::INT, round(list_sum(embedding::DOUBLE[]), 5) FROM embeddings
        WHERE vec_id NOT IN (SELECT fic_id FROM new)""",
    "missing_queries": """SELECT p_partkey AS query_id FROM part
        WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)""",
    "quality_report": f"""
        WITH k AS (SELECT *, row_number() OVER () - 1 AS at FROM {_KINDS}),
        c AS (SELECT CASE WHEN c_nationkey > 3 THEN c_custkey - c_custkey % 3 END AS fic_id, c_mktsegment FROM customer),
        o AS (SELECT k.kind, k.stem, o_custkey + {SHIFT} AS fic_id, year(o_orderdate) AS year, o_orderkey // 4 AS id,
                     o_orderstatus || o_custkey AS value FROM orders JOIN k ON k.at = o_orderkey % 6)
        SELECT 'id_not_null' AS check, 'fics' AS table, count(*) AS violations FROM c WHERE fic_id IS NULL
        UNION ALL SELECT 'required_not_null', 'fics', count(*) FROM c WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT 'id_unique', 'fics', count(fic_id) - count(DISTINCT fic_id) FROM c
        UNION ALL SELECT 'work_exists', stem || '_join', count(*) FILTER (fic_id NOT IN (SELECT fic_id FROM c WHERE fic_id IS NOT NULL)) FROM o GROUP BY stem
        UNION ALL SELECT 'pair_unique', stem || '_join', count(*) - count(DISTINCT (fic_id, year)) FROM o GROUP BY stem
        UNION ALL SELECT 'entry_unique', stem || '_value', count(*) - count(DISTINCT value) FROM o GROUP BY stem
        UNION ALL SELECT 'dictionary_id_unique', stem || '_value', count(*) - count(DISTINCT id) FROM o GROUP BY stem""",
    "empty_pair_tables": f"""SELECT 'not_empty' AS check, stem || '_join' AS table,
        CASE WHEN kind IN ('freeform', 'fandom') THEN 0 ELSE 1 END::BIGINT AS violations FROM {_KINDS}""",
}
