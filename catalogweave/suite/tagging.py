"""Vocabularies, ids, pairs and embeddings of texts."""

from pyspark.sql import functions as F

from ..functions.text import vector_prefix
from ..operators.embed import HashedTokenEncoder, embed_texts
from ..operators.normalize import assign_ids, build_vocabulary, count_tags, encode_tags, lookup_and_pairs
from ..plans.embed import embed_works
from ..session import scratch_path, spread
from ..sources.embeddings import as_store, read_embeddings, write_embeddings
from .inputs import part_words, table, vectors


def document_tokens(spark, sf_dir):
    """(fic_id, kind, value): the tokens of each document, its language as the kind."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    tokens = F.explode(F.split(F.trim("text"), r"\s+"))
    return documents.select(F.col("doc_id").alias("fic_id"), F.col("lang").alias("kind"), tokens.alias("value"))


def vocabulary(spark, sf_dir):
    return build_vocabulary(part_words(spark, sf_dir), "words")


def vocabulary_ids(spark, sf_dir):
    return assign_ids(document_tokens(spark, sf_dir))


def encoded_pairs(spark, sf_dir):
    tokens = document_tokens(spark, sf_dir)
    counts = count_tags(tokens)
    return encode_tags(tokens, assign_ids(counts), counts)


def part_lookup(spark, sf_dir):
    works = part_words(spark, sf_dir).withColumnRenamed("words", "freeform")
    dictionary, pairs = lookup_and_pairs(works, "freeform")
    return pairs.join(dictionary, "id").select("fic_id", F.col("id").alias("freeform_id"), F.col("value").alias("freeform"))


def _summary(store):
    total = F.aggregate(
        F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x
    )
    prefix = F.transform(
        vector_prefix(F.col("embedding"), 5), lambda x: F.format_string("%.5f", x.cast("double") + F.lit(0.0))
    )
    return store.select(
        "fic_id",
        F.size("embedding").alias("dim"),
        F.round(total, 4).alias("norm"),
        F.array_join(prefix, " ").alias("prefix"),
    )


def embedded_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fic_id"), F.col("text").alias("summary"))
    return _summary(embed_works(documents))


def store_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "store")
    write_embeddings(as_store(vectors(spark, sf_dir), "given"), path)
    stored = read_embeddings(spark, path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return stored.select("fic_id", "model_name", "dim", F.round(total, 5).alias("total"))


def embedded_questions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    keyed = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("fic_id"), F.col("text").alias("summary"))
    return _summary(embed_texts(keyed, lambda: HashedTokenEncoder(16)))


QUERIES = {
    "build_vocabulary": vocabulary,
    "vocabulary_ids": vocabulary_ids,
    "encode_pairs": encoded_pairs,
    "lookup_and_pairs": part_lookup,
    "embed_text": embedded_documents,
    "embed_text_small": embedded_questions,
    "embedding_store_roundtrip": store_roundtrip,
}

_TOKENS = r"""
tokens AS (SELECT doc_id AS fic_id, lang AS kind, unnest(string_split_regex(trim(text), '\s+')) AS value FROM documents),
dictionary AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value)::INT AS id
               FROM (SELECT DISTINCT kind, value FROM tokens))
"""


def _embedding_sql(rows, dim):
    """Signed token hashes, L2-normalised, from (fic_id, text) rows."""
    return rf"""
    WITH rows AS ({rows}),
    token AS (SELECT fic_id, md5(unnest(string_split_regex(trim(text), '\s+'))) AS h FROM rows),
    slot AS (SELECT fic_id, ('0x' || h[1:8])::BIGINT % {dim} AS slot,
                    sum(CASE WHEN h[9] < '8' THEN 1 ELSE -1 END)::DOUBLE AS w FROM token GROUP BY 1, 2),
    norm AS (SELECT fic_id, sqrt(sum(w * w)) AS n FROM slot GROUP BY 1),
    cell AS (SELECT rows.fic_id, s.i, coalesce(max(slot.w), 0) AS w
             FROM rows CROSS JOIN (SELECT unnest(range(0, 5)) AS i) s
             LEFT JOIN slot ON slot.fic_id = rows.fic_id AND slot.slot = s.i GROUP BY 1, 2)
    SELECT c.fic_id, {dim} AS dim, CASE WHEN any_value(n) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm,
           string_agg(printf('%.5f', CASE WHEN n > 0 THEN (w / n)::FLOAT::DOUBLE ELSE 0.0 END + 0.0), ' ' ORDER BY i) AS prefix
    FROM cell c LEFT JOIN norm ON norm.fic_id = c.fic_id GROUP BY c.fic_id"""


ORACLES = {
    "build_vocabulary": "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part",
    "vocabulary_ids": f"WITH {_TOKENS} SELECT kind, id, value FROM dictionary",
    "encode_pairs": f"""WITH {_TOKENS} SELECT DISTINCT t.fic_id, t.kind, d.id
        FROM tokens t JOIN dictionary d ON d.kind = t.kind AND d.value = t.value""",
    "lookup_and_pairs": """
        WITH words AS (SELECT DISTINCT p_partkey AS fic_id, unnest(string_split(p_name, ' ')) AS freeform FROM part)
        SELECT fic_id, dense_rank() OVER (ORDER BY freeform)::INT AS freeform_id, freeform FROM words""",
    "embed_text": _embedding_sql("SELECT doc_id AS fic_id, text FROM documents", 64),
    "embed_text_small": _embedding_sql(
        "SELECT conv_id * 1000 + turn AS fic_id, text FROM conversations", 16
    ),
    "embedding_store_roundtrip": """
        SELECT vec_id AS fic_id, 'given' AS model_name, len(embedding)::INT AS dim,
               round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings""",
}
