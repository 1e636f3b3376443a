"""A corpus pipeline over ``documents``: filter, deduplicate, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to
the shared folder and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``. A lost executor costs tasks of one stage only.

Defined results, for every stage: a null text counts as an empty one; rows without an id are rows
like any other; repeated rows are judged alike, and only the near-duplicate stage drops any of them;
further columns of ``documents`` are kept untouched, whatever their names; an empty table gives an empty
table. A very long text is judged, scanned and packed whole.
"""

import public_tokenizers
from pyspark.sql import functions as F

from catalogweave.llm import packing, quality, secrets, simhash, toxicity
from catalogweave.session import scratch_path

TOXIC = 0.5


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark, docs, sf_dir):
    """Documents that the quality classifier accepts; an empty text is scored like any other."""
    model = quality.fit_quality(docs, _labels(spark, sf_dir))
    return docs.where(quality.quality_score(F.col("text"), model) >= quality.THRESHOLD)


def drop_toxic(spark, docs, sf_dir):
    """Documents that are likelier clean than of any severity grade; a text without words has no toxic features."""
    model = toxicity.fit_toxicity(docs, _labels(spark, sf_dir))
    return docs.where(toxicity.toxicity(F.col("text"), model)["toxic"] < TOXIC)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group that SimHash links (``op1_simhash``'s shingles and distance): the smallest id.

    Texts without words are one group. A row without an id stays only where its whole group lacks one.
    """
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark, docs, sf_dir):
    """Secrets in the text give way to a mark; ``n_chars`` follows (null for a null text)."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack_documents(spark, docs, sf_dir):
    """Pieces of the documents' tokens, packed into sequences; a document without text is its end token."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]
# Classifiers, fingerprints and tokenizers are beyond SQL; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
