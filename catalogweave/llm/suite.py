"""The named queries over the operators, with their SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, fingerprint, lm, merkle, packing, quality, runs, secrets, simhash, token_counts, toxicity, urls
from .common import is_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_urls(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op3_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels)
    scored = docs.select("doc_id", quality.quality_score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        is_remainder(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op4_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op5_embeddings(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_fingerprints(spark, sf_dir):
    found = fingerprint.compared_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.as_text(F.col("samples")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_samples")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "next_id",
    )


def op7_lm(spark, sf_dir):
    return lm.lm_scores(table(spark, sf_dir, "documents"), is_remainder(F.col("doc_id"), 7, 2))


def op8_bpe(spark, sf_dir):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern)
    decoded = bpe.decode(encoded, ranks, pattern)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE_RULES))

    def count(number):
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(secrets.BASE_RULES)],
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    scored = docs.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("judged"))
    return scored.select(
        "doc_id",
        F.col("judged.severity").alias("severity"),
        F.col("judged.grade").alias("grade"),
        F.when(F.col("judged.toxic") >= 0.5, 1).otherwise(0).alias("toxic"),
    )


def op11_tokens(spark, sf_dir):
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("*", (F.col("n_tokens") > 1024).alias("over_limit"))


def repeat_tail(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one in ten texts ends in a stretch of words over and over, as its key's checksum says."""
    words = F.filter(F.split("text", runs.SPACE, -1), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    start = split.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    places = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")),
    )
    edited = F.array_join(F.transform(places, lambda i: F.get("words", i)), " ")
    return start.withColumn("p", period).select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op12_runs(spark, sf_dir):
    found = runs.periodic_runs(repeat_tail(table(spark, sf_dir, "documents")))
    # Greatest exact length / period first, by cross-multiplication; ties by start, then period.
    ranked = F.expr(
        """array_sort(runs, (a, b) -> CASE
            WHEN a.length * b.period <> b.length * a.period THEN IF(a.length * b.period > b.length * a.period, -1, 1)
            WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1)
            WHEN a.period <> b.period THEN IF(a.period < b.period, -1, 1) ELSE 0 END)"""
    )
    best = F.get(ranked, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(is_remainder(F.col("doc_id"), 2, 0), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = merkle.build_manifest(
        docs, "source", "doc_id", merkle.leaf_digest(*rest, F.col("text")), {"claimed": merkle.leaf_digest(*rest, tampered)}
    )
    siblings = F.zip_with("left", "right", lambda left, right: F.concat(left, right))
    found = merkle.proofs(manifest)
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        merkle.folded(F.col("claimed"), F.col("left"), F.col("right")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_urls": op2_urls,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_embeddings": op5_embeddings,
    "op6_fingerprints": op6_fingerprints,
    "op7_lm": op7_lm,
    "op8_bpe": op8_bpe,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "op11_tokens": op11_tokens,
    "op12_runs": op12_runs,
    "op13_merkle": op13_merkle,
}
ORACLES = {}
