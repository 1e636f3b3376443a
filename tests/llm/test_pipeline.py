"""The pipeline's stages on the smallest tables: columns, decisions and invariants."""

from pyspark.sql import functions as F

import corpus_pipeline
from catalogweave.llm import secrets
from catalogweave.session import scratch_path


def test_stages(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = kept["quality"]
    assert len([i for i, r in labels.items() if r["quality"] == 1 and i in good]) >= 0.95 * sum(r["quality"] for r in labels.values())
    assert not [i for i, r in labels.items() if r["toxic"] == 0 and i in good and i not in kept["toxicity"]]
    unique = kept["near_duplicates"]
    assert set(unique) < set(kept["toxicity"]) and len(set(unique.values())) == len(unique)
    assert set(kept["toxicity"].values()) == {texts[i] for i in kept["toxicity"]}
    assert set(kept["secrets"]) == set(unique)
    before = spark.createDataFrame(list(unique.items()), "doc_id long, text string")
    holding = {r["doc_id"] for r in secrets.find_secrets(before).where("size(spans) > 0").collect()}
    assert {i for i, t in kept["secrets"].items() if t != unique[i]} == holding
    rest = spark.createDataFrame([(i, t.replace("[SECRET]", "\n")) for i, t in kept["secrets"].items()], "doc_id long, text string")
    assert secrets.find_secrets(rest).where("size(spans) > 0").count() == 0
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(unique)
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, further columns; then a table without rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = odd_docs.drop("score").unionByName(
        spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id > 100").withColumns(
            {"row": F.lit(1).cast("long"), "fp": F.lit("x")}
        )
    )
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, current, f"{tmp_path}/odd")
        assert kept.columns == docs.columns
        path = scratch_path(spark, f"odd-{name}")
        kept.write.parquet(path)
        current = spark.read.parquet(path)
    packed = corpus_pipeline.run(spark, f"{tmp_path}/odd").select("doc_id").distinct().collect()
    assert {r[0] for r in packed} == {r[0] for r in current.select("doc_id").collect()}
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.where("doc_id < 0").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
