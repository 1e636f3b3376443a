import pytest
from pyspark.sql import functions as F

from catalogweave.operators.merge import (
    EmbeddingMismatch,
    merge_pairs,
    replace_embeddings,
    upsert_embeddings,
    upsert_works,
)
from catalogweave.operators.quality import check_catalogue, check_dictionary
from catalogweave.schemas import CORE_SCHEMA, DICTIONARY_SCHEMA, PAIR_SCHEMA
from catalogweave.sources.embeddings import (
    as_store,
    get_embedding,
    read_embeddings,
    write_embeddings,
)


def core(spark, *rows):
    """Core rows from (fic_id, url, name, summary, kudos)."""
    full = [(i, url, name, "a", summary, 1, 1, kudos, 1, None, 9, None, None, "en", "G") for i, url, name, summary, kudos in rows]
    return spark.createDataFrame(full, CORE_SCHEMA)


def check_upsert(spark):
    old = core(spark, (1, "u1", "one", "s1", 5), (2, "u2", "two", "s2", 6))
    new = core(spark, (2, "other", "TWO", None, 0), (3, "u3", "three", None, 7))
    for keep, kudos in ((False, 0), (True, 6)):
        once = upsert_works(old, new, keep)
        got = {r.fic_id: (r.url, r.name, r.summary, r.kudos) for r in once.collect()}
        assert got == {1: ("u1", "one", "s1", 5), 2: ("u2", "TWO", "s2", kudos), 3: ("u3", "three", None, 7)}
        twice = upsert_works(once, new, keep)
        assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_upsert(spark):
    check_upsert(spark)


def test_upsert_without_broadcast(without_broadcast):
    check_upsert(without_broadcast)


def test_small_delta_leaves_the_stored_table_unshuffled(spark, tmp_path):
    stored = spark.range(300_000).select(
        F.col("id").alias("fic_id"), F.sha2(F.col("id").cast("string"), 512).alias("url"), F.lit("n").alias("name"),
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.nullable else F.lit("1").cast(f.dataType).alias(f.name)
          for f in CORE_SCHEMA.fields[3:]],
    )
    stored.write.parquet(str(tmp_path / "core"))
    old = spark.read.parquet(str(tmp_path / "core"))
    core(spark, (5, "x", "five", None, 0), (10**7, "y", "new", None, 1)).write.parquet(str(tmp_path / "new"))
    new = spark.read.parquet(str(tmp_path / "new"))
    merged = upsert_works(old, new)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert merged.count() == 300_001 and merged.where("fic_id = 5").first().name == "five"


def test_pairs_are_never_removed(spark):
    schema = "fic_id bigint, kind string, id int"
    old = spark.createDataFrame([(1, "f", 1), (1, "f", 2)], schema)
    new = spark.createDataFrame([(1, "f", 2), (1, "f", 3), (1, "f", 3)], schema)
    once = merge_pairs(old, new)
    assert sorted(r.id for r in once.collect()) == [1, 2, 3]
    assert merge_pairs(once, new).count() == 3


def vectors(spark, *rows, model="m"):
    return as_store(spark.createDataFrame(list(rows), "fic_id bigint, embedding array<double>"), model)


def test_embedding_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_embeddings(spark, path).count() == 0
    write_embeddings(replace_embeddings(vectors(spark, (1, [1.0, 2.0]), (2, [0.0, 1.0]))), path)
    stored = read_embeddings(spark, path)
    assert get_embedding(stored, 1) == [1.0, 2.0]
    with pytest.raises(KeyError):
        get_embedding(stored, 9)
    merged = upsert_embeddings(stored, vectors(spark, (2, [5.0, 5.0]), (3, [1.0, 1.0])))
    assert {r.fic_id: list(r.embedding) for r in merged.collect()} == {1: [1, 2], 2: [5, 5], 3: [1, 1]}
    assert upsert_embeddings(read_embeddings(spark, path + "-none"), vectors(spark, (1, [1.0]))).count() == 1


@pytest.mark.parametrize(
    "rows, model",
    [
        ([(2, [1.0])], "m"),
        ([(2, [1.0, 1.0])], "other"),
        ([(2, [1.0, float("nan")])], "m"),
        ([(2, [1.0, 1.0]), (2, [1.0, 2.0])], "m"),
    ],
)
def test_unsound_embeddings_are_refused(spark, rows, model):
    stored = vectors(spark, (1, [1.0, 2.0]))
    with pytest.raises(EmbeddingMismatch):
        upsert_embeddings(stored, vectors(spark, *rows, model=model))


def test_checks_count_violations(spark):
    works = core(spark, (1, "u", "n", None, 1), (1, "u", "n", None, 1))
    dictionary = spark.createDataFrame([(1, "a", "fandom"), (1, "b", "fandom")], DICTIONARY_SCHEMA)
    pairs = spark.createDataFrame([(1, 1, "fandom"), (1, 1, "fandom"), (7, 1, "fandom")], PAIR_SCHEMA)
    broken = {(r.check, r.table): r.violations for r in check_catalogue(works, dictionary, pairs).where("violations > 0").collect()}
    assert broken == {
        ("id_unique", "fics"): 1,
        ("work_exists", "fandom_join"): 1,
        ("pair_unique", "fandom_join"): 1,
        ("dictionary_id_unique", "fandom_value"): 1,
    }
    twice = spark.createDataFrame([(1, "a", "fandom"), (2, "a", "fandom"), (1, "a", "category")], DICTIONARY_SCHEMA)
    checks = check_dictionary(twice).where("violations > 0").collect()
    assert [(r.check, r.table, r.violations) for r in checks] == [("entry_unique", "fandom_value", 1)]
