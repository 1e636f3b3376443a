import random

import pytest
from pyspark.sql import functions as F

from catalogweave.operators.joins import absent_rows, fits_broadcast, hot_keys, lookup_join
from catalogweave.operators.normalize import (
    assign_ids,
    build_vocabulary,
    count_duplicates,
    dedupe_first,
    encode_tags,
    explode_tags,
    lookup_and_pairs,
    unknown_tags,
)
from catalogweave.operators.embed import embed_texts
from catalogweave.operators.ranges import with_cumulative, with_position
from catalogweave.session import pin, staged


def test_positions_are_global_and_dense(spark):
    values = [f"v{random.Random(i).randrange(10**6):06d}" for i in range(5000)]
    frame = spark.createDataFrame([(v,) for v in set(values)], "value string").repartition(7)
    got = with_position(frame, ["value"]).orderBy("value").collect()
    assert [r.position for r in got] == list(range(len(got)))


def test_cumulative_weights(spark):
    frame = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), (F.col("id") % 5).alias("n")).repartition(6)
    total = 0
    for r in with_cumulative(frame, ["v"], "n").orderBy("v").collect():
        assert r.position == total
        total += r.n


def test_ids_are_stable_and_continue(spark):
    first = spark.createDataFrame([("a", "m"), ("a", "c"), ("b", "z"), ("a", "m")], "kind string, value string")
    ids = assign_ids(first)
    assert sorted(map(tuple, ids.collect())) == [("a", 1, "c"), ("a", 2, "m"), ("b", 1, "z")]
    second = spark.createDataFrame([("a", "A"), ("a", "m"), ("c", "é"), ("c", "e")], "kind string, value string")
    assert sorted(map(tuple, assign_ids(second, ids).collect())) == [("a", 3, "A"), ("c", 1, "e"), ("c", 2, "é")]


def test_vocabulary_sorts_by_code_point(spark):
    frame = spark.createDataFrame([(["b", "Z", "é"],), (None,), ([],), (["😀", "￿", "b"],)], "items array<string>")
    values = [r.value for r in build_vocabulary(frame, "items").collect()]
    assert values == sorted({"b", "Z", "é", "😀", "￿"})


def test_lookup_and_pairs_with_empty_column(spark):
    works = spark.createDataFrame([(1, ["x", "y", "x"]), (2, [])], "fic_id bigint, fandom array<string>")
    dictionary, pairs = lookup_and_pairs(works, "fandom")
    assert sorted(map(tuple, dictionary.collect())) == [(1, "x"), (2, "y")]
    assert list(map(tuple, pairs.collect())) == [(1, 1), (1, 2)]
    dictionary, pairs = lookup_and_pairs(works.where("fic_id = 2"), "fandom")
    assert dictionary.count() == 0 and pairs.count() == 0


def hot_tags(spark):
    """A third of all rows carry one tag."""
    rare = spark.range(4000).select("id", F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("value"))
    hot = spark.range(2000).select("id", F.lit("hot").alias("value"))
    return rare.union(hot).select(F.col("id").alias("fic_id"), F.lit("freeform").alias("kind"), "value")


def test_hot_key_is_salted_and_nothing_is_lost(without_broadcast):
    tags = hot_tags(without_broadcast)
    assert [r.value for r in hot_keys(tags, ["kind", "value"], 8).collect()] == ["hot"]
    dictionary = assign_ids(tags)
    joined = lookup_join(tags, dictionary, ["kind", "value"])
    assert "salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 6000 and joined.where("value = 'hot'").select("id").distinct().count() == 1
    assert encode_tags(tags, dictionary).count() == tags.distinct().count()
    assert unknown_tags(tags, dictionary.where("value <> 'hot'")).collect()[0].value == "hot"


def test_broadcast_only_for_known_sizes(spark):
    small = spark.range(10)
    assert fits_broadcast(small)
    assert not fits_broadcast(small.select(F.explode(F.sequence(F.lit(0), F.col("id"))).alias("id")))
    assert not fits_broadcast(spark.range(10**9))


@pytest.mark.parametrize("big_old", [True, False])
def test_absent_rows(spark, big_old):
    old = spark.range(0, 10**7 if big_old else 50, 2)
    assert sorted(r.id for r in absent_rows(spark.range(10), old, ["id"]).collect()) == [1, 3, 5, 7, 9]


def test_dedupe_first_limits_groups_before_the_shuffle(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 300, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    first = dedupe_first(rows.repartition(5), ["k"], ["id"])
    assert first.count() == 601 and first.where("k = 1").first().id == 0
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_count_duplicates_with_nulls(spark):
    frame = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k int")
    assert count_duplicates(frame, "k").first().duplicates == 2


def test_explode_tags_drops_repeats_inside_a_work(spark):
    works = spark.createDataFrame([(1, ["a", "a"], None)], "fic_id bigint, fandom array<string>, warning array<string>")
    assert list(map(tuple, explode_tags(works, ["fandom", "warning"]).collect())) == [(1, "fandom", "a")]


def test_checkpointed_frames_are_never_judged_small(spark):
    """A checkpoint hides the exploding node below it and keeps the estimate from before."""
    grown = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(2_999_999))).alias("id"))
    assert not fits_broadcast(grown) and not fits_broadcast(pin(grown))
    assert fits_broadcast(staged(spark.range(10).toDF("id"), "small"))
    assert not fits_broadcast(staged(grown, "grown"))


def test_encoder_is_built_once_per_worker(spark):
    """Many tasks on few workers: constructions are counted through the vectors themselves."""

    class Counting:
        made = 0

        def __init__(self):
            import os

            type(self).made += 1
            self.mark = (float(os.getpid()), float(type(self).made))

        def __call__(self, texts):
            return [self.mark for _ in texts]

    texts = spark.range(400).select(F.col("id").alias("fic_id"), F.lit("x").alias("summary")).repartition(40)
    rows = [tuple(r.embedding) for r in embed_texts(texts, Counting).collect()]
    by_worker = {}
    for worker, number in rows:
        by_worker.setdefault(worker, set()).add(number)
    assert all(numbers == {1.0} for numbers in by_worker.values())
