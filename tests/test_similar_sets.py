"""The set-similarity join against a comparison of all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from catalogweave.operators import similar_sets as module
from catalogweave.operators.similar_sets import candidate_pairs, ordered_sets, set_classes, similar_sets


def brute(works, threshold):
    """Pairs of classes, and the class of each id."""
    names = {}
    for key, tags in sorted(works):
        names.setdefault(frozenset(t for t in tags or () if t is not None), key)
    pairs = set()
    for (a, x), (b, y) in combinations(names.items(), 2):
        if a and b and len(a & b) / len(a | b) >= threshold:
            pairs.add((min(x, y), max(x, y), len(a & b), round(len(a & b) / len(a | b), 9)))
    return pairs, {key: names[frozenset(t for t in tags or () if t is not None)] for key, tags in works}


@pytest.fixture(scope="module")
def works():
    """Skewed tags (one in most sets), near copies, copies, subsets, empty and null sets."""
    chance = random.Random(2)
    sets = [["hot", *(f"t{int(40 * chance.random() ** 3)}" for _ in range(chance.randrange(0, 7)))] for _ in range(260)]
    sets += [[t for t in chance.choice(sets) if chance.random() < 0.8] + chance.sample(["u", "v", "w"], chance.randrange(2)) for _ in range(160)]
    sets += [["hot"]] * 40 + [[]] * 5 + [None, [None], ["u", None, "u"]]
    long = [f"l{k}" for k in range(30)]
    sets += [long, long[:-3], long[3:], [*long, "x"]]
    return list(enumerate(sets))


@pytest.mark.parametrize("crowded", [256, 8, 1])
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_equals_comparison_of_all(spark, works, monkeypatch, crowded, threshold):
    monkeypatch.setattr(module, "CROWDED", crowded)
    frame = spark.createDataFrame(works, "fic_id long, values array<string>").repartition(4)
    want, _ = brute(works, threshold)
    got = similar_sets(frame, threshold).collect()
    assert len(got) == len(want) and {(r[0], r[1], r[2], round(r[3], 9)) for r in got} == want


def test_classes(spark, works):
    frame = spark.createDataFrame(works, "fic_id long, values array<string>")
    assert {r["fic_id"]: r["class_id"] for r in set_classes(frame).collect()} == brute(works, 1)[1]
    assert set_classes(frame.limit(0)).count() == 0 and similar_sets(frame.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        similar_sets(frame, 0)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_a_hot_tag_pairs_nothing(spark, threshold):
    """All sets hold two hot tags, a third of them three, and nothing else in common."""
    words = [F.lit("hot"), F.lit("hotter"), F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id")]
    words.append(F.when(F.col("id") % 3 == 0, F.lit("warm")))
    sets = spark.range(6000).select(F.col("id").alias("fic_id"), F.array(*words).alias("values"))
    assert candidate_pairs(ordered_sets(sets), threshold).count() == 0


def test_a_crowd_of_near_copies(spark):
    """Six hundred sets of thirty tags that differ in one: every pair is a result, and found once."""
    common = [F.lit(f"c{k:02d}") for k in range(29)]
    sets = spark.range(600).select(F.col("id").alias("fic_id"), F.array(*common, F.concat(F.lit("x"), "id")).alias("values"))
    assert similar_sets(sets, 0.9).count() == 600 * 599 // 2
