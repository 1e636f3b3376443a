"""Works with similar tag sets, for all works at once: an exact set-similarity join.

Equal sets are one class, named by its smallest id, and only classes are compared. Tags are
ordered from rare to frequent. Two sets of a Jaccard similarity of t or more share at least
ceil(t x size) tags, for the size of either, so the k rarest tags they share lie among the
first size - ceil(t x size) + k tags of both, for every k up to that number. Classes meet by
the rarest shared tag. Where more than ``CROWDED`` classes would meet by one tag, only those
it alone proves similar are paired; the others meet again by that tag and the next rarest
they share. A pair is made once, by its rarest shared tags, and only where the sizes and the
tags that are left allow the similarity. No group is cut, and every pair is verified on the
whole sets. Groups that meet by ``MOST_TAGS`` tags are compared as they are: a further tag
would separate near copies no better, and cost a row for every choice of tags.

Empty sets equal each other (1.0) and are similar to nothing else, so they are one class.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import jaccard_from_counts
from ..session import staged

CROWDED = 256
MOST_TAGS = 2
_SLACK = 1e-9  # products like 0.7 x 10 may come out a hair too large


def set_classes(sets: DataFrame) -> DataFrame:
    """(fic_id, class_id): the smallest id with the same set of ``values``. Null sets are empty, null values left out."""
    own = _plain(sets)
    names = own.groupBy("values").agg(F.min("fic_id").alias("class_id"))
    return own.join(names, "values").select("fic_id", "class_id")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, shared, jaccard): all pairs of classes with a similarity of ``threshold`` or more.

    ``sets`` is (fic_id, values); the ids are the classes' smallest, left_id < right_id.
    """
    ordered = ordered_sets(sets)
    return _verified(candidate_pairs(ordered, threshold), ordered, threshold)


def _plain(sets: DataFrame) -> DataFrame:
    values = F.coalesce(F.array_sort(F.array_distinct(F.array_compact("values"))), F.array().cast("array<string>"))
    return sets.where("fic_id is not null").select("fic_id", values.alias("values"))


def ordered_sets(sets: DataFrame) -> DataFrame:
    """(class_id, size, tags): every different set that is not empty, its tags from rare to frequent."""
    classes = _plain(sets).groupBy("values").agg(F.min("fic_id").alias("class_id"))
    tags = classes.select("class_id", F.explode("values").alias("tag"))
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    listed = tags.join(counts, "tag").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "tag"))).alias("listed"))
    return staged(listed.select("class_id", F.size("listed").alias("size"), F.col("listed.tag").alias("tags")), "ordered-sets")


def _needed(size: Column, threshold: float) -> Column:
    """Tags that a set of this size shares with any similar set, at least."""
    return F.greatest(F.ceil(size * threshold - _SLACK), F.lit(1)).cast("int")


def candidate_pairs(ordered: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id): different classes that share tags so rare that they may be similar; no similar pair is missing."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold has to be above 0 and at most 1")
    need = _needed(F.col("size"), threshold)
    first = F.slice("tags", F.lit(1), F.col("size") - need + 1)
    entries = ordered.select("class_id", "size", need.alias("need"), "tags", F.posexplode(first).alias("at", "tag"))
    entries = _meetings(entries, F.xxhash64("tag"))
    found = []
    for level in range(1, MOST_TAGS + 1):
        entries = staged(entries, "meetings")
        crowds = entries.groupBy("meeting").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED)
        crowds = staged(crowds.select("meeting", F.lit(True).alias("crowded")), "crowds")
        if level == MOST_TAGS or crowds.isEmpty():
            found.append(_pairs(entries, threshold, level))
            break
        marked = staged(entries.join(crowds, "meeting", "left"), "marked")
        found.append(_pairs(marked.where("crowded is null"), threshold, level))
        crowd = marked.where("crowded")
        found.append(_proven(crowd.where(F.col("need") <= level), threshold, level))
        last = F.least(F.col("size"), F.col("size") - F.col("need") + level + 1)
        further = F.slice("tags", F.col("at") + 2, F.greatest(last - F.col("at") - 1, F.lit(0)))
        longer = crowd.select("class_id", "size", "need", "at", "meeting").join(ordered.select("class_id", "tags"), "class_id")
        longer = longer.select("class_id", "size", "need", "tags", "meeting", F.col("at").alias("from"), F.posexplode(further).alias("step", "tag"))
        entries = _meetings(longer.withColumn("at", F.col("from") + 1 + F.col("step")), F.xxhash64("meeting", "tag"))
    return reduce(DataFrame.unionByName, found).distinct()


def _meetings(entries: DataFrame, meeting: Column) -> DataFrame:
    rarer = F.slice("tags", F.lit(1), F.col("at"))
    return entries.select("class_id", "size", "need", "at", rarer.alias("rarer"), meeting.alias("meeting"))


def _pairs(entries: DataFrame, threshold: float, level: int) -> DataFrame:
    """Pairs that meet by the ``level`` rarest tags they share, whose sizes and remaining tags allow the similarity."""
    a, b = entries.alias("a"), entries.alias("b")
    meet = (F.col("a.meeting") == F.col("b.meeting")) & (F.col("a.class_id") < F.col("b.class_id"))
    rest = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) - 1
    enough = rest + level >= (F.col("a.size") + F.col("b.size")) * (threshold / (1 + threshold)) - _SLACK
    rarest = F.size(F.array_intersect("a.rarer", "b.rarer")) == level - 1
    return a.join(b, meet & enough & rarest).select(F.col("a.class_id").alias("left_id"), F.col("b.class_id").alias("right_id"))


def _proven(entries: DataFrame, threshold: float, level: int) -> DataFrame:
    """Pairs of a crowd for which ``level`` shared tags suffice; they meet by the smaller one's size too, so all are results."""
    most = F.floor(level * (1 + threshold) / threshold - F.col("size") + _SLACK).cast("int")
    sizes = F.when(F.least("size", most) >= level, F.sequence(F.lit(level), F.least("size", most)))
    a = entries.select("class_id", "size", "meeting", F.explode(sizes).alias("other")).alias("a")
    b = entries.select("class_id", "size", "meeting").alias("b")
    meet = (F.col("a.meeting") == F.col("b.meeting")) & (F.col("a.other") == F.col("b.size"))
    once = (F.col("a.size") > F.col("b.size")) | (F.col("a.class_id") < F.col("b.class_id"))
    return a.join(b, meet & once).select(F.least("a.class_id", "b.class_id").alias("left_id"), F.greatest("a.class_id", "b.class_id").alias("right_id"))


def _verified(pairs: DataFrame, ordered: DataFrame, threshold: float) -> DataFrame:
    left = ordered.select(F.col("class_id").alias("left_id"), F.col("size").alias("left_size"), F.col("tags").alias("left_tags"))
    right = ordered.select(F.col("class_id").alias("right_id"), F.col("size").alias("right_size"), F.col("tags").alias("right_tags"))
    shared = F.size(F.array_intersect("left_tags", "right_tags"))
    met = pairs.join(left, "left_id").join(right, "right_id").withColumn("shared", shared)
    jaccard = jaccard_from_counts(F.col("shared"), F.col("left_size"), F.col("right_size"))
    return met.select("left_id", "right_id", "shared", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)
