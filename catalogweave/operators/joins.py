"""Join helpers that check sizes before broadcasting and split hot keys otherwise."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_limit, estimated_bytes, plan_text


# Plan nodes whose output may be larger than Catalyst's estimate for them. LogicalRDD is a
# checkpointed frame: it keeps the estimate of the plan it was cut from and hides that plan.
GROWING_NODES = ("Generate ", "MapInPandas", "MapInArrow", "FlatMapGroups", "FlatMapCoGroups", "LogicalRDD")


def fits_broadcast(frame: DataFrame) -> bool:
    """True when the frame is known to stay within Spark's broadcast limit.

    Catalyst's estimate bounds scans, filters, projections, aggregates and joins
    from above. It says nothing about nodes that can multiply rows, so a plan
    with one of those never counts as small.
    """
    plan = plan_text(frame)
    if any(node in plan for node in GROWING_NODES):
        return False
    return 0 <= estimated_bytes(frame) <= broadcast_limit(frame.sparkSession)


def absent_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``.

    When ``new`` is small, the (large) old side is only filtered down to the
    keys in question and never shuffled; otherwise one anti-join does it.
    """
    old_keys = old.select(*keys)
    if fits_broadcast(new) and not fits_broadcast(old):
        old_keys = old_keys.join(F.broadcast(new.select(*keys)), keys, "left_semi")
    return new.join(old_keys, keys, "left_anti")


def hot_keys(facts: DataFrame, keys: list[str], partitions: int, counts: DataFrame | None = None) -> DataFrame:
    """Keys holding more than 1/(4 x partitions) of all rows: fewer than 4 x partitions of them.

    ``counts`` (keys and n), where a caller has them stored, save counting the facts again.
    """
    if counts is None:
        counts = facts.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col("n") * F.lit(4 * partitions) > total).select(*keys)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    partitions: int | None = None,
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join of a fact table to a lookup table that is unique on ``keys``.

    A lookup table within Spark's broadcast limit is broadcast. A larger one is
    joined by shuffle, with the hot keys spread over ``partitions`` salts: their
    few lookup rows are repeated per salt, their many facts are divided among
    the salts. The hot keys are few by construction, see ``hot_keys``, so they
    are fetched and used as a literal table; without any the join is plain.
    """
    if fits_broadcast(lookup):
        return facts.join(F.broadcast(lookup), keys, how)
    spark = facts.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = hot_keys(facts, keys, partitions, counts)
    rows = found.collect()
    if not rows:
        return facts.join(lookup, keys, how)
    hot = F.broadcast(spark.createDataFrame(rows, found.schema).withColumn("is_hot", F.lit(True)))
    is_hot = F.coalesce(F.col("is_hot"), F.lit(False))
    salt = F.pmod(F.xxhash64(*facts.columns), F.lit(partitions)).cast("int")
    left = facts.join(hot, keys, "left").select(
        *facts.columns, F.when(is_hot, salt).otherwise(F.lit(0)).alias("salt")
    )
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(partitions - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.join(hot, keys, "left").select(*lookup.columns, F.explode(salts).alias("salt"))
    return left.join(right, [*keys, "salt"], how).drop("salt")
