"""Global positions without a single-partition window.

Rows are range-partitioned and sorted once; each partition then needs one number,
the total weight of the partitions before it. The ranged rows are staged in
between, because recomputing them could move the range boundaries.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: position in its partition


def with_position(frame: DataFrame, order: list[str]) -> DataFrame:
    """Add ``position``: the number of rows before this one in the given order."""
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    local = ranged.select(
        *frame.columns,
        F.spark_partition_id().alias("pid"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("before"),
    )
    return _add_offsets(staged(local, "ranged"), F.count("*"), frame.columns)


def with_cumulative(frame: DataFrame, order: list[str], weight: str) -> DataFrame:
    """Add ``position``: the total ``weight`` of the rows before this one in the given order."""

    def running(batches):
        total = 0
        for batch in batches:
            sums = batch[weight].cumsum() + total
            yield batch.assign(before=sums - batch[weight])
            total = int(sums.iloc[-1]) if len(batch) else total

    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    keyed = ranged.select(*frame.columns, F.spark_partition_id().alias("pid"))
    schema = T.StructType([*keyed.schema.fields, T.StructField("before", T.LongType())])
    return _add_offsets(staged(keyed.mapInPandas(running, schema), "ranged"), F.sum(weight), frame.columns)


def _add_offsets(local: DataFrame, size, columns) -> DataFrame:
    sizes = local.groupBy("pid").agg(size.alias("n"))
    # One row per range partition, so this window is bounded by the partition count.
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    joined = local.join(F.broadcast(starts), "pid")
    return joined.select(*columns, (F.col("start") + F.col("before")).alias("position"))
