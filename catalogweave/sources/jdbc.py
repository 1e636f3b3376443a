"""Relational tables through the JDBC source (the driver jar is the user's)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(
    spark: SparkSession, url: str, table: str, key: str = "fic_id", partitions: int = 64, **options
) -> DataFrame:
    """Read ``table`` in parallel ranges of ``key``; bounds come from one pushed-down query."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    low, high = (
        reader.option("dbtable", table).load().agg(F.min(key), F.max(key)).first()
    )
    if low is None:
        return reader.option("dbtable", table).load()
    return (
        reader.option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", low)
        .option("upperBound", high + 1)
        .option("numPartitions", partitions)
        .load()
    )


def write_table(frame: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    frame.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
