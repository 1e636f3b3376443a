"""Exact quantiles by selection: value ranges are narrowed by counting, values are never sorted or shuffled.

A wanted rank starts with all values of its column. Each pass counts the values of the range
per bin, with at most ``BINS`` bins a range, and keeps the bin that the rank falls into, until
that bin holds one distinct value. The bins of the first pass are powers of two (signed), so
that the later ones, of equal width, need few passes whatever the distribution: a double has
52 bits below its exponent and every pass settles about eleven of them.

All that is shuffled are the counts, at most ``BINS`` per range and task, and all that reaches
the driver is one row per wanted rank and pass.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

BINS = 2048
_EXPONENTS = 1100  # the smallest double is about 2 ** -1074


def _signed_exponent(value: Column) -> Column:
    """A whole number that never falls as the value grows: sign and power of two; infinity, then NaN last."""
    size = F.least(F.log2(F.abs(value)), F.lit(float(_EXPONENTS)))
    step = F.floor(size) + 2 * _EXPONENTS
    plain = F.when(value > 0, step).when(value < 0, -step).otherwise(F.lit(0))
    return F.when(F.isnan(value), F.lit(8 * _EXPONENTS)).otherwise(plain).cast("int")


def _equal_width(value: Column, low: float, high: float) -> Column:
    """Bin of a value of the range [low, high] between two powers of two; rounding shifts borders, never the order."""
    step = (high - low) / BINS
    if step == 0:  # the smallest numbers there are: halve the range
        return (value > low + (high - low) / 2).cast("int")
    return F.floor((value - low) / F.lit(step)).cast("int")


def _bins_of(column: str, ranges, first: bool) -> Column:
    """Structs (range, bin) of one column's value: null outside its ranges, which do not overlap."""
    value = F.col("value")
    if first:
        return F.struct(F.lit(0).alias("range"), _signed_exponent(value).alias("bin"))
    chosen = F
    for at, (low, high) in ranges:
        cell = F.struct(F.lit(at).alias("range"), _equal_width(value, low, high).alias("bin"))
        chosen = chosen.when((value >= low) & (value <= high), cell)
    return chosen


def _count_bins(rows: DataFrame, ranges: dict, first: bool) -> DataFrame:
    """(column, range, bin, n, low, high, before): counts and extremes of each bin, and the values below it."""
    cells = [(F.col("column") == c, _bins_of(c, ranges[c], first)) for c in ranges if ranges[c]]
    cell = reduce(lambda made, pair: made.when(*pair), cells, F)
    counted = (
        rows.select("column", "value", "n", cell.alias("cell"))
        .where("cell is not null")
        .groupBy("column", "cell.range", "cell.bin")
        .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    earlier = Window.partitionBy("column", "range").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def selected_quantiles(rows: DataFrame, shares) -> DataFrame:
    """(column, share, value): quantiles of (column, value, n) rows, interpolated between neighbouring ranks.

    ``n`` is how often the value counts; a value may come in several rows. Null values and
    columns without any other are left out, and NaN is the largest value. Rows are staged
    once, and read once a pass.
    """
    spark = rows.sparkSession
    rows = staged(rows.where("value is not null").select("column", "value", "n"), "values")
    totals = {r["column"]: r["total"] for r in rows.groupBy("column").agg(F.sum("n").alias("total")).collect()}
    # (column, rank) -> [rank inside the range, range]; a found rank leaves for ``values``.
    wanted, values = {}, {}
    for column, total in totals.items():
        for share in shares:
            place = share * (total - 1)
            for rank in {int(place), min(int(place) + 1, total - 1)}:
                wanted[column, rank] = [rank, None]
    first = True
    while wanted:
        borders = sorted({(c, at) for (c, _), (_, at) in wanted.items()}, key=str)
        number = {border: k for k, border in enumerate(borders)}
        ranges = {c: [(number[b], b[1]) for b in borders if b[0] == c] for c in totals}
        ask = [(c, rank, inside, 0 if first else number[c, at]) for (c, rank), (inside, at) in wanted.items()]
        asked = spark.createDataFrame(ask, "column string, rank long, inside long, range int")
        inside = (F.col("inside") >= F.col("before")) & (F.col("inside") < F.col("before") + F.col("n"))
        # One row per wanted rank: columns x shares x 2 at most.
        bins = _count_bins(rows, ranges, first)
        hits = bins.join(F.broadcast(asked), ["column", "range"]).where(inside).collect()
        for r in hits:
            key, low, high = (r["column"], r["rank"]), r["low"], r["high"]
            if low == high or low != low:
                values[key] = low
                del wanted[key]
            else:
                wanted[key] = [r["inside"] - r["before"], (low, high)]
        first = False
    found = []
    for column, total in totals.items():
        for share in shares:
            place = share * (total - 1)
            below, above = values[column, int(place)], values[column, min(int(place) + 1, total - 1)]
            part = place - int(place)
            found.append((column, float(share), below if part == 0 or below == above else below + (above - below) * part))
    return spark.createDataFrame(found, "column string, share double, value double")
