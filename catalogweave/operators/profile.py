"""Column profiles of a raw or cleaned frame.

Each figure has a function of its own, which scans the frame once. ``profile`` makes all of
them together from three scans: one aggregate, one count of values, one for samples.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from .selection import selected_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def _unpivot(frame: DataFrame, columns, cast: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns]
    return frame.select(F.inline(F.array(*cells)))


def _wide_to_rows(one_row: DataFrame, columns, figures) -> DataFrame:
    """Rows (column, figures...) from a single row holding ``<column>|<figure>`` fields."""
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{f}`").alias(f) for f in figures])
        for c in columns
    ]
    return one_row.select(F.inline(F.array(*cells)))


def profile_nulls(frame: DataFrame) -> DataFrame:
    """(column, nulls), most nulls first."""
    counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}|nulls") for c in frame.columns])
    return _wide_to_rows(counts, frame.columns, ["nulls"]).orderBy(F.desc("nulls"), "column")


def numeric_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)]


def exact_quantiles(frame: DataFrame, columns, shares=QUARTILES) -> DataFrame:
    """(column, share, value) with linear interpolation between neighbouring ranks.

    Values are neither sorted nor shuffled, see ``selected_quantiles``.
    """
    return selected_quantiles(_unpivot(frame, columns, "double").withColumn("n", F.lit(1)), shares)


def profile_numeric(frame: DataFrame, columns=None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    columns = list(columns or numeric_columns(frame))
    return _numeric(frame.agg(*_moments(columns)), exact_quantiles(frame, columns), columns)


_FIGURES = {
    "count": F.count,
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
}


def _moments(columns) -> list:
    return [f(c).alias(f"{c}|{name}") for c in columns for name, f in _FIGURES.items()]


def _numeric(one_row: DataFrame, quantiles: DataFrame, columns) -> DataFrame:
    moments = _wide_to_rows(one_row, columns, _FIGURES)
    quartiles = quantiles.groupBy("column").agg(
        *[
            F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"p{round(s * 100)}")
            for s in QUARTILES
        ]
    )
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def profile_values(frame: DataFrame, column: str) -> DataFrame:
    """(value, n) including NULL, most frequent first."""
    counts = frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value")


def profile_shape(frame: DataFrame) -> DataFrame:
    """(item, detail): row and column counts, then each column with its type."""
    return _shape(frame.agg(F.count("*").alias("n")), frame.schema)


def _shape(one_row: DataFrame, schema) -> DataFrame:
    types = [
        F.struct(F.lit(f"column {f.name}").alias("item"), F.lit(f.dataType.simpleString()).alias("detail"))
        for f in schema.fields
    ]
    columns = F.struct(F.lit("columns").alias("item"), F.lit(str(len(schema.fields))).alias("detail"))
    rows = F.struct(F.lit("rows").alias("item"), F.col("n").cast("string").alias("detail"))
    return one_row.select(F.inline(F.array(rows, columns, *types)))


def _counted_values(frame: DataFrame, numbers, others) -> DataFrame:
    """(column, number, text, n): every value of the given columns counted, in one pass.

    ``text`` is set for the columns of ``others``, ``number`` for numeric columns.
    """
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("number"),
            (F.col(c).cast("string") if c in others else F.lit(None).cast("string")).alias("text"),
        )
        for c in dict.fromkeys([*numbers, *others])
    ]
    if not cells:
        return frame.sparkSession.createDataFrame([], "column string, number double, text string, n bigint")
    long = frame.select(F.inline(F.array(*cells)))
    return long.groupBy("column", "number", "text").agg(F.count("*").alias("n"))


def profile_samples(frame: DataFrame, columns, order, size: int = 3) -> DataFrame:
    """(column, place, value): the first non-NULL values of each column in row order.

    Each map task passes on at most ``size`` rows per column.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = frame.select(*order, F.inline(F.array(*cells))).where("value is not null")
    window = Window.partitionBy("column").orderBy(*order)
    placed = long.withColumn("place", F.row_number().over(window)).where(F.col("place") <= size)
    return placed.select("column", "place", "value")


def preview(frame: DataFrame, order, size: int) -> DataFrame:
    """The first rows in a stated order."""
    return frame.orderBy(*order).limit(size)


def profile(frame: DataFrame, order, value_columns=(), sample_columns=()) -> DataFrame:
    """All profile figures of a frame as (section, item, detail)."""

    def text(c, decimals=6):
        return F.format_string(f"%.{decimals}f", F.col(c))

    numbers = numeric_columns(frame)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"{c}|nulls") for c in frame.columns]
    row = staged(frame.agg(F.count("*").alias("n"), *nulls, *_moments(numbers)), "profile-row")
    counted = staged(_counted_values(frame, numbers, value_columns), "profile-values")
    sections = [
        _shape(row, frame.schema).select(F.lit("shape").alias("section"), "item", "detail"),
        _wide_to_rows(row, frame.columns, ["nulls"]).select(F.lit("nulls"), F.col("column"), F.col("nulls").cast("string")),
    ]
    figures = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    cells = [F.struct(F.lit(f).alias("figure"), text(f).alias("detail")) for f in figures]
    quantiles = selected_quantiles(counted.select("column", F.col("number").alias("value"), "n"), QUARTILES)
    numeric = _numeric(row, quantiles, numbers).select("column", F.inline(F.array(*cells)))
    sections.append(
        numeric.select(F.lit("numeric"), F.concat_ws(" ", "column", "figure"), F.col("detail"))
    )
    for c in value_columns:
        values = counted.where(F.col("column") == c)
        name = F.concat(F.lit(f"{c} "), F.coalesce("text", F.lit("NULL")))
        sections.append(values.select(F.lit("values"), name, F.col("n").cast("string")))
    if sample_columns:
        samples = profile_samples(frame, sample_columns, order)
        name = F.concat_ws(" ", "column", "place")
        sections.append(samples.select(F.lit("samples"), name, F.col("value")))
    whole = sections[0]
    for section in sections[1:]:
        whole = whole.union(section)
    return whole
