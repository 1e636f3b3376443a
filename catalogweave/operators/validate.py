"""Split cleaned works into valid rows and rejected rows with a reason."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INVALID_SCHEMA, REQUIRED_COLUMNS, TAG_KINDS
from ..session import staged
from .clean import BAD_ROW


def error_reason(frame: DataFrame) -> Column:
    """The first failed rule, or NULL for a valid row."""
    reason = F.when(F.lit(False), F.lit(""))
    if "fault" in frame.columns:  # nothing in a row of the wrong width can be trusted
        reason = reason.when(F.col("fault") == BAD_ROW, F.lit(BAD_ROW))
    reason = reason.when(F.col("fic_id").isNull(), F.lit("Missing fic_id"))
    if "fault" in frame.columns:
        reason = reason.when(F.col("fault").isNotNull(), F.col("fault"))
    for c in REQUIRED_COLUMNS:
        reason = reason.when(F.col(c).isNull(), F.lit(f"Missing required field: {c}"))
    for c in TAG_KINDS:
        if c in frame.columns and frame.schema[c].nullable:
            reason = reason.when(F.col(c).isNull(), F.lit(f"{c} must be a list"))
    return reason


def with_error(frame: DataFrame) -> DataFrame:
    return frame.withColumn("error", error_reason(frame))


def judge(frame: DataFrame) -> DataFrame:
    """Rows with their ``error``, staged as a table.

    Several outputs filter on the error. Staging means that each row is cleaned
    once, and that those filters reach the scan instead of being unfolded into
    the cleaning expressions (which costs the optimiser minutes).
    """
    return staged(with_error(frame), "judged")


def split_valid(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows as ``row_number, fic_id, error``)."""
    judged = judge(frame)
    return valid_rows(judged), error_records(judged)


def valid_rows(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("error").isNull()).drop("error")


def error_records(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("error").isNotNull()).select(*INVALID_SCHEMA.fieldNames())
