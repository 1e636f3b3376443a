"""Raw works: text records scanned from CSV or Parquet, and appended to either.

CSV columns are taken by the names in each file's header, in any order; absent ones are NULL
and unknown ones are ignored. A row with more or fewer cells than its header is marked
``bad_row``, which validation turns into a rejected row.
"""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lists import list_text
from ..functions.text import na_to_null
from ..operators.clean import BAD_ROW
from ..operators.joins import lookup_join
from ..schemas import INVALID_SCHEMA, NA_TOKENS, RAW_COLUMNS
from ..session import broadcast_limit, staged
from .csv_records import cells_of, csv_records, largest_file, record_headers

# Where a row came from. Captured at the scan, before anything is shuffled;
# (file, block, position) sorts rows in file order.
ORIGIN_COLUMNS = ("src_file", "src_block", "src_pos")

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
_CORRUPT = "_corrupt_row"


def with_origin(scan: DataFrame) -> DataFrame:
    return scan.select(
        *[c for c in scan.columns if c != "_metadata"],
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_pos"),
    )


def read_raw_works(
    spark: SparkSession,
    path: str | list[str],
    file_format: str = "csv",
    na_tokens=NA_TOKENS,
    header: list[str] | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Raw works as text columns, ``bad_row`` and their origin.

    Every column is read as text, nothing is inferred; ``na_tokens`` become
    NULL. ``split`` reads CSV files in splits (see ``csv_records``), so that one large file is many
    tasks; without it one file is one task. Left open, files are split when the largest one exceeds
    ``spark.sql.files.maxPartitionBytes``.
    ``header`` names the columns of CSV files whose header is known to be the same;
    otherwise the header of every file is looked up: among its records when files are split, else
    in one more pass over the raw lines.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if file_format == "csv" and split is None:
        split = largest_file(spark, path) > _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if file_format == "csv" and split:
        scan = _record_scan(csv_records(spark, path), header)
    elif file_format == "csv":
        groups = [(header, path)] if header else csv_headers(spark, path)
        scans = [_csv_scan(reader, names, files) for names, files in groups]
        scan = scans[0]
        for more in scans[1:]:
            scan = scan.unionByName(more)
    else:
        scan = reader.format(file_format).load(path)
        scan = with_origin(scan.select(*_by_name(scan), F.lit(False).alias(BAD_ROW), "_metadata"))
    return scan.select(*[na_to_null(F.col(c), na_tokens).alias(c) for c in RAW_COLUMNS], BAD_ROW, *ORIGIN_COLUMNS)


def _bytes(size: str) -> int:
    """A size setting in bytes, such as 128m or 134217728b."""
    digits, unit = size.lower().rstrip("b").rstrip("i"), 1
    if digits[-1:] in "kmgt":
        unit, digits = 1024 ** ("kmgt".index(digits[-1]) + 1), digits[:-1]
    return int(digits) * unit


def _record_scan(records: DataFrame, header: list[str] | None) -> DataFrame:
    """Records parsed by their file's header; one parse per different header."""
    headers = record_headers(records)
    rows = records.where(~((F.col("src_block") == 0) & (F.col("src_pos") == 0)))
    if header:
        return _parsed(rows, header)
    found = [r["header"] for r in headers.select("header").distinct().orderBy("header").collect()]
    if len(found) == 1:
        return _parsed(rows, cells_of(found[0]))
    scan = _parsed(rows.where(F.lit(False)), list(RAW_COLUMNS))
    for names in found:
        own = headers.where(F.col("header") == names).select("src_file")
        scan = scan.unionByName(_parsed(rows.join(own, "src_file", "left_semi"), cells_of(names)))
    return scan


def _parsed(rows: DataFrame, header: list[str]) -> DataFrame:
    schema = ", ".join("`{}` STRING".format(f.name.replace("`", "``")) for f in _header_fields(header))
    # A record is one line to the parser: only the line feed is a break, and those in quotes are kept.
    options = {**CSV_OPTIONS, "lineSep": "\n", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    cells = rows.select(F.from_csv("record", schema, options).alias("cells"), *ORIGIN_COLUMNS)
    flat = cells.select("cells.*", *ORIGIN_COLUMNS)
    return flat.select(*_by_name(flat), F.col(_CORRUPT).isNotNull().alias(BAD_ROW), *ORIGIN_COLUMNS)


def csv_headers(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], list[str]]]:
    """(column names, files) of the CSV files under ``path``, one entry per different header.

    The header is the first line of a file. One line per file reaches the driver, which
    lists the files anyway.
    """
    first = first_lines(spark.read.option("recursiveFileLookup", "true").text(path))
    files = {}
    for row in sorted(first.collect(), key=lambda row: row["file"]):
        files.setdefault(row["header"], []).append(row["file"])
    return [(cells_of(header), own) for header, own in files.items()] or [(list(RAW_COLUMNS), path)]


def first_lines(lines: DataFrame) -> DataFrame:
    """(file, header): the first line of every file of a text scan.

    Places are compared first and the few texts fetched by them, because a smallest text per file would have
    all lines sorted in memory. Both scans are of one listing, so they number lines alike.
    """
    numbered = lines.where("_metadata.file_block_start = 0").select(
        F.col("value").alias("header"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")
    )
    places = numbered.groupBy("file").agg(F.min("at").alias("at"))
    return numbered.join(F.broadcast(places.select("at")), "at").select("file", "header")


def _csv_scan(reader, header: list[str], files) -> DataFrame:
    """One scan of files with the same header, reduced to the raw columns by name."""
    fields = _header_fields(header)
    options = {**CSV_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    scan = reader.options(**options).schema(T.StructType(fields)).csv(files)
    return with_origin(scan.select(*_by_name(scan), F.col(_CORRUPT).isNotNull().alias(BAD_ROW), "_metadata"))


def _header_fields(header: list[str]) -> list[T.StructField]:
    names = [n.strip().lstrip("\ufeff").lower() for n in header]
    # A name's first column counts; blank and repeated names get placeholders.
    unique = [n if n and n not in names[:k] else f"_unnamed_{k}" for k, n in enumerate(names)]
    return [T.StructField(n, T.StringType()) for n in (*unique, _CORRUPT)]


def _by_name(scan: DataFrame) -> list:
    return [
        _as_text(scan, c).alias(c) if c in scan.columns else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS
    ]


def _as_text(scan: DataFrame, column: str):
    if isinstance(scan.schema[column].dataType, T.ArrayType):
        return list_text(F.col(column))
    return F.col(column).cast("string")


def append_raw_works(
    works: DataFrame,
    path: str,
    file_format: str = "parquet",
    batch: str | None = None,
    rows_per_file: int = 1_000_000,
) -> None:
    """Append records under ``path``; batches sort by name, so later ones count as later rows.

    Parquet is the default because it can be split; CSV keeps every character, also outer
    white space, quotes and line breaks, but one file is one task for its readers.
    """
    batch = batch or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    target = f"{path.rstrip('/')}/batch-{batch}"
    columns = []
    for c in RAW_COLUMNS:
        is_array = isinstance(works.schema[c].dataType, T.ArrayType)
        columns.append(list_text(F.col(c)).alias(c) if is_array and file_format == "csv" else F.col(c))
    writer = works.select(*columns).write.mode("append").option("maxRecordsPerFile", rows_per_file)
    if file_format == "csv":
        writer.options(**CSV_OPTIONS).csv(target)
    else:
        writer.format(file_format).save(target)


def number_rows(works: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Add ``row_number``, counted from 0 inside each source file, to ``wanted`` rows (or all).

    Only one (first position, row count) record per scan block is needed to
    turn scan positions into row numbers, so no row is sorted. The records are few: they are
    staged, and broadcast when their size is found to allow it, or met with salted keys.
    """
    blocks = works.groupBy("src_file", "src_block").agg(
        F.min("src_pos").alias("first_pos"), F.count("*").alias("n")
    )
    earlier = Window.partitionBy("src_file").orderBy("src_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = blocks.select(
        "src_file",
        "src_block",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_pos")).alias("shift"),
    )
    rows, keys = works if wanted is None else wanted, ["src_file", "src_block"]
    starts = staged(starts, "scan-blocks")
    sized = starts.agg(F.sum(F.octet_length("src_file") + 32)).first()[0] or 0
    small = sized <= broadcast_limit(works.sparkSession)
    met = rows.join(F.broadcast(starts), keys) if small else lookup_join(rows, starts, keys)
    return met.withColumn("row_number", F.col("src_pos") + F.col("shift"))


def write_invalid(invalid: DataFrame, path: str, file_format: str = "csv") -> None:
    """Overwrite the reject file; the writer creates missing folders."""
    writer = invalid.select(*INVALID_SCHEMA.fieldNames()).write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(file_format).save(path)


