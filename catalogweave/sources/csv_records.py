"""Records of CSV files read in parallel, also where fields hold line breaks.

A line break ends a record unless it is inside quotes, that is, after an odd number of quote
characters of its file. So a file can be cut anywhere between two lines:

1. One pass counts the quotes of every split; running sums over the splits of a file, a row per
   split, tell which splits begin inside a record.
2. One pass joins the lines of each split into records. The lines before the first record's start
   and the record that is still open at the end are kept as fragments, two per split at most.
3. Fragments of one record are put together by their order, wherever its splits were read.

The records are staged in the shared folder, so the text is assembled once. A record's place is
the split it begins in and its number there, blank lines not counted; places in a split are consecutive.

Records end at a line feed, with or without a carriage return before it; in a file whose first line
ends with both, they are a plain line feed inside cells too, as in Spark's own reader. A cell with a quote
character has to be quoted itself and its quotes doubled, as the CSV rules ask; a stray quote would
shift the parity of the rest of its file.
"""

import csv
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_limit, staged

QUOTE = '"'
WHOLE, REST, OPEN = 0, 1, 2  # a whole record; lines of an earlier split's record; a record not closed in its split
_SCHEMA = "src_file string, src_block long, src_pos long, part int, record binary"
_ORIGIN = ["src_file", "src_block"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    return text.select(
        "value", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("src_block")
    )


def largest_file(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of the largest file under ``path``, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.max("length")).first()[0] or 0


def split_parity(lines: DataFrame) -> DataFrame:
    """(src_file, src_block, inside, crlf): whether a split begins inside a record. One row per split.

    ``crlf`` says that the file's first line ends with a carriage return.
    """
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(QUOTE), F.lit("")))
    numbered = lines.select(*_ORIGIN, quotes.alias("quotes"), F.endswith("value", F.lit("\r")).alias("cr"), F.monotonically_increasing_id().alias("at"))
    counts = numbered.groupBy(*_ORIGIN).agg(F.sum("quotes").alias("quotes"), F.min_by("cr", "at").alias("cr"))
    order = Window.partitionBy("src_file").orderBy("src_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    return counts.select(*_ORIGIN, inside.alias("inside"), F.first("cr").over(order).alias("crlf"))


class _Assembler:
    """Joins the lines of one split after the other into records."""

    def __init__(self):
        self.origin, self.columns = None, [[], [], [], [], []]

    def begin(self, origin, inside, crlf):
        self.crlf = crlf
        self.origin, self.number, self.rest, self.lines, self.odd = origin, 0, inside, [], inside

    def emit(self, part, lines):
        record = b"\n".join(lines)
        if part != REST:
            record = record if part == OPEN else record.removesuffix(b"\r")
            if not record and part == WHOLE:
                return
            place, self.number = self.number, self.number + 1
        else:
            place = -1  # before the records that begin here
        for column, value in zip(self.columns, (*self.origin, place, part, record)):
            column.append(value)

    def add(self, values: pa.Array):
        """More lines of the current split, in order."""
        odd = np.asarray(pc.count_substring(values, QUOTE)) % 2
        closed = np.flatnonzero((np.cumsum(odd) + self.odd) % 2 == 0) + 1  # a record ends before these lines
        lines = values.to_pylist()
        if self.crlf:
            lines = [line.removesuffix(b"\r") for line in lines]
        for start, end in pairwise([0, *closed.tolist()]):
            self.emit(REST if self.rest else WHOLE, [*self.lines, *lines[start:end]])
            self.rest, self.lines = False, []
        self.lines += lines[closed[-1] if len(closed) else 0 :]
        self.odd = (self.odd + int(odd.sum())) % 2

    def finish(self):
        """The split is over."""
        if self.origin and self.lines:
            self.emit(REST if self.rest else OPEN, self.lines)

    def take(self):
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(self.columns, types)]
        self.columns = [[], [], [], [], []]
        return pa.RecordBatch.from_arrays(columns, names=["src_file", "src_block", "src_pos", "part", "record"])


def _assemble(batches):
    state = _Assembler()
    for batch in batches:
        files, blocks = batch.column("src_file").to_pylist(), np.asarray(batch.column("src_block"))
        changes = [0] + [k for k in range(1, len(files)) if files[k] != files[k - 1] or blocks[k] != blocks[k - 1]]
        for start, end in pairwise([*changes, len(files)]):
            origin = files[start], int(blocks[start])
            if origin != state.origin:
                state.finish()
                state.begin(origin, *(batch.column(c)[start].as_py() for c in ("inside", "crlf")))
            state.add(batch.column("value").slice(start, end - start))
        yield state.take()
    state.finish()
    yield state.take()


def _joined(fragments: DataFrame) -> DataFrame:
    """The records that lie in several splits, each in the place where it begins."""
    order = Window.partitionBy("src_file").orderBy("src_block", "src_pos")
    begun = F.when(F.col("part") == OPEN, F.struct("src_block", "src_pos"))
    owned = fragments.withColumn("owner", F.last(begun, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("src_block", "src_pos", F.col("record").cast("string").alias("record"))))
    whole = owned.groupBy("src_file", "owner").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"))
    return whole.select(
        "src_file", "owner.src_block", "owner.src_pos", F.regexp_replace("record", "\r\\z", "").alias("record")
    )


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(src_file, src_block, src_pos, record): the records of all CSV files under ``path``, headers included."""
    lines = _lines(spark, path)
    parity = staged(split_parity(lines), "csv-splits")
    sized = parity.agg(F.sum(F.octet_length("src_file") + 32)).first()[0] or 0
    value = F.col("value").cast("binary").alias("value")
    columns = [value, "src_file", "src_block", "inside", "crlf"]
    if sized <= broadcast_limit(spark):
        met = lines.join(F.broadcast(parity), _ORIGIN).select(*columns)
    else:  # a split's lines meet again in one task, in their order
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        met = numbered.join(parity, _ORIGIN).repartition(*_ORIGIN).sortWithinPartitions(*_ORIGIN, "at").select(*columns)
    found = staged(met.mapInArrow(_assemble, _SCHEMA), "csv-records")
    whole = found.where(F.col("part") == WHOLE).select("src_file", "src_block", "src_pos", F.col("record").cast("string").alias("record"))
    return whole.unionByName(_joined(found.where(F.col("part") != WHOLE)))


def record_headers(records: DataFrame) -> DataFrame:
    """(src_file, header): the first record of every file."""
    first = (F.col("src_block") == 0) & (F.col("src_pos") == 0)
    return records.where(first).select("src_file", F.col("record").alias("header"))


def cells_of(record: str) -> list[str]:
    return next(csv.reader([record]), [])
