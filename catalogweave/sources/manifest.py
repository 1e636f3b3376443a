"""An append-only manifest that names the current parts of a set of tables.

Writers put new table parts into fresh folders first and then create one entry, a file named
by its version. Readers take the newest entry, so they see the old state or the new one,
never a mixture, and a reader that already started keeps its files. Of two writers that
start from the same version, the second finds its version taken and fails; what it has
written stays invisible.
"""

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import create_file


BUCKETS = 256  # of the core table and the embedding store; an upsert rewrites those it touches


class PublishConflict(RuntimeError):
    """Somebody else has published since the snapshot was read; load again."""


def current_snapshot(spark: SparkSession, root: str) -> dict:
    """Newest entry: its version and the part folders by table name."""
    try:
        lines = spark.read.schema("version BIGINT, parts STRING").json(f"{root.rstrip('/')}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {"version": 0, "parts": {}}
    newest = lines.where("version IS NOT NULL").orderBy(F.desc("version")).first()
    if newest is None:  # a first publish that died before its entry was complete
        return {"version": 0, "parts": {}}
    return {"version": newest["version"], "parts": json.loads(newest["parts"])}


def publish(spark: SparkSession, root: str, snapshot: dict, parts: dict) -> dict:
    """Make ``parts`` current by creating the entry after ``snapshot``; ``PublishConflict`` when it exists."""
    entry = {"version": snapshot["version"] + 1, "parts": parts}
    line = json.dumps({"version": entry["version"], "parts": json.dumps(parts)})
    try:
        create_file(spark, f"{root.rstrip('/')}/manifest/{entry['version']:012d}.json", line + "\n")
    except FileExistsError:
        raise PublishConflict(f"{root}: version {entry['version']} was published meanwhile") from None
    return entry


def read_parts(spark: SparkSession, folders: list[str], schema) -> DataFrame:
    """All parts of one table as one scan; an empty frame without parts."""
    if not folders:
        return spark.createDataFrame([], schema)
    base = folders[0].split("/part=")[0]
    parts = spark.read.option("basePath", base).schema(schema).parquet(*folders)
    return parts.select(*schema.fieldNames())


def bucket_of(key: str) -> Column:
    """The bucket of a row in a bucketed table; rows with one key share a bucket."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_buckets(frame: DataFrame, key: str, root: str, name: str) -> dict[int, str]:
    """Write rows as one folder per bucket of ``key``, sorted by it; returns folder by bucket."""
    spark = frame.sparkSession
    folder = new_folder(root, name)
    rows = frame.withColumn("bucket", bucket_of(key))
    dealt = rows.repartition(min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
    dealt.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(folder)
    files = spark.read.schema(frame.schema).parquet(folder).inputFiles()
    found = sorted({int(f.rsplit("bucket=", 1)[1].split("/")[0]) for f in files})
    return {b: f"{folder}/bucket={b}" for b in found}


def in_buckets(folders: list[str], wanted) -> tuple[list[str], list[str]]:
    """Folders of the wanted buckets, and all others."""
    inside = [f for f in folders if int(f.rsplit("bucket=", 1)[1]) in wanted]
    return inside, [f for f in folders if f not in set(inside)]


def new_folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}/part=p{uuid.uuid4().hex}"
