"""Session construction, shared scratch space and lineage cuts.

The few calls into Spark's gateway (plan statistics, the Hadoop file system) are all in this
module; a Spark Connect session would need them replaced here only.
"""

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[str | None] = ContextVar("scratch-scope", default=None)

SPREAD_BYTES_PER_CORE = 32 << 20
DEALT_BYTES = 4 << 20
MOST_DEALT = 64  # parts for each core; beyond that, or where Spark knows no size, parts grow


def build_session(app_name="catalogweave", master=None, **conf):
    """A session with the settings the operators assume (ANSI, UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a fresh
    temporary folder. On a cluster a missing setting is an error, because a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="catalogweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for one intermediate table."""
    scope = _scope.get() or f"{shared_folder(spark).rstrip('/')}/catalogweave"
    return f"{scope}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession, name: str):
    """Intermediate tables staged inside are dropped at the end, so a stream leaves none behind.

    Results that are still read afterwards have to be stored or fetched before.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/catalogweave/{name}-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        path, files = _file_system(spark, folder)
        files.delete(path, True)


def _file_system(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def create_file(spark: SparkSession, location: str, text: str) -> None:
    """Write a small new file; ``FileExistsError`` when somebody else has written it already.

    The file system's create-if-absent decides, which is atomic on HDFS and POSIX folders.
    """
    path, files = _file_system(spark, location)
    try:
        out = files.create(path, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(path):
            raise FileExistsError(location) from None
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def plan_text(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().treeString()


def estimated_bytes(frame: DataFrame) -> int:
    """Catalyst's size estimate of the frame's result."""
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_limit(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def pin(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs no recomputation."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once as a Parquet table and continue from the table.

    Unlike a checkpoint the table is columnar: each later reader scans only the
    columns and row groups it needs.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """Spread a small input over all cores before work that is heavy per row.

    A large input already has more splits than there are cores and is left
    alone, so at scale this never adds a shuffle.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if _bytes_read(frame) < cores * SPREAD_BYTES_PER_CORE else frame


def dealt(frame: DataFrame) -> DataFrame:
    """Deal rows out in even parts, of ``DEALT_BYTES`` read, before work that is heavy per row; each core gets as many.

    Parts that follow a join are few and uneven, because adaptive execution merges them by bytes;
    the last of them would then run alone for long. The frame should be narrow: all of it is shuffled.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    each = -(-_bytes_read(frame) // (cores * DEALT_BYTES))
    return frame.repartition(cores * min(max(1, each), MOST_DEALT))


def _bytes_read(frame: DataFrame) -> int:
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
