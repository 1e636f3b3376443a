"""Follow a raw directory that grows while the crawl runs."""

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.load import load_frame
from ..schemas import NA_TOKENS
from ..sources.raw import read_raw_works


def start_ingest(
    spark: SparkSession,
    raw_path: str,
    root: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    trigger: dict | None = None,
    na_tokens=NA_TOKENS,
) -> StreamingQuery:
    """Load every new raw CSV file into the catalogue, one micro-batch at a time.

    Loads are keyed upserts, so a batch that is replayed after a failure changes
    nothing. The default trigger works off what is there and stops. The stream only
    finds the files (their content is not read by it); each batch of at most
    ``files_per_batch`` files is then scanned by header name like any other load.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(raw_path)
        .select("path")
    )

    def load(batch, batch_id):
        session = batch.sparkSession
        paths = sorted(r["path"] for r in batch.distinct().collect())
        if paths:
            raw = read_raw_works(session, paths, "csv", na_tokens)
            load_frame(session, raw, root, invalid_path=f"{root.rstrip('/')}/invalid/batch-{batch_id:012d}")

    return (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
