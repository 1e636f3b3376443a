"""Raw CSV as it comes: other headers, ragged rows, odd characters; and what goes to the side."""

from pyspark.sql import functions as F

from ..functions.text import clean_date, is_bad_date, text_prefix
from ..operators.extract import extract_works, split_incomplete
from ..operators.merge import replace_embeddings
from ..operators.validate import with_error
from ..schemas import RAW_COLUMNS
from ..session import scratch_path, staged
from ..sources.embeddings import as_store, read_embeddings, write_embeddings
from ..sources.raw import CSV_OPTIONS, append_raw_works, number_rows, read_raw_works
from ..sources.urls import write_failed_pages
from .inputs import table, vectors
from .pages import work_pages

FOLDERS = 8


def _orders(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("T"), key).alias("title"),
        F.concat(F.lit("https://host/works/"), key).alias("url"),
        F.col("o_custkey").cast("string").alias("words"),
        F.col("o_orderpriority").alias("summary"),
    )


def _written(frame, columns):
    """A folder of CSV files whose header has these columns in this order."""
    path = scratch_path(frame.sparkSession, "csv")
    frame.select(*columns).write.option("header", "true").csv(path)
    return path


def reordered_header(spark, sf_dir):
    """Columns in another order, with one that is unknown."""
    orders = _orders(spark, sf_dir).withColumn("extra", F.lit("x"))
    path = _written(orders, ["url", "words", "extra", "summary", "title"])
    return read_raw_works(spark, path).select("title", "summary", "words", "url", "author", "bad_row")


def missing_columns(spark, sf_dir):
    """Two crawls in one folder, one of which has no summary."""
    orders = _orders(spark, sf_dir)
    path = scratch_path(spark, "csv")
    for name, columns in (("a", ["title", "words", "url"]), ("b", ["title", "summary", "words", "url"])):
        half = orders.where((F.col("o_orderkey") % 2 == 0) == (name == "a"))
        half.select(*columns).write.option("header", "true").csv(f"{path}/{name}")
    return read_raw_works(spark, path).select("title", "summary", "words", "url", "bad_row")


def _lines(spark, sf_dir):
    """CSV files of lines in key order, a third each with a cell too few, too many, and right."""
    orders = _orders(spark, sf_dir).withColumn("folder", F.col("o_orderkey") % FOLDERS)
    key = F.col("o_orderkey")
    short, right = F.concat_ws(",", "title", "url"), F.concat_ws(",", "title", "url", "words")
    line = F.when(key % 3 == 1, short).when(key % 3 == 2, F.concat(right, F.lit(",more"))).otherwise(right)
    rows = orders.select("folder", key.alias("at"), line.alias("value"))
    headers = spark.range(FOLDERS).select(F.col("id").alias("folder"), F.lit(-1).alias("at"), F.lit("title,url,words").alias("value"))
    path = scratch_path(spark, "csv")
    placed = rows.unionByName(headers).repartition(FOLDERS, "folder").sortWithinPartitions("folder", "at")
    placed.select("folder", "value").write.partitionBy("folder").text(path)
    return path


def ragged_rows(spark, sf_dir):
    return read_raw_works(spark, _lines(spark, sf_dir)).select("title", "url", "bad_row")


def row_numbers(spark, sf_dir):
    rows = number_rows(read_raw_works(spark, _lines(spark, sf_dir)))
    return rows.select("title", "row_number")


def lossless_roundtrip(spark, sf_dir):
    """Outer white space, quotes, backslashes and line breaks survive append and scan."""
    odd = F.concat(F.lit('  "a" \\ \\"'), F.col("title"), F.lit("\n\r\n, 'b'\t "))
    orders = _orders(spark, sf_dir).withColumn("title", odd)
    full = orders.select(*[F.col(c) if c in orders.columns else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS])
    path = scratch_path(spark, "csv")
    append_raw_works(full, path, "csv")
    return read_raw_works(spark, path).select("title", "url", "author", "bad_row")


def one_large_file(spark, sf_dir):
    """One CSV file with line breaks and quotes in its cells, read in many small splits."""
    odd = F.concat(F.lit('say "hi"\n'), F.col("title"), F.lit(',\r\n\n"end'))
    orders = _orders(spark, sf_dir).withColumn("title", odd)
    path = scratch_path(spark, "csv")
    ordered = orders.coalesce(1).sortWithinPartitions("o_orderkey").select("title", "url", "words", "summary")
    ordered.write.options(**CSV_OPTIONS).csv(path)
    settings = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = staged(read_raw_works(spark, path, split=True), "rows")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return number_rows(rows).select("title", "url", "words", "summary", "author", "bad_row", "row_number")


def failed_pages(spark, sf_dir):
    path = scratch_path(spark, "failed")
    _, failed = split_incomplete(extract_works(work_pages(spark, sf_dir), keep_failed_html=True))
    write_failed_pages(failed, path)
    stored = spark.read.parquet(path)
    return stored.select("url", "seq", "reason", F.contains("html", F.lit("<dl class=")).alias("has_html"))


def list_type_check(spark, sf_dir):
    lists = F.when(F.col("c_acctbal") >= 0, F.array("c_mktsegment"))
    numbers = ("hits", "bookmarks", "kudos", "current_chapters", "words")
    given = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("fic_id"),
        *[F.col("c_name").alias(c) for c in ("url", "name", "language", "rating")],
        *[F.lit(1).alias(c) for c in numbers],
        lists.alias("fandom"),
    )
    return with_error(given).select("fic_id", "error")


def replaced_store(spark, sf_dir):
    """The whole store replaced by part of its vectors, negated."""
    path = scratch_path(spark, "store")
    given = vectors(spark, sf_dir)
    write_embeddings(as_store(given, "first"), path)
    negated = given.select("fic_id", F.transform("embedding", lambda x: -x).alias("embedding")).where("fic_id % 2 = 0")
    write_embeddings(replace_embeddings(as_store(negated, "second")), path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)
    return read_embeddings(spark, path).select("fic_id", "model_name", F.round(total, 5).alias("total"))


def text_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text_prefix(F.col("text"), 100).alias("prefix"))


LAYOUTS = ("d MMM yyyy", "M/d/yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd", "yyyy-MM-dd", "'on 'yyyy")


def date_layouts(spark, sf_dir):
    """Each order's date in one of eight layouts, the last of which says too little."""
    text = F.lit(None).cast("string")
    for k, layout in enumerate(LAYOUTS):
        text = F.when(F.col("o_orderkey") % len(LAYOUTS) == k, F.date_format(F.to_timestamp("o_orderdate"), layout)).otherwise(text)
    dates = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return dates.select("o_orderkey", clean_date(F.col("text")).alias("day"), is_bad_date(F.col("text")).alias("lost"))


QUERIES = {
    "csv_reordered_header": reordered_header,
    "csv_missing_columns": missing_columns,
    "csv_ragged_rows": ragged_rows,
    "csv_row_numbers": row_numbers,
    "csv_lossless_roundtrip": lossless_roundtrip,
    "csv_one_large_file": one_large_file,
    "failed_pages": failed_pages,
    "list_type_check": list_type_check,
    "replace_store": replaced_store,
    "text_prefix": text_prefixes,
    "date_layouts": date_layouts,
}

_ROW = "'T' || o_orderkey AS title, 'https://host/works/' || o_orderkey AS url"

ORACLES = {
    "csv_reordered_header": f"""SELECT {_ROW}, o_orderpriority AS summary, o_custkey::VARCHAR AS words,
        NULL::VARCHAR AS author, false AS bad_row FROM orders""",
    "csv_missing_columns": f"""SELECT {_ROW}, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS summary,
        o_custkey::VARCHAR AS words, false AS bad_row FROM orders""",
    "csv_ragged_rows": f"SELECT {_ROW}, o_orderkey % 3 <> 0 AS bad_row FROM orders",
    "csv_row_numbers": f"""SELECT 'T' || o_orderkey AS title,
        row_number() OVER (PARTITION BY o_orderkey % {FOLDERS} ORDER BY o_orderkey) - 1 AS row_number FROM orders""",
    "csv_lossless_roundtrip": """SELECT '  "a" \\ \\"T' || o_orderkey || chr(10) || chr(13) || chr(10) || ', ''b''' || chr(9) || ' ' AS title,
        'https://host/works/' || o_orderkey AS url, NULL::VARCHAR AS author, false AS bad_row FROM orders""",
    "csv_one_large_file": """SELECT 'say "hi"' || chr(10) || 'T' || o_orderkey || ',' || chr(13) || chr(10) || chr(10) || '"end' AS title,
        'https://host/works/' || o_orderkey AS url, o_custkey::VARCHAR AS words, o_orderpriority AS summary,
        NULL::VARCHAR AS author, false AS bad_row, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_number FROM orders""",
    "failed_pages": """SELECT 'https://host/works/' || o_orderkey AS url, o_orderkey AS seq, 'title missing' AS reason, true AS has_html
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P'""",
    "list_type_check": """SELECT c_custkey AS fic_id, CASE WHEN c_acctbal < 0 THEN 'fandom must be a list' END AS error FROM customer""",
    "replace_store": """SELECT vec_id AS fic_id, 'second' AS model_name, round(-list_sum(embedding::DOUBLE[]), 5) AS total
        FROM embeddings WHERE vec_id % 2 = 0""",
    "text_prefix": "SELECT doc_id, substr(text, 1, 100) AS prefix FROM documents",
    "date_layouts": f"""SELECT o_orderkey, CASE WHEN o_orderkey % {len(LAYOUTS)} <> {len(LAYOUTS) - 1} THEN o_orderdate::DATE END AS day,
        o_orderkey % {len(LAYOUTS)} = {len(LAYOUTS) - 1} AS lost FROM orders""",
}
