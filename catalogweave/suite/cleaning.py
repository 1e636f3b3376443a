"""Scalar cleaning, whole-frame cleaning, validation and de-duplication."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lists import parse_list
from ..functions.urls import derive_id, strip_query, work_url
from ..operators.clean import clean_works
from ..operators.extract import plan_listing_urls
from ..operators.normalize import (
    core_projection,
    count_duplicates,
    dedupe_first,
    normalize_works,
    with_identity,
)
from ..operators.validate import judge, split_valid, valid_rows, with_error
from ..schemas import CORE_COLUMNS, TAG_KINDS
from ..session import spread
from .inputs import CLEAN_WORKS_SQL, raw_works, table

ANY_NUMBER = r"/(\d+)"
BASE = "https://host"


def clean_text(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select("doc_id", X.clean_text(F.col("text")).alias("text"))


def clean_int(spark, sf_dir):
    raw = raw_works(spark, sf_dir)
    return raw.select(
        "o_orderkey",
        X.clean_int(F.col("words")).alias("words"),
        X.is_bad_int(F.col("words")).alias("bad_words"),
        X.clean_int(F.col("hits")).alias("hits"),
        X.clean_int(F.col("bookmarks")).alias("bookmarks"),
    )


def clean_status(spark, sf_dir):
    return raw_works(spark, sf_dir).select("o_orderkey", X.clean_status(F.col("status")).alias("status"))


def clean_date(spark, sf_dir):
    return raw_works(spark, sf_dir).select("o_orderkey", X.clean_date(F.col("last_date")).alias("last_date"))


def parse_lists(spark, sf_dir):
    lists = [F.array_join(parse_list(F.col(c)), "|").alias(c) for c in TAG_KINDS]
    return raw_works(spark, sf_dir).select("o_orderkey", *lists)


def split_chapters(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    total = F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int").cast("string"))
    text = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.coalesce(total, F.lit("?")))
    text = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("string")).otherwise(text)
    current, total = X.split_chapters(text)
    split = items.select(current.alias("current_chapters"), total.alias("total_chapters"))
    return split.groupBy("current_chapters", "total_chapters").agg(F.count("*").alias("n"))


def ids_of_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", derive_id(F.col("url"), ANY_NUMBER).alias("fic_id"))


def urls_without_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strip_query(F.col("url")).alias("url"))


def work_urls(spark, sf_dir):
    href = F.concat(F.lit("/works/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", work_url(href, BASE).alias("url"))


def plan_listing(spark, sf_dir):
    seeds = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(f"{BASE}/tags/"), F.col("c_custkey").cast("string"), F.lit("/works?sort=1")).alias("url"),
        (F.col("c_nationkey") * 7).alias("works"),
    )
    return plan_listing_urls(seeds)


def _cleaned(spark, sf_dir):
    return with_identity(clean_works(raw_works(spark, sf_dir)))


def clean_whole_works(spark, sf_dir):
    lists = [F.array_join(c, "|").alias(c) for c in TAG_KINDS]
    return _cleaned(spark, sf_dir).select("o_orderkey", *CORE_COLUMNS, *lists)


def validity_split(spark, sf_dir):
    numbered = _cleaned(spark, sf_dir).withColumn("row_number", F.col("o_orderkey"))
    return split_valid(numbered)[1]


def error_counts(spark, sf_dir):
    judged = with_error(_cleaned(spark, sf_dir))
    return judged.groupBy("error").agg(F.count("*").alias("n"))


def normalized_core(spark, sf_dir):
    valid = valid_rows(judge(_cleaned(spark, sf_dir)))
    return normalize_works(valid, ["o_orderkey"]).core


def core_rows(spark, sf_dir):
    works = _cleaned(spark, sf_dir)
    present = works.where(F.col("summary").isNotNull() & F.col("fic_id").isNotNull())
    return core_projection(present).orderBy("fic_id")


def duplicate_works(spark, sf_dir):
    valid, _ = split_valid(_cleaned(spark, sf_dir).withColumn("row_number", F.col("o_orderkey")))
    return count_duplicates(valid, "fic_id")


def first_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return dedupe_first(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


QUERIES = {
    "clean_text": clean_text,
    "clean_int": clean_int,
    "clean_status": clean_status,
    "clean_date": clean_date,
    "parse_list": parse_lists,
    "split_chapters": split_chapters,
    "derive_id": ids_of_urls,
    "url_strip_query": urls_without_query,
    "work_url": work_urls,
    "plan_listing": plan_listing,
    "clean_works": clean_whole_works,
    "validity_split": validity_split,
    "error_counts": error_counts,
    "normalize_works": normalized_core,
    "core_projection": core_rows,
    "duplicates_removed": duplicate_works,
    "dedupe_first": first_events,
}

_CORE = ", ".join(CORE_COLUMNS)
_LISTS = ", ".join(TAG_KINDS)
_WORKS = f"WITH {CLEAN_WORKS_SQL}"

ORACLES = {
    "clean_text": r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text FROM documents",
    "clean_int": f"""{_WORKS} SELECT o_orderkey, words, words IS NULL AS bad_words,
        CASE WHEN hits > 0 THEN hits END AS hits,
        CASE WHEN bookmarks > 0 OR total_chapters IS NOT NULL THEN bookmarks END AS bookmarks FROM expected""",
    "clean_status": f"{_WORKS} SELECT o_orderkey, status FROM expected",
    "clean_date": f"{_WORKS} SELECT o_orderkey, last_date FROM expected",
    "parse_list": f"{_WORKS} SELECT o_orderkey, {_LISTS} FROM expected",
    "split_chapters": """
        SELECT CASE WHEN l_returnflag <> 'R' THEN l_linenumber::VARCHAR END AS current_chapters,
               CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN l_quantity::INT::VARCHAR END AS total_chapters,
               count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
    "derive_id": r"SELECT page_id, try_cast(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS fic_id FROM pages",
    "url_strip_query": "SELECT page_id, split_part(url, '?', 1) AS url FROM pages",
    "work_url": "SELECT page_id, 'https://host/works/' || page_id || '?view_adult=true' AS url FROM pages",
    "plan_listing": """
        SELECT url, page::INT AS page, split_part(url, '?', 1) || '?page=' || page AS listing_url
        FROM (SELECT 'https://host/tags/' || c_custkey || '/works?sort=1' AS url,
                     unnest(range(1, ceil(c_nationkey * 7 / 20.0)::BIGINT + 1)) AS page FROM customer)""",
    "clean_works": f"{_WORKS} SELECT o_orderkey, {_CORE}, {_LISTS} FROM expected",
    "validity_split": f"""{_WORKS} SELECT o_orderkey AS row_number, fic_id, error FROM judged
        WHERE error IS NOT NULL""",
    "error_counts": f"{_WORKS} SELECT error, count(*) AS n FROM judged GROUP BY error",
    "normalize_works": f"{_WORKS} SELECT {_CORE} FROM firsts",
    "core_projection": f"{_WORKS} SELECT {_CORE} FROM expected WHERE fic_id IS NOT NULL",
    "duplicates_removed": f"""{_WORKS} SELECT (count(*) - count(DISTINCT fic_id))::BIGINT AS duplicates
        FROM judged WHERE error IS NULL""",
    "dedupe_first": """
        SELECT event_id, user_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
}
