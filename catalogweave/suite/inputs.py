"""The driver tables seen as a catalogue of works.

Two views exist. Parts with their line items and vectors play the works to
recommend; orders with their customers play raw records and crawled pages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- works to recommend: parts ------------------------------------------------------


def part_core(spark, sf_dir):
    """(fic_id, kudos, bookmarks): line items and distinct orders of a part."""
    sales = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").cast("int").alias("kudos"),
        F.count_distinct("l_orderkey").cast("int").alias("bookmarks"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fic_id"))
    joined = parts.join(sales, F.col("fic_id") == F.col("l_partkey"), "left")
    zero = F.lit(0)
    return joined.select(
        "fic_id",
        F.coalesce("kudos", zero).alias("kudos"),
        F.coalesce("bookmarks", zero).alias("bookmarks"),
    )


def part_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("fic_id"), F.split("p_name", " ").alias("words")
    )


def part_tags(spark, sf_dir):
    """Distinct (fic_id, kind, tag): words of the name and suppliers of the line items."""
    words = part_words(spark, sf_dir).select(
        "fic_id", F.lit("fandom").alias("kind"), F.explode(F.array_distinct("words")).alias("tag")
    )
    suppliers = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    suppliers = suppliers.select(
        F.col("l_partkey").alias("fic_id"),
        F.lit("relationship").alias("kind"),
        F.col("l_suppkey").cast("string").alias("tag"),
    )
    return words.unionByName(suppliers)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fic_id"), "embedding")


# --- raw records: orders with their customers ----------------------------------------

NBSP = " "


def orders_with_customers(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return spread(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")))


def raw_works(spark, sf_dir, sort=False):
    """Raw text records with every kind of flaw, keyed by ``o_orderkey``; on request sorted by it, over all partitions."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    price = F.floor("o_totalprice")

    def grouped(number):
        return F.format_number(number.cast("bigint"), 0)

    def join(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    both = lambda p, s: (priority == p) & (status == s)
    key, customer, name = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_name")
    chapters = F.col("c_nationkey") + 1
    day = F.col("o_orderdate")
    fields = {
        "title": F.when(both("5-LOW", "P"), F.lit(f"  {NBSP} ")).otherwise(
            join("  ", priority, NBSP, " order\t", key.cast("string"), " ")
        ),
        "author": join("/users/", name),
        "summary": join('Two\nlines "', status, '", ', key.cast("string")),
        "words": F.when(both("4-NOT SPECIFIED", "O"), F.lit("abc")).otherwise(grouped(price)),
        "current_chapters": chapters.cast("string"),
        "total_chapters": F.when(status != "P", join(" ", chapters.cast("string"))),
        "kudos": grouped(F.floor(F.col("o_totalprice") / 100)),
        "bookmarks": F.when(status != "P", join(" ", customer.cast("string"), " ")),
        "hits": F.when(priority != "1-URGENT", grouped(price * 10)),
        "rating": F.col("c_mktsegment"),
        "language": F.when(~both("2-HIGH", "O"), F.lit("English")),
        "status": F.when(status == "F", F.lit("Completed:"))
        .when(status == "P", F.lit("UPDATED 2024"))
        .when(priority == "3-MEDIUM", F.lit("Paused")),
        "last_date": F.when(priority == "2-HIGH", F.date_format(day, "dd MMM yyyy"))
        .when(priority == "3-MEDIUM", F.date_format(day, "MM/dd/yyyy"))
        .when(priority == "5-LOW", F.lit("garbage"))
        .otherwise(F.date_format(day, "yyyy-MM-dd")),
        "warning": F.lit("['No Warnings']"),
        "category": F.when(status != "F", F.lit("['Gen']")),
        "fandom": join(
            "['Nation ", F.col("c_nationkey").cast("string"), "', \"It's ", F.col("c_mktsegment"), "\", 'x, y']"
        ),
        "relationship": F.lit("[]"),
        "character": join("['", name, "', '", name, " ']"),
        "freeform": F.when(status == "P", join("['a', ", priority, "]"))
        .when(status == "F", join("Fluff, ", priority, ","))
        .otherwise(join("['caf\\xe9 ", priority, "']")),
        "url": F.when(both("3-MEDIUM", "F"), join("https://host/series/", customer.cast("string"))).otherwise(
            join("https://host/works/", customer.cast("string"), "?view_adult=true")
        ),
    }
    given = orders_with_customers(spark, sf_dir)
    if sort:  # before the texts are made, so that the shuffle moves few bytes and its sampling makes none
        given = given.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey")
    return given.select(
        "o_orderkey", *[value.alias(column) for column, value in fields.items()]
    )


# What cleaning has to make of those records, written down directly.
CLEAN_WORKS_SQL = """
expected AS (
  SELECT o_orderkey,
         CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS fic_id,
         CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F'
              THEN 'https://host/series/' || o_custkey
              ELSE 'https://host/works/' || o_custkey || '?view_adult=true' END AS url,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL
              ELSE o_orderpriority || ' order ' || o_orderkey END AS name,
         '/users/' || c_name AS author,
         'Two lines "' || o_orderstatus || '", ' || o_orderkey AS summary,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE floor(o_totalprice)::INT * 10 END AS hits,
         CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey::INT END AS bookmarks,
         floor(o_totalprice / 100)::INT AS kudos,
         (c_nationkey + 1)::INT AS current_chapters,
         CASE WHEN o_orderstatus <> 'P' THEN (c_nationkey + 1)::INT END AS total_chapters,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN NULL
              ELSE floor(o_totalprice)::INT END AS words,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate::DATE END AS last_date,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'on_going'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'paused' END AS status,
         CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN NULL ELSE 'English' END AS language,
         c_mktsegment AS rating,
         'No Warnings' AS warning,
         CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Gen' END AS category,
         'Nation ' || c_nationkey || '|It''s ' || c_mktsegment || '|x, y' AS fandom,
         '' AS relationship,
         c_name || '|' || c_name AS character,
         CASE WHEN o_orderstatus = 'P' THEN '[''a''|' || o_orderpriority || ']'
              WHEN o_orderstatus = 'F' THEN 'Fluff|' || o_orderpriority
              ELSE 'café ' || o_orderpriority END AS freeform
  FROM orders JOIN customer ON o_custkey = c_custkey),
judged AS (
  SELECT *,
         CASE WHEN fic_id IS NULL THEN 'Missing fic_id'
              WHEN words IS NULL THEN 'bad_int:words'
              WHEN status = 'paused' THEN 'bad_status'
              WHEN name IS NULL THEN 'Missing required field: name'
              WHEN language IS NULL THEN 'Missing required field: language' END AS error
  FROM expected),
firsts AS (
  SELECT * FROM judged WHERE error IS NULL
  QUALIFY row_number() OVER (PARTITION BY fic_id ORDER BY o_orderkey) = 1)
"""
