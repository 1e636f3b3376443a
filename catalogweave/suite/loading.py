"""The load job end to end: raw files on disk to published tables."""

from pyspark.sql import functions as F

from ..plans.load import load_frame, load_works
from ..schemas import CORE_COLUMNS, RAW_COLUMNS, TAG_KINDS, TAG_TABLES
from ..session import scratch_path, staged
from ..sources.catalogue import read_dictionary, read_profiles, read_table, read_tag_counts
from ..sources.raw import append_raw_works, read_raw_works
from ..streaming.ingest import start_ingest
from .inputs import CLEAN_WORKS_SQL, raw_works


ROWS_PER_FILE = 200_000  # about 60 MB: a file is one task for its readers


def _raw_files(spark, sf_dir):
    path = scratch_path(spark, "raw")
    ordered = raw_works(spark, sf_dir, sort=True)
    append_raw_works(ordered.select(*RAW_COLUMNS), path, "csv", rows_per_file=ROWS_PER_FILE)
    return path


def _loaded(spark, sf_dir):
    root = scratch_path(spark, "catalogue")
    report = load_works(spark, _raw_files(spark, sf_dir), root)
    return root, report


def loaded_core(spark, sf_dir):
    return read_table(spark, _loaded(spark, sf_dir)[0], "fics").select(*CORE_COLUMNS)


def loaded_tags(spark, sf_dir):
    """Every stored pair with its value, kind by kind, through the named tables."""
    root, _ = _loaded(spark, sf_dir)
    frames = []
    for kind in TAG_KINDS:
        dictionary, pairs, id_column, value_column = TAG_TABLES[kind]
        joined = read_table(spark, root, pairs).join(read_table(spark, root, dictionary), id_column)
        frames.append(
            joined.select("fic_id", F.lit(kind).alias("kind"), F.col(id_column).alias("id"), F.col(value_column).alias("value"))
        )
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def loaded_dictionary(spark, sf_dir):
    return read_dictionary(spark, _loaded(spark, sf_dir)[0], "character")


def load_metrics(spark, sf_dir):
    return _loaded(spark, sf_dir)[1]


def rejected_file(spark, sf_dir):
    root, _ = _loaded(spark, sf_dir)
    rows = spark.read.option("header", "true").schema("row_number BIGINT, fic_id BIGINT, error STRING").csv(f"{root}/invalid")
    return rows.groupBy("fic_id", "error").agg(F.count("*").alias("n"))


def streamed_core(spark, sf_dir):
    root = scratch_path(spark, "catalogue")
    query = start_ingest(spark, _raw_files(spark, sf_dir), root, scratch_path(spark, "stream"))
    query.awaitTermination()
    return read_table(spark, root, "fics").select(*CORE_COLUMNS)


def _loaded_in_three(spark, sf_dir):
    """Three loads of a third of the works each; the third comes with works of the first once more."""
    root = scratch_path(spark, "catalogue")
    raw = staged(read_raw_works(spark, _raw_files(spark, sf_dir)), "raw-rows")  # the CSV is parsed once, not once a load
    third = F.pmod(F.crc32("url"), F.lit(3))
    for batch in (raw.where(third == 0), raw.where(third == 1), raw.where(third != 1)):
        load_frame(spark, batch, root)
    return root


def profiles_after_loads(spark, sf_dir):
    """Every work's profile as the loads kept it, with the maxima over all works."""
    profiles, maxima = read_profiles(spark, _loaded_in_three(spark, sf_dir))
    top = maxima.select(F.struct("max_kudos", "max_bookmarks")).scalar()
    sizes = [F.size(k).alias(f"n_{k}") for k in ("fandom", "relationship")]
    return profiles.withColumn("top", top).select("fic_id", "kudos", "bookmarks", *sizes, "top.max_kudos", "top.max_bookmarks")


def tag_counts_after_loads(spark, sf_dir):
    root = _loaded_in_three(spark, sf_dir)
    counts = read_tag_counts(spark, root, "character").withColumnRenamed("id", "characters_id")
    return read_dictionary(spark, root, "character").join(counts, "characters_id").select("characters", "works")


QUERIES = {
    "profiles_after_loads": profiles_after_loads,
    "tag_counts_after_loads": tag_counts_after_loads,
    "csv_roundtrip_load": loaded_core,
    "load_tags": loaded_tags,
    "read_dictionary": loaded_dictionary,
    "load_report": load_metrics,
    "write_invalid": rejected_file,
    "streaming_load": streamed_core,
}

_CORE = ", ".join(CORE_COLUMNS)
_WORKS = f"WITH {CLEAN_WORKS_SQL}"
_TAGS = "tag AS (" + " UNION ".join(
    f"SELECT fic_id, '{k}' AS kind, unnest(string_split({k}, '|')) AS value FROM firsts WHERE {k} <> ''"
    for k in TAG_KINDS
) + ")"

ORACLES = {
    "csv_roundtrip_load": f"{_WORKS} SELECT {_CORE} FROM firsts",
    "streaming_load": f"{_WORKS} SELECT {_CORE} FROM firsts",
    "profiles_after_loads": f"""{_WORKS}, {_TAGS},
        n AS (SELECT fic_id, count(DISTINCT value) FILTER (WHERE kind = 'fandom')::INT AS n_fandom,
                     count(DISTINCT value) FILTER (WHERE kind = 'relationship')::INT AS n_relationship FROM tag GROUP BY fic_id)
        SELECT f.fic_id, kudos, bookmarks, coalesce(n_fandom, 0) AS n_fandom, coalesce(n_relationship, 0) AS n_relationship,
               max(kudos) OVER () AS max_kudos, max(bookmarks) OVER () AS max_bookmarks
        FROM firsts f LEFT JOIN n ON n.fic_id = f.fic_id""",
    "tag_counts_after_loads": f"""{_WORKS}, {_TAGS}
        SELECT value AS characters, count(DISTINCT fic_id) AS works FROM tag WHERE kind = 'character' GROUP BY value""",
    "load_tags": f"""{_WORKS}, {_TAGS}
        SELECT fic_id, kind, dense_rank() OVER (PARTITION BY kind ORDER BY value)::INT AS id, value FROM tag""",
    "read_dictionary": f"""{_WORKS}, {_TAGS}, v AS (SELECT DISTINCT value FROM tag WHERE kind = 'character')
        SELECT row_number() OVER (ORDER BY value)::INT AS characters_id, value AS characters FROM v""",
    "write_invalid": f"""{_WORKS} SELECT fic_id, error, count(*) AS n FROM judged WHERE error IS NOT NULL GROUP BY 1, 2""",
    "load_report": f"""{_WORKS}, {_TAGS}
        SELECT 'read' AS stage, 'rows' AS metric, count(*) AS value FROM judged
        UNION ALL SELECT 'validate', 'valid', count(*) FROM judged WHERE error IS NULL
        UNION ALL SELECT 'validate', 'invalid', count(*) FROM judged WHERE error IS NOT NULL
        UNION ALL SELECT 'clean', 'unreadable_dates', count(*) FROM judged WHERE last_date IS NULL
        UNION ALL SELECT 'normalize', 'duplicates', count(*) - (SELECT count(*) FROM firsts) FROM judged WHERE error IS NULL
        UNION ALL SELECT 'normalize', 'unique', count(*) FROM firsts
        UNION ALL SELECT 'core', 'rows', count(*) FROM firsts
        UNION ALL SELECT 'dictionary', 'rows', count(*) FROM (SELECT DISTINCT kind, value FROM tag)
        UNION ALL SELECT 'pairs', 'rows', count(*) FROM tag""",
}
