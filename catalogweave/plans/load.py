"""The load job: raw works to a published catalogue."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_works, with_missing_columns
from ..operators.merge import new_pairs, upsert_works
from ..operators.normalize import (
    assign_ids,
    count_tags,
    encode_tags,
    explode_tags,
    normalize_works,
    unknown_tags,
    with_identity,
)
from ..operators.quality import check_catalogue, check_delta
from ..operators.summaries import bucket_maxima, merged_maxima, merged_profiles, pair_counts
from ..operators.validate import error_records, judge, valid_rows
from ..schemas import CORE_COLUMNS, TAG_KINDS
from ..session import scratch_scope, staged
from ..sources.catalogue import compact_when_many, read_part, write_core, write_maxima, write_part
from ..sources.manifest import bucket_of, current_snapshot, in_buckets, publish
from ..sources.raw import ORIGIN_COLUMNS, number_rows, read_raw_works, write_invalid


class LoadRejected(RuntimeError):
    """The new snapshot broke a check; the published catalogue is unchanged."""


def load_works(
    spark: SparkSession,
    raw_path: str,
    root: str,
    file_format: str = "csv",
    invalid_path: str | None = None,
    keep_old_when_missing: bool = False,
) -> DataFrame:
    """Load raw files into the catalogue at ``root``; returns the load report."""
    raw = read_raw_works(spark, raw_path, file_format)
    return load_frame(spark, raw, root, invalid_path, keep_old_when_missing)


def load_frame(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    invalid_path: str | None = None,
    keep_old_when_missing: bool = False,
) -> DataFrame:
    """Load a frame of raw works that carries its origin columns.

    Cleaning parses each row once; the result is staged as a table that the seven
    outputs read column by column. Nothing becomes visible before every part is
    written and checked. Intermediate tables are dropped when the load ends.
    """
    with scratch_scope(spark, "load"):
        return _load(spark, with_missing_columns(raw), root, invalid_path, keep_old_when_missing)


def _load(spark, raw, root, invalid_path, keep_old_when_missing) -> DataFrame:
    judged = judge(with_identity(clean_works(raw)))
    rejected = error_records(number_rows(judged, judged.where("error IS NOT NULL")))
    write_invalid(rejected, invalid_path or f"{root.rstrip('/')}/invalid")

    normal = normalize_works(valid_rows(judged), list(ORIGIN_COLUMNS))
    unique = staged(normal.works.select(*CORE_COLUMNS, *TAG_KINDS), "unique")

    snapshot = current_snapshot(spark, root)
    old = {name: read_part(spark, snapshot, name) for name in ("dictionary", "pairs")}
    # Only the buckets of the new works are read, merged and rewritten.
    touched = {r[0] for r in unique.select(bucket_of("fic_id")).distinct().collect()}
    stale, reused = in_buckets(snapshot["parts"].get("core", []), touched)
    stored = read_part(spark, {"parts": {"core": stale}}, "core")
    merged = staged(upsert_works(stored, unique.select(*CORE_COLUMNS), keep_old_when_missing), "merged")
    fresh = write_core(merged, root)

    tags = explode_tags(unique)
    vocabulary = count_tags(tags)
    entries = write_part(assign_ids(vocabulary, old["dictionary"]), root, "dictionary")
    parts = dict(snapshot["parts"], core=reused + fresh)
    parts["dictionary"] = snapshot["parts"].get("dictionary", []) + [entries]
    new = {"version": snapshot["version"], "parts": parts}
    dictionary = read_part(spark, new, "dictionary")

    encoded = staged(encode_tags(tags, dictionary, vocabulary), "pairs")
    pairs = write_part(new_pairs(old["pairs"], encoded), root, "pairs")
    parts["pairs"] = snapshot["parts"].get("pairs", []) + [pairs]
    parts |= _summaries(spark, snapshot, new, merged, pairs, touched, root)

    report = load_report(spark, judged, normal.duplicates, unique, new)
    delta = {"parts": {"core": fresh, "dictionary": [entries], "pairs": [pairs]}}
    failed = check_load(spark, delta, old["dictionary"], vocabulary)
    if failed:
        raise LoadRejected("; ".join(f"{r['check']} on {r['table']}: {r['violations']}" for r in failed))
    publish(spark, root, snapshot, parts)
    compact_when_many(spark, root)
    return spark.createDataFrame(report.collect(), report.schema)  # a few rows, read before scratch is dropped


def _summaries(spark, snapshot, new, merged, pairs, touched, root) -> dict:
    """New parts of the aggregates: the touched buckets and the added pairs only.

    A catalogue from before there were profiles gets them whole on its next load.
    """
    added, before = read_part(spark, {"parts": {"pairs": [pairs]}}, "pairs"), snapshot["parts"]
    if before.get("core") and not before.get("profiles"):
        before, merged, added = {}, read_part(spark, new, "core"), read_part(spark, new, "pairs")
    stale, reused = in_buckets(before.get("profiles", []), touched)
    old = read_part(spark, {"parts": {"profiles": stale}}, "profiles")
    fresh = write_core(merged_profiles(merged, old, added), root, "profiles")
    maxima = bucket_maxima(read_part(spark, {"parts": {"profiles": fresh}}, "profiles"))
    counts = write_part(pair_counts(added), root, "counts")
    return {
        "profiles": reused + fresh,
        "maxima": [write_maxima(merged_maxima(read_part(spark, {"parts": before}, "maxima"), maxima, touched), root)],
        "counts": before.get("counts", []) + [counts],
    }


def check_load(spark: SparkSession, delta: dict, old_dictionary: DataFrame, vocabulary: DataFrame) -> list:
    """Broken checks of what a load adds: a bounded list of (check, table, violations).

    ``delta`` holds the rewritten core buckets and the new parts. Stored rows were
    checked when they were loaded; ``check_published`` checks a whole catalogue.
    """
    core, dictionary, pairs = (read_part(spark, delta, n) for n in ("core", "dictionary", "pairs"))
    checks = check_delta(core, dictionary, pairs, old_dictionary)
    known = old_dictionary.unionByName(dictionary)
    lost = unknown_tags(vocabulary, known).agg(F.count("*").alias("violations"))
    checks = checks.unionByName(
        lost.select(F.lit("tag_known").alias("check"), F.lit("dictionary").alias("table"), "violations")
    )
    return checks.where("violations > 0").collect()


def check_published(spark: SparkSession, root: str) -> DataFrame:
    """Every check over the whole published catalogue, as a job of its own."""
    snapshot = current_snapshot(spark, root)
    return check_catalogue(*(read_part(spark, snapshot, n) for n in ("core", "dictionary", "pairs")))


def load_report(spark, judged, duplicates, unique, snapshot) -> DataFrame:
    """(stage, metric, value) of one load."""

    def metrics(frame, stages):
        """One aggregation of a frame, a row per metric."""
        entries = F.array(
            *[
                F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("metric"), value.cast("bigint").alias("value"))
                for (stage, name), value in stages.items()
            ]
        )
        return frame.agg(entries.alias("entries")).select(F.inline("entries"))

    rejected, lost = F.col("error").isNotNull(), F.col("date_lost")
    rows = [
        metrics(
            judged,
            {
                ("read", "rows"): F.count("*"),
                ("validate", "valid"): F.count_if(~rejected),
                ("validate", "invalid"): F.count_if(rejected),
                ("clean", "unreadable_dates"): F.count_if(lost),
            },
        ),
        metrics(duplicates, {("normalize", "duplicates"): F.max("duplicates")}),
        metrics(unique, {("normalize", "unique"): F.count("*")}),
        *[metrics(read_part(spark, snapshot, n), {(n, "rows"): F.count("*")}) for n in ("core", "dictionary", "pairs")],
    ]
    return reduce(DataFrame.unionByName, rows)
