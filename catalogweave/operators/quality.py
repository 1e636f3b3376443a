"""Checks over a catalogue; each row of the result is one check with its violation count."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CORE_TABLE, REQUIRED_COLUMNS, TAG_KINDS, TAG_TABLES


def _row(frame: DataFrame, check: str, table: str, violations) -> DataFrame:
    counted = frame.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"))
    return counted.select(F.lit(check).alias("check"), F.lit(table).alias("table"), "violations")


def _per_kind(frame: DataFrame, check: str, position: int) -> DataFrame:
    """Violations counted per kind, one row for each kind even when it has none."""
    names = F.create_map(*[F.lit(x) for k in TAG_KINDS for x in (k, TAG_TABLES[k][position])])
    counts = frame.groupBy().pivot("kind", list(TAG_KINDS)).agg(F.sum("violations"))
    cells = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("violations")) for k in TAG_KINDS]
    rows = counts.select(F.inline(F.array(*cells)))
    return rows.select(
        F.lit(check).alias("check"),
        names[F.col("kind")].alias("table"),
        F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"),
    )


def check_core(core: DataFrame, table: str = CORE_TABLE) -> DataFrame:
    """Ids present and unique, required columns present."""
    missing = F.count_if(F.col("fic_id").isNull())
    columns = [c for c in REQUIRED_COLUMNS if c in core.columns]
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False))
    repeats = core.where("fic_id is not null").groupBy("fic_id").agg(F.count("*").alias("n"))
    return (
        _row(core, "id_not_null", table, missing)
        .unionByName(_row(core, "required_not_null", table, F.count_if(absent)))
        .unionByName(_row(repeats, "id_unique", table, F.sum(F.col("n") - 1)))
    )


def check_pairs(core: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair's work exists; no pair is stored twice."""
    # Reduced to one row per work before the join, so a work with very many tags
    # weighs no more than any other.
    per_work = pairs.groupBy("kind", "fic_id").agg(F.count("*").alias("violations"))
    orphans = per_work.join(core.select("fic_id"), "fic_id", "left_anti")
    copies = pairs.groupBy("kind", "fic_id", "id").agg((F.count("*") - 1).alias("violations"))
    return _per_kind(orphans, "work_exists", 1).unionByName(_per_kind(copies, "pair_unique", 1))


def check_dictionary(dictionary: DataFrame) -> DataFrame:
    """No value is stored twice, under whatever ids; no id is given twice."""
    entries = dictionary.groupBy("kind", "value").agg((F.count("*") - 1).alias("violations"))
    ids = dictionary.groupBy("kind", "id").agg((F.count("*") - 1).alias("violations"))
    return _per_kind(entries, "entry_unique", 0).unionByName(_per_kind(ids, "dictionary_id_unique", 0))


def empty_pair_tables(pairs: DataFrame) -> DataFrame:
    """Warning only: pair tables without rows."""
    counts = pairs.groupBy("kind").agg(F.count("*").alias("violations"))
    rows = _per_kind(counts, "not_empty", 1)
    return rows.withColumn("violations", (F.col("violations") == 0).cast("bigint"))


def check_catalogue(core: DataFrame, dictionary: DataFrame, pairs: DataFrame) -> DataFrame:
    """All checks that must hold before a catalogue is published."""
    return (
        check_core(core)
        .unionByName(check_pairs(core, pairs))
        .unionByName(check_dictionary(dictionary))
    )


def check_delta(core: DataFrame, dictionary: DataFrame, pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """All checks of a load's own rows, given the ``stored`` dictionary.

    ``core`` is whole buckets, so an id occurs in it as often as in the catalogue; the new
    pairs belong to works of those buckets. New dictionary rows are held against each other
    and against stored values and ids.
    """
    both = (("entry_known", "value"), ("id_known", "id"))
    taken = [
        _per_kind(
            dictionary.join(stored.select("kind", column), ["kind", column], "left_semi")
            .groupBy("kind")
            .agg(F.count("*").alias("violations")),
            check,
            0,
        )
        for check, column in both
    ]
    return reduce(DataFrame.unionByName, taken, check_catalogue(core, dictionary, pairs))
