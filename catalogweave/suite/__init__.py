"""Named queries over the driver tables, each with its SQL oracle where SQL can say it."""

from . import cleaning, loading, merging, page_sql, pages, profiling, recommending, scanning, tagging

GROUPS = (recommending, cleaning, pages, page_sql, tagging, merging, profiling, loading, scanning)


def all_queries() -> dict:
    return {name: run for group in GROUPS for name, run in group.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
