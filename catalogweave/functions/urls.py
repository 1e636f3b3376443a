"""URL expressions: ids, absolute work addresses and listing pages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import WORKS_PER_LISTING_PAGE

# Fixed value: where the work id stands in a work address.
WORK_ID_PATTERN = r"/works/(\d+)"


def derive_id(url: Column, pattern: str = WORK_ID_PATTERN) -> Column:
    """First id in the URL as BIGINT; NULL when the URL has none."""
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")).try_cast("bigint")


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def work_url(href: Column, base: str, suffix: str = "?view_adult=true") -> Column:
    """Absolute address of a site-relative work link."""
    return F.concat(F.lit(base), href, F.lit(suffix))


def page_count(works: Column, per_page: int = WORKS_PER_LISTING_PAGE) -> Column:
    return F.ceil(works / F.lit(per_page)).cast("int")


def listing_url(seed: Column, page: Column) -> Column:
    return F.concat(strip_query(seed), F.lit("?page="), page.cast("string"))
