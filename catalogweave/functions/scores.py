"""Similarity and score expressions over columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SCORE_WEIGHTS


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vector columns in DOUBLE; 0 when either is a zero vector."""

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(
        total(F.transform(b, lambda x: x * x))
    )
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot / F.nullif(norms, F.lit(0.0)))


def jaccard_from_counts(shared: Column, left: Column, right: Column) -> Column:
    """Jaccard from set sizes; two empty sets count as equal (1.0)."""
    union = left + right - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.nullif(union, F.lit(0)))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two array columns; a NULL array counts as empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.nullif(union, F.lit(0)))


def min_max_normalize(value: Column, low, high) -> Column:
    """Position of ``value`` between two bounds; 0 when the bounds are equal."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    span = high - low
    return F.when(span == 0, F.lit(0.0)).otherwise((value - low) / F.nullif(span, F.lit(0)))


def popularity_score(kudos: Column, bookmarks: Column) -> Column:
    """Mean of two normalised counts."""
    return (kudos + bookmarks) / 2


def final_score(sim, fandom, relationship, popularity, weights=None) -> Column:
    """Weighted sum of the four components; weights default to the fixed values."""
    w = {**SCORE_WEIGHTS, **(weights or {})}
    return (
        F.lit(w["embedding"]) * sim
        + F.lit(w["fandom"]) * fandom
        + F.lit(w["relationship"]) * relationship
        + F.lit(w["popularity"]) * popularity
    )
