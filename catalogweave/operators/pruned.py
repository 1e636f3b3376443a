"""All pairs of stored vectors above a similarity, exactly, with most products never computed.

Bounds come first, products last:

* Axes. The store's second moments, summed in one pass, give an orthonormal basis that puts as
  much of the vectors' length as possible into the leading coordinates. Turning all vectors changes no
  similarity.
* Parts. Vectors are ranked by their first coordinate and cut into parts of equal size, ties
  included. Two vectors further apart in any coordinate than the chord of the threshold cannot
  match, so parts whose intervals are further apart never meet, nor do slices of them. Where
  most parts would meet, ranks are dealt to the parts in turn instead: copies of a vector, and with
  them the matches, are then spread over all cells, and slices of a part are kept apart as before.
* Leading coordinates. What two vectors have in common is at most the product of their leading
  coordinates plus the product of the lengths of the rest (Cauchy-Schwarz). Pairs whose bound
  stays below the threshold are dropped after an eighth, a quarter or half of the coordinates.

Only the pairs that are left are multiplied out, from the stored vectors, and compared after
rounding as everywhere else, so the result equals ``pairwise_similarity``. Where bounds leave many
pairs of a slice, one matrix product of the slice costs less than gathering them: first in single
precision, less its largest error, and in double precision where that too leaves many. Where the
moments show that even unrelated pairs would stay, nothing is bounded and every slice is multiplied
whole. ``pairwise_work`` counts what was bounded and what the bounds left.

A task holds two parts and one batch of matches: matches leave it slice by slice, so its memory
does not grow with their number. Every cell is a partition of its own, since the work of a cell
grows with the square of the bytes by which adaptive execution would merge them.
"""

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairwise import PART_BYTES, grid_parts
from .ranges import with_position
from .retrieve import RANK_DECIMALS, _vectors

MOST_DIMS = 1024  # beyond that the stored axes are used: a basis has dims x dims numbers
SLACK = 1e-9  # room for rounding in a bound
_SLICE = 512
_GATHERED = 1 << 12  # pairs multiplied one by one at a time: they stay in the processor's cache
_EMITTED = 1 << 16  # matches from which a batch is handed over
_SHARE = 0.05  # share of a slice's pairs from which more coordinates, or one product of all, cost less than gathering
_CELL_PAIRS = 1 << 20  # fewer pairs are not worth a task
_CELLS_PER_CORE = 8
_MEETING = 0.75  # share of the cells from which keeping neighbours together in a part saves too little

_PAIRS = "left_id bigint, right_id bigint, sim double"
_WORK = "bounded bigint, products bigint"


def leading_axes(store: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal basis as columns, the axis along which the vectors are longest first, and the squared lengths along each."""
    if dim > MOST_DIMS:
        return np.eye(dim), np.zeros(dim)

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                units = _vectors(batch.column("embedding"))
                total += units.T @ units
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "value"])

    sums = store.select("embedding").mapInArrow(moments, "cell long, value double")
    found = sums.groupBy("cell").agg(F.sum("value").alias("value")).toPandas().sort_values("cell")  # dim x dim numbers
    lengths, axes = np.linalg.eigh(found["value"].to_numpy().reshape(dim, dim))
    return axes[:, ::-1].copy(), lengths[::-1].copy()


def bound_levels(dim: int) -> list[int]:
    """Numbers of leading coordinates after which pairs are bounded."""
    return sorted({0, *(max(1, dim // part) for part in (8, 4, 2))})


def useful_levels(lengths: np.ndarray, rows: int, threshold: float) -> list[int]:
    """The levels, or none where the bound of two vectors without anything in common mostly reaches the threshold.

    Their bound is the product of the lengths of the rest, about the mean squared length beyond the last level.
    """
    levels = bound_levels(len(lengths))
    return levels if lengths[levels[-1] :].sum() / rows < threshold else levels[:1]


class _Side:
    """Vectors of one part: ids, units, turned coordinates, units in single precision and the lengths of what follows each level."""

    def __init__(self, ids, units, axes, levels):
        turned = units @ axes[:, : max(1, levels[-1])]
        order = np.argsort(turned[:, 0], kind="stable")
        self.ids, self.units, self.turned = ids[order], units[order], turned[order]
        self.singles = self.units.astype(np.float32)
        lengths = (self.units**2).sum(axis=1)
        self.rest = {k: np.sqrt(np.maximum(lengths - (self.turned[:, :k] ** 2).sum(axis=1), 0)) for k in levels[1:]}


def single_slack(dim: int) -> float:
    """At least the error of a product of two unit vectors in single precision: 2**-24 for each rounding of a term or a sum."""
    return (dim + 8) * 2.0**-24


def _multiplied(left: np.ndarray, right: np.ndarray, least):
    """(rows, columns, sims) of the pairs from ``least``, by one product of all."""
    sims = (left @ right.T).ravel()
    found = np.flatnonzero(sims >= least)
    rows, columns = np.divmod(found, len(right))
    return rows, columns, sims[found]


def _gathered(left: np.ndarray, right: np.ndarray, alive: np.ndarray):
    """(rows, columns, sims) of the pairs that are left."""
    rows, columns = np.divmod(np.flatnonzero(alive), len(right))
    sims = np.empty(len(rows))
    for at in range(0, len(rows), _GATHERED):
        part = slice(at, at + _GATHERED)
        np.einsum("ij,ij->i", left[rows[part]], right[columns[part]], out=sims[part])
    return rows, columns, sims


def _matches(left: _Side, a: slice, right: _Side, b: slice, levels, threshold):
    """(rows, columns, sims, bounded, products) of two slices; ``rows`` and ``columns`` count from their starts."""
    one, two = left.units[a], right.units[b]
    dots, alive, bounded = 0, None, 0
    many = products = len(one) * len(two)
    for low, high in zip(levels, levels[1:]):
        dots = dots + left.turned[a, low:high] @ right.turned[b, low:high].T
        alive = dots + left.rest[high][a, None] * right.rest[high][None, b] >= threshold - SLACK
        bounded, products = many, int(np.count_nonzero(alive))
        if products <= _SHARE * many:
            break
    if alive is None or products > _SHARE * many:
        alive = left.singles[a] @ right.singles[b].T >= np.float32(threshold - SLACK - single_slack(one.shape[1]))
    if np.count_nonzero(alive) <= _SHARE * many:
        rows, columns, sims = _gathered(one, two, alive)
    else:
        rows, columns, sims = _multiplied(one, two, threshold - SLACK)
    sims = np.round(sims, RANK_DECIMALS)
    keep = sims >= threshold
    return rows[keep], columns[keep], sims[keep], bounded, products


def _compared_slices(key, batches, axes, levels, threshold):
    """(left_ids, right_ids, sims, bounded, products) of every two slices that may match."""
    chord = sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    low, high = key[1].as_py(), key[2].as_py()
    group = pa.Table.from_batches(list(batches)).combine_chunks()
    ids, units = group.column("fic_id").to_numpy(), _vectors(group.column("embedding").combine_chunks())
    first = group.column("part").to_numpy() == low
    left = _Side(ids[first], units[first], axes, levels)
    right = left if low == high else _Side(ids[~first], units[~first], axes, levels)
    del group, ids, units
    for at in range(0, len(left.ids), _SLICE):
        a = slice(at, at + _SLICE)
        near, far = left.turned[a, 0][0] - chord, left.turned[a, 0][-1] + chord
        begin = at if right is left else int(np.searchsorted(right.turned[:, 0], near))
        end = int(np.searchsorted(right.turned[:, 0], far, side="right"))
        for other in range(begin, end, _SLICE):
            b = slice(other, min(other + _SLICE, end))
            rows, columns, sims, bounded, products = _matches(left, a, right, b, levels, threshold)
            one, two = left.ids[a][rows], right.ids[b][columns]
            if right is left and at == other:  # a slice with itself: each pair once
                upper = rows < columns
                one, two, sims = one[upper], two[upper], sims[upper]
            yield np.minimum(one, two), np.maximum(one, two), sims, bounded, products


def _emit_pairs(slices):
    """Batches of matches, handed over as soon as they are large enough."""
    held, count = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(column)) for column in zip(*held)], ["left_id", "right_id", "sim"])

    for *pairs, _, _ in slices:
        held.append(pairs)
        count += len(pairs[0])
        if count >= _EMITTED:
            yield batch()
            held, count = [], 0
    if held:
        yield batch()


def _emit_work(slices):
    """One row: what was bounded, and what the bounds left to be multiplied out."""
    totals = np.zeros(2, np.int64)
    for *_, bounded, products in slices:
        totals += (bounded, products)
    yield pa.RecordBatch.from_arrays([pa.array([n]) for n in totals.tolist()], ["bounded", "products"])


def _compare(axes: np.ndarray, levels: list[int], threshold: float, emit):
    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(_compared_slices(key, batches, axes, levels, threshold))

    return compare


def _cells(store: DataFrame, rows: int) -> int:
    """Cells wanted: a few per core, so that the last ones do not keep the others waiting, but none too small for a task."""
    spark = store.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _CELLS_PER_CORE * spark.sparkContext.defaultParallelism)
    return min(tasks, ceil(rows**2 / 2 / _CELL_PAIRS))


def _compared(store: DataFrame, min_similarity: float, part_bytes: int, emit, schema: str) -> DataFrame:
    if not min_similarity > 0:
        raise ValueError("min_similarity must be above 0")
    spark = store.sparkSession
    size = store.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if size["n"] < 2:
        return spark.createDataFrame([], schema)
    axes, lengths = leading_axes(store, size["dim"])
    first, levels = axes[:, 0], useful_levels(lengths, size["n"], min_similarity)

    def project(batches):
        for batch in batches:
            places = _vectors(batch.column("embedding")) @ first if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], ["fic_id", "embedding", "place"])

    fields = f"fic_id bigint, embedding {store.schema['embedding'].dataType.simpleString()}, place double"
    placed = store.select(F.col("fic_id").cast("bigint"), "embedding").mapInArrow(project, fields)
    parts = grid_parts(size["n"], size["dim"], _cells(store, size["n"]), part_bytes)
    per = ceil(size["n"] / parts)
    ranked = with_position(placed, ["place", "fic_id"])
    dealt = ranked.withColumn("part", F.expr(f"cast(position div {per} as int)"))
    # One interval per part, about the square root of twice the tasks.
    spans = dealt.groupBy("part").agg(F.min("place").alias("low"), F.max("place").alias("high")).orderBy("part").collect()
    chord = sqrt(max(0.0, 2 - 2 * min_similarity)) + SLACK
    cells = [
        (a["part"], b["part"])
        for a in spans
        for b in spans
        if a["part"] <= b["part"] and a["low"] <= b["high"] + chord and b["low"] <= a["high"] + chord
    ]
    everything = [(low, high) for high in range(len(spans)) for low in range(high + 1)]
    if len(cells) > _MEETING * len(everything):
        cells, dealt = everything, ranked.withColumn("part", F.expr(f"cast(position % {len(spans)} as int)"))
    meets = [(part, cell, low, high) for cell, (low, high) in enumerate(cells) for part in {low, high}]
    partners = spark.createDataFrame(meets, "part int, cell int, low int, high int")
    met = dealt.join(F.broadcast(partners), "part").select("cell", "low", "high", "part", "fic_id", "embedding")
    dealt_out = met.repartitionById(len(cells), "cell")
    return dealt_out.groupBy("cell", "low", "high").applyInArrow(_compare(axes, levels, min_similarity, emit), schema)


def pairwise_pruned(store: DataFrame, min_similarity: float, part_bytes: int = PART_BYTES) -> DataFrame:
    """(left_id, right_id, sim) with left_id < right_id and sim >= min_similarity, which must be above 0."""
    return _compared(store, min_similarity, part_bytes, _emit_pairs, _PAIRS)


def pairwise_work(store: DataFrame, min_similarity: float, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row (bounded, products): pairs that were bounded by leading coordinates, and pairs left to be multiplied out."""
    found = _compared(store, min_similarity, part_bytes, _emit_work, _WORK)
    zero = F.lit(0).cast("bigint")
    return found.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("bounded", "products")])
