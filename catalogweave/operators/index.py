"""A retrieval index: lists around centroids, visited until the k-th best certifies the rest.

Vectors are dealt to the closest of a bounded number of centroids, taken from the store by a hash
order. A list knows its smallest and largest angle to the centroid, so the angle between a query and any of
its vectors is at least ``query_angle - high`` and at least ``low - query_angle``; and as no
other centroid is closer to them, it is at least half of what the query is further from this
centroid than from its closest one (all by the triangle inequality). A search has two rounds:

1. Every query visits its lists in the order of their bounds until they hold ``k`` vectors
   besides itself. The k-th best similarity found is a floor for the result.
2. Of all other lists only those whose bound reaches the floor are visited. The rest is certified
   to hold nothing better, so the result equals a scan of the whole store, ties included.

Queries and vectors meet list by list: a list and its visitors are cut into cells of bounded size, each
a key of its own, so a crowded list is many tasks. The index stores its lists as folders, and a search for one
vector reads only the folders it visits.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from .retrieve import BLOCK_ROWS, CANDIDATE_SCHEMA, _require_positive, _vectors, best_per_query, cell_rows, compare_cells

LISTS = 256
MOST_LISTS = 4096
SLACK = 1e-7  # room for rounding in an angle, in radians; stored vectors may be single precision


@dataclass
class VectorIndex:
    """``vectors`` (fic_id, embedding, list, angle); ``lists`` (list, centroid, low, high, n) has a row per list."""

    vectors: DataFrame
    lists: DataFrame


def _angles(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroids.T, -1.0, 1.0))


def build_index(store: DataFrame, lists: int = LISTS) -> VectorIndex:
    """Deal (fic_id, embedding) to ``lists`` centroids, at most ``MOST_LISTS``; zero vectors are as far from all."""
    lists = max(1, min(lists, MOST_LISTS))
    # A bounded sample: the centroids decide what is skipped, never what is found.
    chosen = store.select("embedding", F.xxhash64("fic_id").alias("h")).orderBy("h").limit(lists).select("embedding").toArrow()
    if not len(chosen):
        empty = store.select("fic_id", "embedding", F.lit(0).alias("list"), F.lit(0.0).alias("angle"))
        return VectorIndex(empty, store.sparkSession.createDataFrame([], "list int, centroid array<double>, low double, high double, n long"))
    centroids = _vectors(chosen.column("embedding").combine_chunks())

    def deal(batches):
        for batch in batches:
            if len(batch):
                angles = _angles(_vectors(batch.column("embedding")), centroids)
                nearest = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angles[np.arange(len(batch)), nearest])],
                    ["fic_id", "embedding", "list", "angle"],
                )

    schema = f"fic_id bigint, embedding {store.schema['embedding'].dataType.simpleString()}, list int, angle double"
    dealt = staged(store.select(F.col("fic_id").cast("bigint"), "embedding").mapInArrow(deal, schema), "index-vectors")
    found = dealt.groupBy("list").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    # Plain Python numbers: a session without Arrow conversion takes no others.
    rows = [(number, centroid.tolist()) for number, centroid in enumerate(centroids)]
    centres = store.sparkSession.createDataFrame(rows, "list int, centroid array<double>")
    return VectorIndex(dealt, staged(centres.join(found, "list"), "index-lists"))


def write_index(index: VectorIndex, path: str) -> None:
    """Store an index: a folder per list, and the table of lists last."""
    # A crowded list is written by several tasks; a list never has more files than blocks.
    spread = F.pmod(F.xxhash64("fic_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)))
    sized = index.vectors.join(index.lists.select("list", "n"), "list")
    ordered = sized.withColumn("piece", spread).repartition("list", "piece").sortWithinPartitions("list", "angle")
    ordered.drop("n", "piece").write.partitionBy("list").parquet(f"{path}/vectors")
    index.lists.write.parquet(f"{path}/lists")


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    vectors = spark.read.parquet(f"{path}/vectors").select("fic_id", "embedding", "list", "angle")
    return VectorIndex(vectors, spark.read.parquet(f"{path}/lists"))


class _Lists:
    """The table of lists on the driver and in the tasks; at most ``MOST_LISTS`` rows."""

    def __init__(self, table: DataFrame):
        rows = table.orderBy("list").toArrow().combine_chunks()
        self.numbers = rows.column("list").to_numpy()
        self.centroids = np.array(rows.column("centroid").to_pylist(), dtype=np.float64)
        self.low, self.high, self.n = (rows.column(c).to_numpy() for c in ("low", "high", "n"))

    def bounds(self, units: np.ndarray) -> np.ndarray:
        """The largest similarity that a vector of each list can have to each query."""
        angles = _angles(units, self.centroids)
        ring = np.maximum(angles - self.high, self.low - angles)
        side = (angles - angles.min(axis=1, keepdims=True)) / 2
        least = np.maximum(np.maximum(ring, side) - SLACK, 0.0)
        found = np.cos(least)
        found[~units.any(axis=1)] = 0.0  # a zero vector has similarity zero to all
        return np.maximum(found, 0.0)  # and zero vectors may be in any list

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Which lists each query visits first: in the order of their bounds, until they hold k + 1 vectors."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        visited = np.zeros(bounds.shape, bool)
        np.put_along_axis(visited, order, before < k + 1, axis=1)
        return visited


def retrieve_vector_indexed(index: VectorIndex, query_id: int, vector: list[float], k: int) -> DataFrame:
    """(query_id, fic_id, sim): as ``retrieve_vector`` on the whole store, reading only the lists that may matter."""
    spark = index.vectors.sparkSession
    queries = spark.createDataFrame([(query_id, [float(x) for x in vector])], "query_id long, embedding array<double>")
    return retrieve_indexed(index, queries, k).select("query_id", "fic_id", "sim")


def retrieve_indexed(index: VectorIndex, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, fic_id, sim, place) for every row of ``queries`` (query_id, embedding): equal to ``retrieve``."""
    return best_per_query(_searched(index, queries, k, block_rows)[0], k)


def lists_read(index: VectorIndex, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, visited): how many lists the search of each query reads."""
    probes = _searched(index, queries, k, block_rows)[1]
    return probes.groupBy("query_id").agg(F.count("*").alias("visited"))


def _searched(index: VectorIndex, queries: DataFrame, k: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    _require_positive(k)
    spark = queries.sparkSession
    lists = _Lists(index.lists)
    if not len(lists.numbers):
        return spark.createDataFrame([], CANDIDATE_SCHEMA), spark.createDataFrame([], "query_id long, list int")
    queries = queries.select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    dim = lists.centroids.shape[1]

    def visits(second: bool):
        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                bounds = lists.bounds(_vectors(batch.column("embedding")))
                chosen = lists.first(bounds, k)
                if second:
                    floor = np.array([-np.inf if f is None else f for f in batch.column("floor").to_pylist()])
                    chosen = ~chosen & (bounds >= floor[:, None] - SLACK)
                rows, columns = np.nonzero(chosen)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(at), batch.column("embedding").take(at), pa.array(lists.numbers[columns], pa.int32())],
                    ["query_id", "embedding", "list"],
                )

        return run

    schema = "query_id bigint, embedding array<double>, list int"
    near = staged(queries.mapInArrow(visits(False), schema), "index-first")
    found = staged(_met(index, near, dim, k, block_rows), "index-found")
    # The k-th best so far; a query that has not k yet must look everywhere.
    floors = best_per_query(found, k).where(F.col("place") == k).select("query_id", F.col("sim").alias("floor"))
    again = queries.join(floors, "query_id", "left").select("query_id", "embedding", "floor")
    rest = staged(again.mapInArrow(visits(True), schema), "index-second")
    whole = found.unionByName(_met(index, rest, dim, k, block_rows))
    return whole, near.select("query_id", "list").unionByName(rest.select("query_id", "list"))


def _met(index: VectorIndex, probes: DataFrame, dim: int, k: int, block_rows: int) -> DataFrame:
    """The best k of each visited list for each of its visitors, in cells of bounded size."""
    visitors = probes.groupBy("list").agg(F.count("*").alias("visitors"))
    query_cells, cells = (F.ceil(F.col(n) / most).cast("int") for n, most in (("visitors", cell_rows(dim, k)), ("n", cell_rows(dim))))
    sized = visitors.join(index.lists.select("list", "n"), "list").select("list", query_cells.alias("qs"), cells.alias("cs"))
    place = lambda id_column, n: F.pmod(F.xxhash64(id_column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    list_ = lambda name: F.col("list").alias(name)
    asked = probes.join(sized, "list").select(F.col("query_id").alias("id"), F.col("embedding").alias("query"), list_("a"), place("query_id", "qs").alias("q"), every("cs").alias("c"))
    held = index.vectors.join(sized, "list").select(F.col("fic_id").alias("held"), F.col("embedding").alias("vector"), list_("b"), every("qs").alias("x"), place("fic_id", "cs").alias("y"))
    met = asked.groupBy("a", "q", "c").cogroup(held.groupBy("b", "x", "y"))
    return met.applyInArrow(compare_cells(k, block_rows), CANDIDATE_SCHEMA)
