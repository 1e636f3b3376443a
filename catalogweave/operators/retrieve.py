"""Exact cosine retrieval: the k most similar stored vectors per query vector.

The store is scanned once. Every task keeps only the best k per query, so what is
shuffled is queries x k rows per task, never the store itself. Similarities are
rounded to 12 decimals before ranking, which makes ties (equal vectors) exact and
independent of how the rows were split; ties go to the lower id.
"""

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_DECIMALS = 12
BROADCAST_LIMIT_BYTES = 64 << 20
BLOCK_ROWS = 2048
_QUERY_SLICE = 256
_STORE_SLICE = 2048
CELL_BYTES = 32 << 20  # of the vectors of one side of a cell, as doubles
_RESULT_BYTES = 48  # a kept result in a task's state, and once more when it is handed over

CANDIDATE_SCHEMA = "query_id bigint, fic_id bigint, sim double"


def unit_rows(flat, rows: int) -> np.ndarray:
    """Rows of one Arrow list column as DOUBLE unit vectors; zero vectors stay zero."""
    matrix = np.asarray(flat, dtype=np.float64).reshape(rows, -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column; every row must have the same length."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths in one store")
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False), len(column))


class _Best:
    """Running best k (similarity, id) per query of one block of queries."""

    def __init__(self, query_ids, queries, k):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.ids = [np.empty(0, dtype=np.int64)] * len(query_ids)
        self.sims = [np.empty(0)] * len(query_ids)
        self.floor = np.full(len(query_ids), -np.inf)

    def offer(self, ids, vectors):
        for start in range(0, len(self.query_ids), _QUERY_SLICE):
            stop = min(start + _QUERY_SLICE, len(self.query_ids))
            sims = np.round(self.queries[start:stop] @ vectors.T, RANK_DECIMALS)
            sims[self.query_ids[start:stop, None] == ids[None, :]] = -np.inf
            useful = (sims >= self.floor[start:stop, None]) & (sims > -np.inf)
            for row in np.flatnonzero(useful.any(axis=1)):
                keep = useful[row]
                self._merge(start + row, ids[keep], sims[row, keep])

    def _merge(self, q, ids, sims):
        if len(sims) > 4 * self.k:  # sort only what can be among the best, ties included
            keep = sims >= np.partition(sims, len(sims) - self.k)[len(sims) - self.k]
            ids, sims = ids[keep], sims[keep]
        ids, sims = np.concatenate([self.ids[q], ids]), np.concatenate([self.sims[q], sims])
        best = np.lexsort((ids, -sims))[: self.k]
        self.ids[q], self.sims[q] = ids[best], sims[best]
        if len(best) == self.k:
            self.floor[q] = self.sims[q][-1]

    def rows(self):
        counts = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.query_ids, counts)),
                pa.array(np.concatenate(self.ids) if counts else np.empty(0, np.int64)),
                pa.array(np.concatenate(self.sims) if counts else np.empty(0)),
            ],
            ["query_id", "fic_id", "sim"],
        )


def best_per_query(candidates: DataFrame, k: int) -> DataFrame:
    """The k best rows per query with their rank; partial ranks are cut before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "fic_id")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def retrieve_vector(store: DataFrame, query_id: int, vector: list[float], k: int) -> DataFrame:
    """(query_id, fic_id, sim): the k stored works closest to one vector, without the query itself."""
    _require_positive(k)
    queries = unit_rows(vector, 1)
    partial = _scan(store, np.array([query_id], dtype=np.int64), queries, k)
    return partial.orderBy(F.desc("sim"), "fic_id").limit(k)


def retrieve(
    store: DataFrame,
    queries: DataFrame,
    k: int,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, fic_id, sim, place) for every row of ``queries`` (query_id, embedding).

    Queries whose matrix and results stay within ``broadcast_limit`` are shipped to every
    task of the store scan. More queries meet the store in the cells of a balanced grid,
    a group of bounded size each; both ways give the same rows.
    """
    _require_positive(k)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if not size["n"]:
        return store.sparkSession.createDataFrame([], CANDIDATE_SCHEMA + ", place int")
    if size["n"] * (size["dim"] * 8 + k * _RESULT_BYTES) <= broadcast_limit:
        table = queries.select("query_id", "embedding").toArrow().combine_chunks()
        ids = table.column("query_id").combine_chunks().to_numpy()
        partial = _scan(store, ids, _vectors(table.column("embedding").combine_chunks()), k)
    else:
        partial = _block_join(store, queries, size, k, block_rows)
    return best_per_query(partial, k)


def _scan(store, query_ids, queries, k):
    shipped = store.sparkSession.sparkContext.broadcast((query_ids, queries))

    def scan(batches):
        best = _Best(*shipped.value, k)
        for batch in batches:
            if len(batch):
                best.offer(batch.column("fic_id").to_numpy(), _vectors(batch.column("embedding")))
        yield best.rows()

    return store.select("fic_id", "embedding").mapInArrow(scan, CANDIDATE_SCHEMA)


def cell_rows(dim: int, k: int = 0) -> int:
    """How many vectors, or queries with the ``k`` results of each, a cell of a grid may hold."""
    return max(1, CELL_BYTES // max(8 * dim, 8 * k))


def _block_join(store, queries, size, k, block_rows):
    spark = store.sparkSession
    n_queries, n_store, dim = size["n"], store.count(), size["dim"]
    query_blocks, store_blocks = max(1, -(-n_queries // block_rows)), max(1, -(-n_store // block_rows))
    # A grid of groups x salts cells: queries are sent once per salt and stored vectors once per
    # group, and the two volumes are kept about equal. Hashing fills the cells evenly, and their
    # number grows with the data, so no cell does.
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = min(query_blocks, max(1, round(sqrt(tasks * query_blocks / store_blocks))))
    salts = min(store_blocks, max(1, -(-tasks // groups)))
    groups, salts = max(groups, -(-n_queries // cell_rows(dim, k))), max(salts, -(-n_store // cell_rows(dim)))

    def hashed(column, cells):
        return F.pmod(F.xxhash64(column), F.lit(cells)).cast("int")

    def every(cells):
        return F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))

    # New names on both sides: queries are often made from the store itself.
    left = queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("query"), hashed("query_id", groups).alias("group"), every(salts).alias("salt"))
    right = store.select(F.col("fic_id").alias("held"), F.col("embedding").alias("vector"), every(groups).alias("groups"), hashed("fic_id", salts).alias("salts"))
    cells = left.groupBy("group", "salt").cogroup(right.groupBy("groups", "salts"))
    return cells.applyInArrow(compare_cells(k, block_rows), CANDIDATE_SCHEMA)


def compare_cells(k, block_rows):
    """Task-side: the best k of a cell's vectors (held, vector) for each of its queries (id, query), ``block_rows`` queries at a time."""

    def compare(left, right):
        found = [_Best(np.empty(0, np.int64), np.empty((0, 0)), k).rows()]
        if left.num_rows and right.num_rows:
            query_ids, queries = _ids_and_units(left, "id", "query")
            ids, vectors = _ids_and_units(right, "held", "vector")
            for start in range(0, len(query_ids), block_rows):
                best = _Best(query_ids[start : start + block_rows], queries[start : start + block_rows], k)
                for at in range(0, len(ids), _STORE_SLICE):
                    best.offer(ids[at : at + _STORE_SLICE], vectors[at : at + _STORE_SLICE])
                found.append(best.rows())
        return pa.Table.from_batches(found)

    return compare


def _ids_and_units(table: pa.Table, id_column: str, vector_column: str):
    return table.column(id_column).combine_chunks().to_numpy(), _vectors(table.column(vector_column).combine_chunks())


def missing_queries(store: DataFrame, query_ids: DataFrame) -> DataFrame:
    """Asked-for works without a stored vector; batch results leave them out."""
    return query_ids.select("query_id").join(
        store.select(F.col("fic_id").alias("query_id")), "query_id", "left_anti"
    )


def _require_positive(k: int) -> None:
    if k < 1:
        raise ValueError("sizes must be at least 1")
