"""All pairs of stored vectors above a similarity, exactly.

Vectors are dealt into p parts by a hash of their id, and every two parts meet in one
cell of a triangular grid, so each vector is sent p times and p is about the square root
of twice the number of tasks: the shuffle carries n x sqrt(2 x tasks) vectors, however many
pairs are compared. A part holds a bounded number of vectors, and equal or similar vectors
are spread like any others. Only pairs above the threshold ever leave a task.
"""

from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import RANK_DECIMALS, _vectors

PART_BYTES = 32 << 20
_SLICE = 1024

PAIR_SCHEMA = "left_id bigint, right_id bigint, sim double"


def grid_parts(rows: int, dim: int, tasks: int, part_bytes: int = PART_BYTES) -> int:
    """Number of parts: enough cells for the tasks, and no part above ``part_bytes``."""
    return max(1, min(rows, ceil(sqrt(2 * tasks))), ceil(rows * dim * 4 / part_bytes))


def grid_cells(store: DataFrame, parts: int) -> DataFrame:
    """Every vector once per cell it takes part in: (low, high, part, fic_id, embedding)."""
    part = F.pmod(F.xxhash64("fic_id"), F.lit(parts)).cast("int")
    dealt = store.select("fic_id", "embedding", part.alias("part"))
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other")
    met = dealt.select("*", other)
    return met.select(F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "fic_id", "embedding")


def pairwise_similarity(store: DataFrame, min_similarity: float, part_bytes: int = PART_BYTES) -> DataFrame:
    """(left_id, right_id, sim) with left_id < right_id and sim >= min_similarity, which must be above 0.

    A threshold at or below 0 would return nearly all pairs and is refused.
    """
    if not min_similarity > 0:
        raise ValueError("min_similarity must be above 0")
    spark = store.sparkSession
    size = store.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if size["n"] < 2:
        return spark.createDataFrame([], PAIR_SCHEMA)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cells = grid_cells(store, grid_parts(size["n"], size["dim"], tasks, part_bytes))
    return cells.groupBy("low", "high").applyInArrow(_compare(min_similarity), PAIR_SCHEMA)


def _compare(min_similarity: float):
    def compare(key: tuple, group: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        group = group.combine_chunks()
        ids = group.column("fic_id").to_numpy()
        units = _vectors(group.column("embedding").combine_chunks())
        first = group.column("part").to_numpy() == low
        a_ids, b_ids = ids[first], ids if low == high else ids[~first]
        a, b = units[first], units if low == high else units[~first]
        found = []
        for at in range(0, len(a_ids), _SLICE):
            sims = np.round(a[at : at + _SLICE] @ b.T, RANK_DECIMALS)
            wanted = sims >= min_similarity
            if low == high:
                wanted &= a_ids[at : at + _SLICE, None] < b_ids[None, :]
            rows, columns = np.nonzero(wanted)
            left, right = a_ids[at + rows], b_ids[columns]
            found.append(
                pd.DataFrame({"left_id": np.minimum(left, right), "right_id": np.maximum(left, right), "sim": sims[rows, columns]})
            )
        return pa.Table.from_pandas(pd.concat(found), preserve_index=False)

    return compare
