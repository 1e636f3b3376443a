"""Embedding near-duplicates by cross-polytope hashing.

A hash function rotates a vector by three rounds of random signs and the fast Hadamard
transform and names the closest of the 2 d signed axes. A table joins ``FUNCTIONS`` such
hashes into a bucket. With multiprobe every vector also enters the buckets in which one of
its hashes is the second closest axis. Vectors of one label that share a bucket are
compared by their cosine in double precision, so nothing below the threshold is linked.

Functions and tables follow the data (``hash_plan``): more functions make buckets smaller, more
tables make up for what they miss. For the rows of the largest label and the vectors' length the plan
takes the functions that cost least in entries and chance meetings, and as many tables as leave
at most ``MISSED`` of the pairs at the threshold apart. So the chance meetings of a vector, and the
work per vector, stay level as the table grows. Only keys are shuffled to find the buckets that
hold several vectors; a vector travels to those buckets alone.

Exact copies are one class with a size, and are not compared. A bucket with more than
``BLOCK`` vectors is dealt into blocks, and every two blocks are compared by a task of their
own, so a bucket of any size is compared in full and in parallel. A comparison returns one
row per linked vector, however many links it has: the number of links that no earlier
bucket has shown already, and the vector's root in the links found. Pairs are never emitted.

Defined results: vectors that are null, zero, or hold null or non-finite components, rows
with a null label and rows with a null id link with nothing; such a row is its own
component. Repeated rows are vectors of their own. Vectors of different lengths never meet.
"""

from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components

THRESHOLD = 0.93
MISSED = 0.002  # share of the pairs at the threshold that may meet in no bucket
MOST_FUNCTIONS = 8
MEETING = 16  # what a chance meeting costs, in entries
BLOCK = 512
SEED = 11


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    count, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(count, width // (2 * half), 2, half)
        first, second = pairs[:, :, :1], pairs[:, :, 1:]
        rows = np.concatenate((first + second, first - second), axis=2).reshape(count, width)
        half *= 2
    return rows


def closest_axes(rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The closest and second closest signed axis of every row after a random rotation."""
    random = np.random.default_rng(seed)
    for _ in range(3):
        rows = hadamard(rows * random.choice([-1.0, 1.0], rows.shape[1]))
    size = np.abs(rows)
    first = size.argmax(axis=1)
    pick = np.arange(len(rows))
    size[pick, first] = -1.0
    second = size.argmax(axis=1)
    return tuple(2 * axis + (rows[pick, axis] > 0) for axis in (first, second))


def bucket_keys(vectors: np.ndarray, tables: int, functions: int) -> np.ndarray:
    """(rows, tables, 1 + functions) bucket numbers of every vector: its own and its probes'."""
    count, dims = vectors.shape
    width = padded(dims)
    rows = np.zeros((count, width))
    rows[:, :dims] = vectors
    out = np.empty((count, tables, 1 + functions), np.int64)
    for table in range(tables):
        axes = [closest_axes(rows, SEED + 1000 * table + k) for k in range(functions)]
        for probe in range(1 + functions):
            key = np.full(count, table, np.int64)
            for k, (first, second) in enumerate(axes):
                key = key * (2 * width) + (second if probe == k + 1 else first)
            out[:, table, probe] = key
    return out


def padded(dims: int) -> int:
    """The power of two that a vector is filled up to."""
    return 1 << max(1, (dims - 1).bit_length())


def meeting_rate(dims: int, functions: int, threshold: float, pairs=1000, tables=4) -> float:
    """Share of random pairs with the threshold as their cosine that share a bucket of a table."""
    random = np.random.default_rng(SEED)
    first, other = random.standard_normal((2, pairs, dims))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    other -= (other * first).sum(axis=1, keepdims=True) * first
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
    keys = [bucket_keys(v, tables, functions) for v in (first, threshold * first + (1 - threshold**2) ** 0.5 * other)]
    return float((keys[0][:, :, :, None] == keys[1][:, :, None, :]).any(axis=(2, 3)).mean())


def hash_plan(dims: int, rows: int, threshold: float) -> tuple[int, int]:
    """(tables, functions) for vectors of this length of which so many share a label."""
    best, keys = None, 2 * padded(dims)
    for functions in range(1, MOST_FUNCTIONS + 1):
        if keys**functions > 1 << 48:
            break
        apart = 1 - meeting_rate(dims, functions, threshold)
        tables = max(1, ceil(log(MISSED) / log(min(max(apart, 1e-9), 1 - 1e-4))))
        cost = tables * (1 + functions) * (1 + MEETING * rows * (1 + functions) / keys**functions)
        best = min(best or (cost, tables, functions), (cost, tables, functions))
    return best[1:]


def _hashed(plans: dict[int, tuple[int, int]], kind: str):
    """Task-side: every vector as bytes, with all its buckets."""

    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                chosen = batch.filter(pa.array(lengths == dims))
                vectors = chosen.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                wide = vectors.astype(np.float64)
                keys = bucket_keys(wide / np.linalg.norm(wide, axis=1, keepdims=True), *plans[dims]).reshape(len(vectors), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[chosen.column(c) for c in ("row", "vec_id", "label", "size")],
                        pa.array(np.full(len(vectors), dims, np.int32)),
                        pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    names=["row", "vec_id", "label", "size", "dims", "vector", "buckets"],
                )

    return run


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from every index through the links (a, b)."""
    root = np.arange(count)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def compare_group(group: pd.DataFrame, bucket: int, crossing: bool, threshold: float, probes: int, kind: str):
    """(vec_id, links, root id) of the linked vectors of one group; ``crossing`` compares two blocks."""
    group = group.sort_values("vec_id")
    ids, sizes = group["vec_id"].to_numpy(), group["size"].to_numpy()
    vectors = np.frombuffer(b"".join(group["vector"]), dtype=kind).astype(np.float64).reshape(len(ids), -1)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    if crossing:
        blocks = group["block"].to_numpy()
        left, right = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks != blocks.min())
        a, b = np.nonzero(unit[left] @ unit[right].T >= threshold)
        a, b = left[a], right[b]
    else:
        a, b = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
    if not len(a):
        return None
    keys = np.stack(group["buckets"].to_numpy()).reshape(len(ids), -1, probes)
    table = int(np.flatnonzero((keys[a[0]] == bucket).any(axis=1))[0])
    fresh = np.ones(len(a), bool)  # false where an earlier bucket holds both
    for earlier in range(table + 1):
        shared = keys[a, earlier][:, :, None] == keys[b, earlier][:, None, :]
        if earlier == table:
            shared &= keys[a, earlier][:, :, None] < bucket
        fresh &= ~shared.any(axis=(1, 2))
    links = np.bincount(a[fresh], sizes[b[fresh]], len(ids)) + np.bincount(b[fresh], sizes[a[fresh]], len(ids))
    used = np.unique(np.concatenate((a, b)))
    return ids[used], links[used].astype(np.int64), ids[_roots(len(ids), a, b)[used]]


def _compare(threshold: float, plans: dict[int, tuple[int, int]], kind: str):
    """Task-side: walk through the sorted rows of a partition, one group after the other."""
    names = ["label", "dims", "bucket", "low", "high"]

    def finished(group: pd.DataFrame):
        first = group.iloc[0]
        probes = 1 + plans[int(first["dims"])][1]
        return compare_group(group, int(first["bucket"]), first["low"] != first["high"], threshold, probes, kind)

    def run(batches):
        rest, last = [], None
        for frame in batches:
            changes = (frame[names].ne(frame[names].shift())).any(axis=1).to_numpy()
            starts = [*np.flatnonzero(changes), len(frame)]
            found = []
            for a, b in zip(starts, starts[1:]):
                part = frame.iloc[a:b]
                key = tuple(part.iloc[0][names])
                if key != last and rest:
                    found.append(finished(pd.concat(rest)) if sum(map(len, rest)) > 1 else None)
                    rest = []
                rest.append(part)
                last = key
            kept = [f for f in found if f is not None]
            if kept:
                yield pd.DataFrame({n: np.concatenate([f[k] for f in kept]) for k, n in enumerate(("vec_id", "links", "root"))})
        if rest and sum(map(len, rest)) > 1:
            result = finished(pd.concat(rest))
            if result is not None:
                yield pd.DataFrame(dict(zip(("vec_id", "links", "root"), result)))

    return run


def plans_of(classes: DataFrame, threshold: float) -> dict[int, tuple[int, int]]:
    """The plan of every vector length, by the rows of its largest label."""
    held = classes.groupBy(F.size("vector").alias("dims"), "label").count()
    largest = held.groupBy("dims").agg(F.max("count").alias("rows")).collect()  # one row per vector length
    return {r["dims"]: hash_plan(r["dims"], r["rows"], threshold) for r in largest}


def found_links(classes: DataFrame, threshold: float, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """(vec_id, links, root) rows, several per vector, for distinct vectors (row, vec_id, label, vector, size)."""
    label = classes.schema["label"].dataType.simpleString()
    element = classes.schema["vector"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    schema = f"row long, vec_id long, label {label}, size long, dims int, vector binary, buckets array<bigint>"
    hashed = stage(classes.select("row", "vec_id", "label", "vector", "size").mapInArrow(_hashed(plans, kind), schema), "hashed")
    keys = ["label", "dims", "bucket"]
    entries = hashed.select("row", "label", "dims", F.explode("buckets").alias("bucket")).distinct()
    sizes = entries.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = entries.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    groups = [*keys, "low", "high"]
    dealt = met.select(*keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "row", "block")
    dealt = dealt.join(hashed.select("row", "vec_id", "size", "vector", "buckets"), "row").drop("row")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, *groups).sortWithinPartitions(*groups)
    return ordered.mapInPandas(_compare(threshold, plans, kind), "vec_id long, links long, root long")


def near_vectors(
    vectors: DataFrame, key="vec_id", label="label", vector="embedding", threshold=THRESHOLD
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    v = F.col("vector")
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = stage(
        rows.where("usable").groupBy("label", "vector").agg(
            F.min("vec_id").cast("long").alias("vec_id"), F.count("*").alias("size")
        ).withColumn("row", F.monotonically_increasing_id()),
        "vector-classes",
    )
    links = stage(found_links(classes, threshold, plans_of(classes, threshold)), "vector-links")
    counts = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = connected_components(links.select("vec_id", "root"), "vec_id", "root").withColumnRenamed("node", "vec_id")
    # A class keeps its members' vector as the key that brings them their result.
    result = stage(
        classes.join(counts, "vec_id", "left")
        .join(named, "vec_id", "left")
        .select(
            "label",
            "vector",
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        ),
        "vector-results",
    )
    linked = rows.where("usable").join(result, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")
    )
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
