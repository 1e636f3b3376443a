"""Pruned pairs and the retrieval index: exactly what a comparison of everything gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogweave.operators import pruned, retrieve as retrieval
from catalogweave.operators.index import build_index, lists_read, read_index, retrieve_indexed, retrieve_vector_indexed, write_index
from catalogweave.operators.pairwise import pairwise_similarity
from catalogweave.operators.pruned import pairwise_pruned, pairwise_work
from catalogweave.operators.retrieve import retrieve, retrieve_vector


@pytest.fixture(scope="module")
def store(spark):
    """Clusters, loose vectors, many copies of one vector, and zero vectors."""
    random = np.random.default_rng(3)
    centres = random.standard_normal((12, 32))
    rows = [centres[k % 12] + 0.25 * random.standard_normal(32) for k in range(360)]
    rows += list(random.standard_normal((200, 32)))
    rows += [rows[5]] * 60 + [np.zeros(32)] * 3 + [2.5 * rows[7], -rows[8]]
    data = [(k, [float(x) for x in row]) for k, row in enumerate(rows)]
    return spark.createDataFrame(data, "fic_id long, embedding array<double>").repartition(5).cache()


def pairs_of(frame):
    return sorted((r["left_id"], r["right_id"], round(r["sim"], 9)) for r in frame.collect())


@pytest.mark.parametrize("threshold, part_bytes", [(0.93, 32 << 20), (0.93, 32 * 4 * 60), (0.6, 32 << 20), (0.05, 32 * 4 * 60), (1.0, 32 << 20)])
def test_pruned_pairs_equal_all_pairs(store, threshold, part_bytes):
    want = pairs_of(pairwise_similarity(store, threshold))
    assert want and pairs_of(pairwise_pruned(store, threshold, part_bytes)) == want


def test_products_are_few_at_a_high_threshold(spark):
    random = np.random.default_rng(5)
    data = [(k, [float(x) for x in row]) for k, row in enumerate(random.standard_normal((1500, 64)))]
    loose = spark.createDataFrame(data, "fic_id long, embedding array<float>")
    work = pairwise_work(loose, 0.93).first()
    everything = 1500 * 1499 // 2
    assert work["products"] < 0.05 * everything and work["bounded"] < 1.3 * everything


def test_slices_far_apart_are_never_bounded(spark, monkeypatch):
    """Two opposite clusters: parts of different clusters do not even meet."""
    monkeypatch.setattr(pruned, "_SLICE", 16)
    random = np.random.default_rng(6)
    side = np.repeat([[1.0], [-1.0]], 100, axis=0) * np.ones((200, 8))
    data = [(k, [float(x) for x in row]) for k, row in enumerate(side + 0.01 * random.standard_normal((200, 8)))]
    both = spark.createDataFrame(data, "fic_id long, embedding array<double>")
    assert pairwise_work(both, 0.9).first()["bounded"] < 0.7 * 200 * 199 // 2
    assert pairwise_pruned(both, 0.9).count() == 2 * 100 * 99 // 2


def test_pruned_edge_cases(spark, store):
    with pytest.raises(ValueError):
        pairwise_pruned(store, 0.0)
    assert pairwise_pruned(store.limit(1), 0.5).count() == 0
    assert tuple(pairwise_work(store.where("false"), 0.5).first()) == (0, 0)


@pytest.mark.parametrize("lists, k, block_rows", [(1, 3, 2048), (24, 1, 2048), (24, 10, 32), (4096, 70, 50)])
def test_index_equals_the_scan(store, lists, k, block_rows):
    queries = store.where("fic_id % 3 = 0 OR fic_id > 610").withColumnRenamed("fic_id", "query_id")
    found = retrieve_indexed(build_index(store, lists), queries, k, block_rows)

    def rows(frame):
        return sorted((r["query_id"], r["place"], r["fic_id"], round(r["sim"], 9)) for r in frame.collect())

    assert rows(found) == rows(retrieve(store, queries, k))


def test_stored_index_reads_few_lists(spark, store, tmp_path):
    write_index(build_index(store, 24), str(tmp_path))
    index = read_index(spark, str(tmp_path))
    vector = store.where("fic_id = 30").first()["embedding"]

    def rows(frame):
        return [(r["fic_id"], round(r["sim"], 9)) for r in frame.orderBy("sim", "fic_id").collect()]

    assert rows(retrieve_vector_indexed(index, 30, vector, 8)) == rows(retrieve_vector(store, 30, vector, 8))
    queries = store.where("fic_id < 360").withColumnRenamed("fic_id", "query_id")
    read = lists_read(index, queries, 3).agg({"visited": "sum"}).first()[0]
    assert read < 0.5 * 360 * index.lists.count()
    folders = retrieve_vector_indexed(index, 30, vector, 8)
    assert folders.count() == 8


def test_empty_index(spark, store):
    empty = build_index(store.where("false"))
    queries = store.limit(2).withColumnRenamed("fic_id", "query_id")
    assert retrieve_indexed(empty, queries, 3).count() == 0
    assert retrieve_indexed(build_index(store), queries.where("false"), 3).count() == 0


def test_index_without_arrow_conversion(spark, store):
    """A plain session converts row by row and takes Python numbers only."""
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        index = build_index(store, 8)
        assert sum(r["n"] for r in index.lists.collect()) == store.count()
    finally:
        spark.conf.set(key, before)


def test_cells_are_bounded_and_lose_nothing(spark, store, monkeypatch):
    """Neither the queries nor the vectors that a task holds grow with the data."""
    monkeypatch.setattr(retrieval, "CELL_BYTES", 8 * 32 * 100)
    compare_cells = retrieval.compare_cells
    sizes = spark.sparkContext.accumulator(0)

    def watched(k, block_rows):
        compare = compare_cells(k, block_rows)

        def run(left, right):
            if max(left.num_rows, right.num_rows) > 200:
                sizes.add(1)
            return compare(left, right)

        return run

    monkeypatch.setattr(retrieval, "compare_cells", watched)
    queries = store.withColumnRenamed("fic_id", "query_id")

    def rows(frame):
        return sorted((r["query_id"], r["place"], r["fic_id"], round(r["sim"], 9)) for r in frame.collect())

    queries = store.join(queries.select("query_id"), store["fic_id"] == F.col("query_id"), "left_semi").select(F.col("fic_id").alias("query_id"), "embedding")
    want = rows(retrieve(store, queries, 4))
    assert rows(retrieve(store, queries, 4, broadcast_limit=0)) == want and sizes.value == 0
    assert rows(retrieve_indexed(build_index(store, 3), queries, 4)) == want


def test_results_count_against_the_broadcast(spark, store, monkeypatch):
    """Queries with many results each go to the grid: a task of the scan would hold all of them."""
    used = []
    monkeypatch.setattr(retrieval, "_scan", lambda *given: used.append("scan"))
    monkeypatch.setattr(retrieval, "_block_join", lambda *given: used.append("grid") or spark.createDataFrame([], retrieval.CANDIDATE_SCHEMA))
    retrieve(store, store.withColumnRenamed("fic_id", "query_id"), 500, broadcast_limit=1 << 20)
    assert used == ["grid"]


def test_useless_bounds_are_not_taken(spark):
    """At a low threshold half of the coordinates rule nothing out: no pair is bounded, and none is lost."""
    random = np.random.default_rng(8)
    data = [(k, [float(x) for x in row]) for k, row in enumerate(random.standard_normal((700, 64)))]
    loose = spark.createDataFrame(data, "fic_id long, embedding array<float>")
    assert tuple(pairwise_work(loose, 0.3).first())[0] == 0
    want = pairs_of(pairwise_similarity(loose, 0.3))
    assert want and pairs_of(pairwise_pruned(loose, 0.3)) == want


def test_cells_stay_partitions_of_their_own(store):
    """Cells are small but their work is not: adaptive execution must not merge them into few tasks."""
    found = pairwise_pruned(store, 0.05, 32 * 4 * 60)
    assert found.rdd.getNumPartitions() == 11 * 12 // 2


def test_matches_leave_a_task_in_batches():
    """A batch is handed over before later slices are compared, however many matches a cell has."""
    taken = []

    def slices():
        for k in range(40):
            taken.append(k)
            yield np.full(10_000, k), np.full(10_000, k + 1), np.ones(10_000), 10_000, 10_000

    batches = pruned._emit_pairs(slices())
    first = next(batches)
    assert first.num_rows < 100_000 and len(taken) < 10
    assert first.num_rows + sum(b.num_rows for b in batches) == 400_000


@pytest.mark.parametrize("share", [0.0, 0.05, 1.0])
@pytest.mark.parametrize("levels", [[0], [0, 8, 16, 32]])
def test_every_way_of_multiplying_finds_the_same(monkeypatch, share, levels):
    """Gathered, screened in single precision or multiplied whole; pairs at the threshold to the last digit stay."""
    monkeypatch.setattr(pruned, "_SHARE", share)
    random = np.random.default_rng(9)
    rows = random.standard_normal((300, 64))
    rows[:40] = rows[40:80] + 0.05 * random.standard_normal((40, 64))
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    side = pruned._Side(np.arange(300), units, np.eye(64), levels)
    sims = np.round(side.units @ side.units.T, retrieval.RANK_DECIMALS)
    for threshold in (0.3, 0.93, float(np.sort(sims.ravel())[-900])):
        found = pruned._matches(side, slice(0, 300), side, slice(0, 300), levels, threshold)
        want = np.nonzero(sims >= threshold)
        assert np.array_equal(found[0], want[0]) and np.array_equal(found[1], want[1])
        assert np.abs(found[2] - sims[want]).max() < 1e-11


def test_matches_of_a_crowd_are_spread_over_the_cells(spark):
    """A third of the vectors are copies of one: no task returns all pairs of them."""
    random = np.random.default_rng(10)
    rows = list(random.standard_normal((400, 64)))
    rows[:130] = [rows[0]] * 130
    data = [(k, [float(x) for x in row]) for k, row in enumerate(rows)]
    crowd = spark.createDataFrame(data, "fic_id long, embedding array<float>")
    found = pairwise_pruned(crowd, 0.3, 64 * 4 * 40)
    counts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) >= 130 * 129 // 2 and max(counts) < 0.1 * sum(counts)
