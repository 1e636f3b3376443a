import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogweave.operators.pairwise import grid_cells, grid_parts, pairwise_similarity
from catalogweave.operators.score import score_candidates
from catalogweave.operators.retrieve import missing_queries, retrieve, retrieve_vector
from catalogweave.plans.recommend import recommend, recommend_batch
from catalogweave.schemas import SCORE_WEIGHTS


def unit(matrix):
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


@pytest.fixture(scope="module")
def vectors():
    """Clustered vectors with a crowd of equal copies (a third of all rows) and a zero vector."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    matrix = centres[rng.integers(0, 6, 300)] + 0.15 * rng.standard_normal((300, 8))
    matrix[100:200] = matrix[100]
    matrix[7] = 0.0
    return matrix.astype(np.float32)


@pytest.fixture(scope="module")
def store(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "fic_id bigint, embedding array<float>").repartition(5)


def brute(vectors, q, k):
    sims = np.round(unit(vectors.astype(np.float64)) @ unit(vectors.astype(np.float64))[q], 12)
    order = [i for i in np.lexsort((np.arange(len(sims)), -sims)) if i != q]
    return [(int(i), float(sims[i])) for i in order[:k]]


def test_retrieve_one_matches_brute_force(store, vectors):
    for q in (0, 7, 150):
        got = retrieve_vector(store, q, [float(x) for x in vectors[q]], 120).collect()
        want = brute(vectors, q, 120)
        assert [r.fic_id for r in got] == [i for i, _ in want]
        assert [r.sim for r in got] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_retrieve_many_matches_brute_force(store, vectors, limit):
    queries = store.withColumnRenamed("fic_id", "query_id")
    got = retrieve(store, queries, 11, broadcast_limit=limit, block_rows=37).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.place)):
        by_query.setdefault(r.query_id, []).append(r.fic_id)
    assert by_query == {q: [i for i, _ in brute(vectors, q, 11)] for q in range(len(vectors))}


@pytest.mark.parametrize("threshold", [0.95, 0.5, 0.05])
def test_pairs_match_brute_force(store, vectors, threshold):
    got = pairwise_similarity(store, threshold, part_bytes=32 * 64).collect()
    sims = np.round(unit(vectors.astype(np.float64)) @ unit(vectors.astype(np.float64)).T, 12)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(sims >= threshold, 1)))}
    assert len(got) == len(want) and {(r.left_id, r.right_id) for r in got} == want


def test_small_stores(spark, store):
    assert pairwise_similarity(store.where("fic_id = 1"), 0.5).count() == 0
    with pytest.raises(ValueError):
        pairwise_similarity(store, 0.0)


def test_grid_sends_each_vector_once_per_part(store):
    parts = grid_parts(200, 4, tasks=50)
    assert parts == 10 and grid_cells(store, parts).count() == store.count() * parts
    assert retrieve(store, store.where("false").withColumnRenamed("fic_id", "query_id"), 3).count() == 0


CORE = [(0, 10, 4), (1, 20, 0), (2, 0, 8), (3, 5, 2)]
TAGS = [
    (0, "fandom", "a"), (0, "fandom", "b"), (0, "relationship", "r"),
    (1, "fandom", "b"), (1, "fandom", "c"), (2, "relationship", "r"), (3, "character", "z"),
]


def expected(vectors, q, top_k, size):
    tags = {k: {} for k in ("fandom", "relationship")}
    for i, kind, tag in TAGS:
        if kind in tags:
            tags[kind].setdefault(i, set()).add(tag)
    counts = {i: (k, b) for i, k, b in CORE}

    def jaccard(kind, a, b):
        a, b = tags[kind].get(a, set()), tags[kind].get(b, set())
        return len(a & b) / len(a | b) if a | b else 1.0

    rows = []
    for i, sim in brute(vectors, q, size):
        kudos, bookmarks = counts.get(i, (0, 0))
        popularity = (kudos / 20 + bookmarks / 8) / 2
        score = (
            SCORE_WEIGHTS["embedding"] * sim
            + SCORE_WEIGHTS["fandom"] * jaccard("fandom", i, q)
            + SCORE_WEIGHTS["relationship"] * jaccard("relationship", i, q)
            + SCORE_WEIGHTS["popularity"] * popularity
        )
        rows.append((i, score, sim))
    rows.sort(key=lambda r: (-round(r[1], 12), -r[2], r[0]))
    return rows[:top_k]


@pytest.fixture(scope="module")
def catalogue(spark):
    core = spark.createDataFrame(CORE, "fic_id bigint, kudos int, bookmarks int")
    return core, spark.createDataFrame(TAGS, "fic_id bigint, kind string, tag string")


@pytest.mark.parametrize("size", [20, 20_000])
def test_recommend_matches_plain_python(store, vectors, catalogue, size):
    for q in (0, 2):
        got = recommend(store, *catalogue, q, top_k=5, retrieval_size=size).orderBy("rank").collect()
        want = expected(vectors, q, 5, size)
        assert [r.fic_id for r in got] == [w[0] for w in want]
        assert [r.score for r in got] == pytest.approx([w[1] for w in want])
        assert [r.rank for r in got] == [1, 2, 3, 4, 5]


def test_recommend_batch_matches_plain_python(spark, store, vectors, catalogue):
    asked = spark.createDataFrame([(q,) for q in (0, 1, 5, 150, 9999)], "query_id bigint")
    got = recommend_batch(store, *catalogue, asked, top_k=4, retrieval_size=25).orderBy("query_id", "rank").collect()
    for q in (0, 1, 5, 150):
        assert [r.fic_id for r in got if r.query_id == q] == [w[0] for w in expected(vectors, q, 4, 25)]
    assert 9999 not in {r.query_id for r in got}
    assert [r.query_id for r in missing_queries(store, asked).collect()] == [9999]


def test_errors(store, catalogue):
    with pytest.raises(KeyError):
        recommend(store, *catalogue, 12345)
    with pytest.raises(ValueError):
        recommend(store, *catalogue, 0, top_k=0)
    with pytest.raises(ValueError):
        recommend(store, *catalogue, 0, retrieval_size=0)


def test_no_cross_products(spark, store, catalogue, tmp_path):
    core_path = str(tmp_path / "core")
    catalogue[0].write.parquet(core_path)
    result = recommend(store, spark.read.parquet(core_path), catalogue[1], 0, retrieval_size=3)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_tag_counts(spark, store, vectors):
    """One tag on every work, and one work among the candidates of all."""
    core = spark.createDataFrame([(i, 1, 1) for i in range(300)], "fic_id bigint, kudos int, bookmarks int")
    tags = spark.range(300).select(F.col("id").alias("fic_id"), F.lit("fandom").alias("kind"), F.lit("x").alias("tag"))
    got = recommend(store, core, tags, 0, top_k=3, retrieval_size=50).collect()
    assert all(r.fandom_score == 1.0 and r.relationship_score == 1.0 for r in got)


def test_hub_work_in_every_candidate_list(spark, store, vectors, catalogue, without_broadcast):
    """Salted lookups give the rows of plain ones when one candidate belongs to every query."""
    candidates = spark.range(1, 200).select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("fic_id"), F.lit(0.5).alias("sim"))
    rows = score_candidates(candidates, *catalogue).collect()
    tags = {k: {t for i, kind, t in TAGS if i == 0 and kind == k} for k in ("fandom", "relationship")}
    assert len(rows) == 199
    for r in rows:
        own = {t for i, kind, t in TAGS if i == r.query_id and kind == "fandom"}
        assert r.fandom_score == pytest.approx(len(own & tags["fandom"]) / len(own | tags["fandom"]))
