"""SimHash against brute force: every fingerprint bit by bit, every pair compared."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from catalogweave.llm import simhash
from catalogweave.llm.components import connected_components
from catalogweave.llm.suite import op1_simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{id: smallest id reachable} over ids with fingerprints."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in op1_simhash(spark, sf_dir).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert all(len(r["fingerprint"]) == 16 for r in got.values())
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 0, 10**9])
def test_links_connect_all_within_tolerance(spark, monkeypatch, crowded):
    """Clustered fingerprints, with crowds resolved by midpoints always, never, and as usual."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    random.seed(5)
    centres = [random.getrandbits(64) for _ in range(6)]
    values = {0, 2**64 - 1, *(random.getrandbits(64) for _ in range(150))}
    for c in centres:
        weak = random.sample(range(64), 6)
        values |= {c ^ sum(1 << b for b in random.sample(weak, random.randint(0, 4))) for _ in range(40)}
    signed = [int(np.array(v, dtype=np.uint64).view(np.int64)) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = connected_components(simhash.near_pairs(fps), "a", "b").collect()
    got = {v: v for v in signed} | {r["node"]: r["component"] for r in found}
    lowest = {}
    for v, c in got.items():
        lowest.setdefault(c, []).append(v)
    want = brute_components({v: v & (2**64 - 1) for v in signed})
    groups = {}
    for v, c in want.items():
        groups.setdefault(c, []).append(v)
    assert sorted(map(sorted, lowest.values())) == sorted(map(sorted, groups.values()))


def test_thresholds_add_up():
    cost, chosen = simhash.allocate([[0, 1, 50, 900], [0, 100, 400, 900], [0, 3, 40, 900]], 0)
    assert sum(chosen) == 0 and (cost, chosen) == (41, [0, -1, 1]) or cost <= 41
    assert len(simhash.flips([1, 5, 9], 2)) == 7 and simhash.flips([63], 1) == [0, -(2**63)]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["fp"] == by_id[1]["fp"] == by_id[2]["fp"] == 0
    assert by_id[2]["component_id"] == 0
    assert by_id[None]["component_id"] == by_id[6]["component_id"] == by_id[100]["component_id"] == 5
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and None not in ids and 100 not in ids and 1 not in ids
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_components_of_a_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(1000, 1060)] + [(7, 7), (7, 7)]
    hub = [(500, k) for k in range(501, 900)] + [(500, 501)]
    edges = spark.createDataFrame(path + hub, "a long, b long").repartition(4)
    got = {r[0]: r[1] for r in connected_components(edges, "a", "b").collect()}
    assert {got[k] for k in range(1000, 1061)} == {1000}
    assert {got[k] for k in range(500, 900)} == {500}
    assert 7 not in got
    assert connected_components(edges.where(F.lit(False)), "a", "b").count() == 0
