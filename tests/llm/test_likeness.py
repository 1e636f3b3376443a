"""Fingerprints, embedding duplicates and the language model against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogweave.llm import blocks, embedding_dedup, fingerprint, lm
from catalogweave.llm.suite import op5_embeddings, op6_fingerprints, op7_lm


def lowered_words(text):
    return (text or "").encode().lower().split()


def edited_texts(texts):
    order = sorted(texts, reverse=True)
    out = {}
    for k, doc in enumerate(order):
        text, following = texts[doc] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        out[doc] = text[: len(text) - half] + following[:half]
    return out


def jaccard(a, b):
    a, b = Counter(lowered_words(a)), Counter(lowered_words(b))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprint_query(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in op6_fingerprints(spark, sf_dir).collect()}
    edited, order = edited_texts(texts), sorted(texts, reverse=True)
    assert set(rows) == set(texts)
    errors, by_text = [], {}
    for k, doc in enumerate(order):
        row, following = rows[doc], order[(k + 1) % len(order)]
        assert row["n_chars"] == len(texts[doc] or "") and row["next_id"] == following
        assert row["edited_sha256"] == hashlib.sha256(edited[doc].encode()).hexdigest()
        assert by_text.setdefault(texts[doc], row["fingerprint"]) == row["fingerprint"]
        errors.append(row["near_edited"] - jaccard(texts[doc], edited[doc]))
        errors.append(row["near_next"] - jaccard(texts[doc], texts[following]))
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.01 and errors.std() < 0.07  # sqrt(1/4 / 64) is 0.0625


def test_fingerprint_odd_rows(spark, odd_docs, no_docs):
    rows = fingerprint.compared_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["samples"] == by_id[1]["samples"] == by_id[2]["samples"] == [-1] * 64
    assert by_id[5]["samples"] == by_id[6]["samples"] == by_id[100]["samples"] == by_id[None]["samples"]
    assert by_id[None]["next_id"] == 100 and by_id[0]["next_id"] is None
    assert fingerprint.compared_documents(no_docs).count() == 0
    one = spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")
    assert [(r["near_next"], r["next_id"]) for r in fingerprint.compared_documents(one).collect()] == [(1.0, 7)]
    assert fingerprint.fingerprint_documents(odd_docs).count() == odd_docs.count()


@pytest.mark.parametrize("at_once", [4096, 7])
def test_fingerprint_of_a_repeated_row(spark, monkeypatch, at_once):
    """A third of all rows are one row: each of them is in the result, and in the ring they are one document."""
    monkeypatch.setattr(fingerprint, "REPEATED_AT_ONCE", at_once)
    rows = [(k, f"word{k} and more of {k % 7}") for k in range(40)] + [(11, "word11 and more of 4")] * 19 + [(11, "other words")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = {(r["doc_id"], r["n_chars"]): r for r in fingerprint.compared_documents(docs.distinct()).collect()}
    got = fingerprint.compared_documents(docs).collect()
    assert len(got) == 61 and Counter((r["doc_id"], r["n_chars"]) for r in got)[11, 20] == 20
    assert all(r == once[r["doc_id"], r["n_chars"]] for r in got)
    assert fingerprint.fingerprint_documents(docs).count() == 61


def brute_vectors(rows, threshold=0.93):
    """{id: (links, component)} by comparing all pairs of a label."""
    out, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    links = []
    for label, dims in {(r[2], len(r[1] or ())) for r in rows}:
        own = [r for r in rows if r[2] == label and len(r[1] or ()) == dims and r[1] and any(r[1]) and all(x is not None and math.isfinite(x) for x in r[1])]
        if label is None or not own:
            continue
        v = np.array([r[1] for r in own], dtype=np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(v @ v.T >= threshold, 1))
        links += [(own[i][0], own[j][0]) for i, j in zip(a, b)]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        out[a] += 1
        out[b] += 1
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: (out[i], find(i)) for i in out}


def test_embedding_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute_vectors(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op5_embeddings(spark, sf_dir).collect()}
    assert set(got) == set(want)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert there * 0.99 <= found <= there
    assert all(got[i][0] <= want[i][0] for i in want)


@pytest.mark.parametrize("block", [512, 7])
def test_embedding_clusters(spark, monkeypatch, block):
    """Dense clusters and copies, in whole buckets and in many small blocks: no link is counted twice."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    random = np.random.default_rng(4)
    centres = random.standard_normal((3, 24))
    rows = [(k, (centres[k % 3] + 0.05 * random.standard_normal(24)).tolist(), k % 2) for k in range(90)]
    rows += [(200 + k, rows[4][1], rows[4][2]) for k in range(20)]
    rows += [(300, None, 0), (301, [0.0] * 24, 0), (302, [float("nan")] + [1.0] * 23, 0), (303, rows[0][1], None), (304, [1.0] * 8, 0), (305, [None] * 24, 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, links string").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(frame).collect()}
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_vectors(frame.where(F.lit(False))).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    random = np.random.default_rng(9)
    first = random.standard_normal((1500, 64))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    other = random.standard_normal((1500, 64))
    other -= (other * first).sum(1, keepdims=True) * first
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    second = 0.931 * first + math.sqrt(1 - 0.931**2) * other
    chosen = []
    for rows in (100, 10_000, 1_000_000, 100_000_000):
        tables, functions = embedding_dedup.hash_plan(64, rows, 0.93)
        keys = [embedding_dedup.bucket_keys(v, tables, functions).reshape(1500, -1) for v in (first, second)]
        met = (keys[0][:, :, None] == keys[1][:, None, :]).any(axis=(1, 2))
        assert met.mean() > 0.99
        assert rows * (1 + functions) ** 2 < (2 * 64) ** functions  # chance meetings stay rare, however many rows
        chosen.append(functions)
    assert chosen == sorted(chosen) and chosen[0] < chosen[-1]


def test_lm_query(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in op7_lm(spark, sf_dir).collect()}
    tokens = {i: [*lowered_words(t), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i in texts if not held[i] for w in tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    gain = []
    for i, own in tokens.items():
        row = rows[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[i], len(own), total)
        assert row["n_known"] == sum(counts[w] > 0 for w in own)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        if held[i]:
            gain.append((row["score"] - base) / len(own))
    assert np.mean(gain) > 0.1  # digits per token better than word counts, on texts never seen


def test_forward_equals_enumeration():
    random = np.random.default_rng(0)
    emit = random.dirichlet(np.ones(5), lm.STATES).T
    model = lm.Hmm(random.dirichlet(np.ones(lm.STATES)), random.dirichlet(np.ones(lm.STATES), lm.STATES), emit)
    sequences = [np.array(s) for s in ([1, 2, 0], [4], [3, 3], [0, 1, 4])]
    order = sorted(range(4), key=lambda k: -len(sequences[k]))
    logs = lm.forward(model, [sequences[k] for k in order])[0]
    for at, k in enumerate(order):
        alpha = model.start * emit[sequences[k][0]]
        for c in sequences[k][1:]:
            alpha = (alpha @ model.move) * emit[c]
        assert logs[at] == pytest.approx(math.log(alpha.sum()))
    start, move, counts, log = lm.expected_counts(model, [sequences[k] for k in order])
    assert start.sum() == pytest.approx(4) and move.sum() == pytest.approx(5) and counts.sum() == pytest.approx(9)
    assert log == pytest.approx(logs.sum())


@pytest.mark.parametrize("most", [250_000, 4])
def test_lm_odd_rows(spark, odd_docs, no_docs, monkeypatch, most):
    monkeypatch.setattr(blocks, "MOST_WORDS", most)
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    rows = lm.lm_scores(odd_docs, held, rounds=2).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r["score"]) for r in rows)
    large = spark.createDataFrame([(2**62 + 1, "a b"), (None, "a b")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in lm.lm_scores(large, F.lit(False), rounds=1).collect()} == {None, 2**62 + 1}
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 0] == [1]
    assert lm.lm_scores(no_docs, held).count() == 0
    assert all(math.isfinite(r["score"]) for r in lm.lm_scores(odd_docs, F.lit(True), rounds=1).collect())
