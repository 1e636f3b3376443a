"""Classes of the language model follow the vocabulary, and its score equals a plain forward recursion."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from catalogweave.llm import lm
from catalogweave.llm.suite import op7_lm


def plain_classes(counts):
    """{word: class} and the number of classes, from the counts of learning documents."""
    root, total = math.sqrt(len(counts)), sum(counts.values())
    ranked = sorted((w for w in counts if counts[w] * lm.OWN * root >= total), key=lambda w: (-counts[w], w))
    own = {w: k for k, w in enumerate(ranked)}
    endings = max(1, math.ceil(lm.SHARED * root))

    def class_of(word):
        signed = (xxhash.xxh64_intdigest(word[-lm.ENDING :].encode(), seed=42) + 2**63) % 2**64 - 2**63
        return own.get(word, len(own) + signed % endings)

    return class_of, len(own), len(own) + endings


@pytest.mark.parametrize("distinct", [0, 1, 400, 40_000])
def test_classes_grow_with_the_vocabulary(spark, distinct):
    counts = {f"w{k}": 1 + 50_000 // (k + 1) for k in range(distinct)}
    counted = spark.createDataFrame([*counts.items(), ("unseen", 0)], "word string, c long")
    classed, size = lm.word_classes(counted)
    class_of, own, plain_size = plain_classes(counts)
    rows = classed.collect()
    assert size == plain_size and len(rows) == distinct + 1
    assert own <= lm.OWN * math.sqrt(distinct)
    assert all(r["class"] == class_of(r["word"]) and 0 <= r["class"] < size for r in rows)
    # A hundred times the words, far more classes.
    assert (own, size - own) >= {0: (0, 1), 1: (1, 4), 400: (60, 80), 40_000: (500, 800)}[distinct]


def test_wide_class_numbers_are_not_cut():
    assert (lm.class_type(2**16), lm.class_type(2**16 + 1)) == ("<u2", "<u4")


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_score_equals_plain_forward(spark, sf_dir, texts, monkeypatch, kind):
    made = {}

    def fixed_model(documents, classes, shares, rounds):
        random = np.random.default_rng(3)
        emit = random.dirichlet(np.ones(classes), lm.STATES).T
        made["model"] = lm.Hmm(random.dirichlet(np.ones(lm.STATES)), random.dirichlet(np.ones(lm.STATES), lm.STATES), emit)
        return made["model"]

    monkeypatch.setattr(lm, "train", fixed_model)
    monkeypatch.setattr(lm, "class_type", lambda classes: kind)
    scores = {r["doc_id"]: r["score"] for r in op7_lm(spark, sf_dir).collect()}
    assert set(scores) == set(texts)
    tokens = {i: [w.decode() for w in (t or "").encode().lower().split()] + [lm.END] for i, t in texts.items()}
    counts = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    class_of, _, size = plain_classes(counts)
    in_class, words_in = Counter(), Counter()
    for word, n in counts.items():
        in_class[class_of(word)] += n
        words_in[class_of(word)] += 1
    model = made["model"]
    assert len(model.emit) == size
    for i, own in tokens.items():
        alpha, log = model.start, 0.0
        for t, word in enumerate(own):
            c = class_of(word)
            alpha = (alpha if t == 0 else alpha @ model.move) * model.emit[c]
            log += math.log10(alpha.sum()) + math.log10((counts[word] + 1) / (in_class[c] + words_in[c] + 1))
            alpha = alpha / alpha.sum()
        assert scores[i] == pytest.approx(log, rel=1e-9)


def test_trained_score_beats_word_counts_on_wide_classes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "class_type", lambda classes: "<u4")
    held = [r for r in op7_lm(spark, sf_dir).where(F.col("held_out")).collect()]
    assert sum(r["score"] - r["base_score"] for r in held) > 0
