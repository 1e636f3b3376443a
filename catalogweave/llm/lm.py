"""LM scoring with a hidden Markov model over word classes.

Tokens are the lower-cased words of a text and one end. The vocabulary is counted over all
learning documents by a shuffle of each block's distinct words (see ``blocks``); frequent
words are classes of their own, all others share classes by their last letters. Both kinds
grow with the root of the vocabulary: a word is frequent if it holds at least one in
``OWN`` x root of all tokens, so at most ``OWN`` x root words are.
A hidden Markov model generates the class sequence, and each class its words by add-one
counts, so the model gives every text a probability:

  P(text) = P_hmm(classes) x product of (c(w) + 1) / (N(class) + V(class) + 1)

Training is Baum-Welch over all learning documents: every task runs the scaled forward and
backward recursions on its documents and returns expected counts of fixed size (states x
(states + classes)), which are added across partitions; the driver only normalises them.
Scoring runs the scaled forward recursion, so the likelihood is exact for whole texts.

Documents are handled in groups of similar length and bounded size, one matrix step per
token position. A very long document is one group.

Defined results: a null or empty text is one end. A null key learns like any other and is
not held out. Repeated rows are documents of their own. Without learning documents all
counts are zero and the model is the uniform one over classes.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import documents_of, unpack_numbers, word_blocks, words_of
from .common import stage

STATES = 8
OWN = 32  # a word with 1 / (OWN x root of the vocabulary) of all tokens is a class of its own
SHARED = 4  # classes for all other words, by their last letters, per root of the vocabulary
ENDING = 3
ROUNDS = 5
GROUP_TOKENS = 500_000
END = "\n"  # no word holds white space


def cut_tokens(text: str) -> list[str]:
    """Words with A-Z lower-cased, and the end."""
    return [w.decode() for w in text.encode().lower().split()] + [END]


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states, P(class | state)


def _first_guess(shares: np.ndarray) -> Hmm:
    """Sticky states whose class shares are the corpus' own, unevenly perturbed (fixed seed)."""
    random = np.random.default_rng(7)
    emit = shares[:, None] * random.gamma(1.0, 1.0, (len(shares), STATES)) + 1e-9
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def _groups(sequences: list[np.ndarray]):
    """Indices of sequences, longest first, in groups of bounded size."""
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    group, size = [], 0
    for k in order:
        if group and size + len(sequences[k]) > GROUP_TOKENS:
            yield group
            group, size = [], 0
        group.append(k)
        size += len(sequences[k])
    if group:
        yield group


def _by_position(sequences: list[np.ndarray]):
    """Classes position by position (longest sequence first), and where each position begins."""
    lengths = np.array([len(s) for s in sequences])
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    begins = np.concatenate(([0], np.cumsum(active)))
    flat = np.empty(begins[-1], np.int64)
    for row, sequence in enumerate(sequences):
        flat[begins[: len(sequence)] + row] = sequence
    return flat, begins


def forward(model: Hmm, sequences: list[np.ndarray]):
    """Scaled forward recursion: (log likelihoods, scaled alphas, scales, classes, begins)."""
    flat, begins = _by_position(sequences)
    seen = model.emit[flat]
    alphas, scales = np.empty_like(seen), np.empty(len(flat))
    now = np.broadcast_to(model.start, (len(sequences), STATES))
    for t in range(len(begins) - 1):
        a, b = begins[t], begins[t + 1]
        now = now * seen[a:b] if t == 0 else (now[: b - a] @ model.move) * seen[a:b]
        scale = now.sum(axis=1)
        now = now / scale[:, None]
        alphas[a:b], scales[a:b] = now, scale
    rows = np.arange(len(flat)) - np.repeat(begins[:-1], np.diff(begins))
    logs = np.bincount(rows, np.log(scales), len(sequences))
    return logs, alphas, scales, flat, begins


def expected_counts(model: Hmm, sequences: list[np.ndarray]):
    """Baum-Welch counts of a group: starts, moves, emissions, log likelihood."""
    logs, alphas, scales, flat, begins = forward(model, sequences)
    meet = np.zeros((STATES, STATES))
    beta = np.ones((begins[-1] - begins[-2], STATES))
    for t in range(len(begins) - 2, 0, -1):
        a, b, c = begins[t - 1], begins[t], begins[t + 1]
        ahead = model.emit[flat[b:c]] * beta / scales[b:c, None]
        meet += alphas[a : a + c - b].T @ ahead
        alphas[b:c] *= beta
        before = np.ones((b - a, STATES))
        before[: c - b] = ahead @ model.move.T
        beta = before
    alphas[: begins[1]] *= beta
    emit = np.stack([np.bincount(flat, alphas[:, s], len(model.emit)) for s in range(STATES)], axis=1)
    return alphas[: begins[1]].sum(axis=0), meet * model.move, emit, float(logs.sum())


def class_type(classes: int) -> str:
    """The little-endian number type that class sequences are stored in."""
    return "<u2" if classes <= 2**16 else "<u4"


def word_classes(counted: DataFrame) -> tuple[DataFrame, int]:
    """(word, c, class) of every word of a table (word, c), and the number of classes.

    Only words that learning documents hold (c > 0) make up the vocabulary.
    """
    spark, known = counted.sparkSession, counted.where("c > 0")
    total, distinct = known.agg(F.sum("c"), F.count("*")).first()
    root = math.sqrt(distinct)
    frequent = known.where(F.col("c") * (OWN * root) >= F.lit(total)).select("word", "c").collect()
    ranked = sorted(frequent, key=lambda r: (-r["c"], r["word"]))
    own = spark.createDataFrame([(r["word"], k) for k, r in enumerate(ranked)], "word string, class int")
    endings = max(1, math.ceil(SHARED * root))
    shared = (F.pmod(F.xxhash64(F.right("word", F.lit(ENDING))), F.lit(endings)) + len(ranked)).cast("int")
    # At most OWN x root rows, since their counts add up to no more than all tokens.
    classed = counted.join(F.broadcast(own), "word", "left").withColumn("class", F.coalesce("class", shared))
    return classed, len(ranked) + endings


def train(documents: DataFrame, classes: int, shares: np.ndarray, rounds=ROUNDS) -> Hmm:
    """Baum-Welch over a staged table with a ``classes`` column of numbers of ``class_type``."""
    kind = class_type(classes)
    model = _first_guess(shares)
    cells = STATES + STATES * STATES + classes * STATES

    for _ in range(rounds):
        current = model

        def count(batches, current=current):
            total = np.zeros(cells + 1)
            for batch in batches:
                sequences = [np.frombuffer(v.as_py(), dtype=kind) for v in batch.column("classes")]
                for group in _groups(sequences):
                    start, move, emit, log = expected_counts(current, [sequences[k] for k in group])
                    total += np.concatenate((start, move.ravel(), emit.ravel(), [log]))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

        sums = documents.select("classes").mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
        total = np.zeros(cells + 1)
        found = sums.toPandas()
        total[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
        start = total[:STATES] + 0.1
        move = total[STATES : STATES + STATES * STATES].reshape(STATES, STATES) + 0.1
        emit = total[STATES + STATES * STATES : cells].reshape(classes, STATES) + 0.01
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def lm_scores(docs: DataFrame, held_out: Column, key="doc_id", text="text", rounds=ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Scores are log10 probabilities: ``base_score`` under add-one word counts, ``score`` under
    the hidden Markov model.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = word_blocks(docs, cut_tokens, buckets, ~held_out, key, text)
    zipped = F.arrays_zip(F.col("numbers").alias("code"), F.col("words").alias("word"), F.col("counts").alias("n"))
    entries = words_of(blocks).select("block", F.inline(zipped))
    counted = stage(entries.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    classed, size = word_classes(counted)
    stored = class_type(size)
    per_class = classed.groupBy("class").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).toPandas()
    tokens, words = np.zeros(size), np.zeros(size)
    tokens[per_class["class"]], words[per_class["class"]] = per_class["n"], per_class["v"]
    total, distinct = int(tokens.sum()), int(words.sum())
    back = entries.select("block", "code", "word").join(classed, "word").select(F.col("block").alias("in_block"), "code", "c", "class")
    # Keys travel as text, because pandas would turn a column with nulls into floats.
    found = documents_of(blocks).withColumn("doc_id", F.col("doc_id").cast("string"))

    def translate(documents: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        code = entries["code"].to_numpy()
        known, kinds = np.zeros(len(code), np.int64), np.zeros(len(code), stored)
        known[code], kinds[code] = entries["c"].to_numpy(), entries["class"].to_numpy()
        logs = np.log10(known + 1.0)
        own = [unpack_numbers(codes) for codes in documents["codes"]]
        return pd.DataFrame(
            {
                "doc_id": documents["doc_id"],
                "learning": documents["counted"],
                "n_tokens": [len(c) for c in own],
                "n_known": [int((known[c] > 0).sum()) for c in own],
                "log_counts": [float(logs[c].sum()) for c in own],
                "classes": [kinds[c].tobytes() for c in own],
            }
        )

    kind = blocks.schema["doc_id"].dataType
    schema = "doc_id string, learning boolean, n_tokens long, n_known long, log_counts double, classes binary"
    grouped = found.groupBy("block").cogroup(back.groupBy("in_block"))
    documents = stage(grouped.applyInPandas(translate, schema), "class-sequences")
    shares = (tokens + 0.01) / (tokens + 0.01).sum()
    model = train(documents.where("learning"), size, shares, rounds)
    per_token = np.log10(tokens + words + 1.0)

    def score(classes: pd.Series) -> pd.Series:
        sequences = [np.frombuffer(v, dtype=stored) for v in classes]
        out = np.zeros(len(sequences))
        for group in _groups(sequences):
            out[group] = forward(model, [sequences[k] for k in group])[0] / math.log(10)
        return pd.Series(out - [float(per_token[s].sum()) for s in sequences])

    scored = F.pandas_udf(score, "double")(F.col("classes"))
    return documents.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        (~F.col("learning")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("log_counts") + scored).alias("score"),
    )
