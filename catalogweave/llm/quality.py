"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few surface features. Each feature is cut into bins, and cyclic
boosting grows one shallow tree per feature and round; the trees of a feature add up to
one lookup table over its bins. Then the strongest pairs of features get tables of
their own, boosted in the same way on what the single tables leave over. Scoring adds
table entries and applies the logistic function, for a whole Arrow batch at once.

The model is fitted on the driver from a bounded, documented sample of labelled rows
(``MAX_LABELLED``); all texts are scored in one narrow pass without any shuffle.

Defined results: a null text counts as empty; an empty text has features of zero and is
scored like any other; without labels, or with labels of one kind only, every score is
the (smoothed) share of good labels. Repeated labels keep the largest one, and of texts that
repeat a labelled key the smallest is learned from; all are scored.
"""

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_remainder, label_sample, sampled_texts

MAX_LABELLED = 40_000  # labelled keys, and rows, used for fitting, at most (about)
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 80
RATE = 0.15
THRESHOLD = 0.3

FEATURES = (
    "log_chars log_words word_length distinct_words upper_words digits symbols exclamations bars "
    "lines_per_word top_word repeated_lines adjacent_equal short_words closed_words distinct_pairs"
).split()
_DIGITS, _SYMBOLS = b"0123456789", b"#$%&*@^~<>{}[]\\/=+_"


def text_features(text: str | None) -> list[float]:
    """The surface features of one text, in the order of ``FEATURES``."""
    words = (text or "").split()
    if not words:
        return [math.log1p(len(text or ""))] + [0.0] * (len(FEATURES) - 1)
    raw = text.encode()
    size, count = len(raw), len(words)
    lines = [line for line in text.split("\n") if line]
    seen = Counter(words)
    following = words[1:]

    def share(characters: bytes) -> float:
        return (size - len(raw.translate(None, characters))) / size

    return [
        math.log1p(len(text)),
        math.log1p(count),
        sum(map(len, words)) / count,
        len(seen) / count,
        sum(map(str.isupper, words)) / count,
        share(_DIGITS),
        share(_SYMBOLS),
        share(b"!?"),
        share(b"|"),
        len(lines) / count,
        max(seen.values()) / count,
        1 - len(set(lines)) / len(lines),
        sum(map(str.__eq__, words, following)) / count,
        sum(1 for w in words if len(w) <= 3) / count,
        sum(1 for w in words if w[-1] in ".!?") / count,
        len(set(zip(words, following))) / max(1, count - 1),
    ]


def _matrix(texts) -> np.ndarray:
    rows = [text_features(t) for t in texts]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))


@dataclass
class AdditiveModel:
    """``bias`` plus one table per feature plus one table per chosen pair of features."""

    bias: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (first, second, table)

    def score(self, values: np.ndarray) -> np.ndarray:
        margin = np.full(len(values), self.bias)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            margin += table[np.searchsorted(edges, values[:, k], side="right")]
        for i, j, table in self.pairs:
            first = np.searchsorted(self.coarse[i], values[:, i], side="right")
            second = np.searchsorted(self.coarse[j], values[:, j], side="right")
            margin += table[first, second]
        return 1 / (1 + np.exp(-margin))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _leaf(g, h):
    return g / (h + 1.0)


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The cut of a row of bins with the largest gain; (0, 0) when none helps."""
    if len(g) < 2:
        return 0, 0.0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * _leaf(gl, hl) + gr * _leaf(gr, hr) - g.sum() * _leaf(g.sum(), h.sum())
    at = int(np.argmax(gain))
    return (at + 1, float(gain[at])) if gain[at] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree with at most three leaves."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    first, gain = _best_split(g, h)
    if not gain:
        return out
    parts = [(0, first), (first, len(g))]
    options = [(*_best_split(g[a:b], h[a:b]), a, b) for a, b in parts]
    cut, gain, a, b = max(options, key=lambda o: o[1])
    if gain:
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Four cells at most: a cut of the rows, then a cut of the columns on either side."""
    out = np.full(g.shape, _leaf(g.sum(), h.sum()))
    total = g.sum() * _leaf(g.sum(), h.sum())
    best = (-1.0, 0, 0, 0)
    for row in range(1, g.shape[0]):
        upper = _best_split(g[:row].sum(0), h[:row].sum(0))
        lower = _best_split(g[row:].sum(0), h[row:].sum(0))
        a, b = (g[:row].sum(), h[:row].sum()), (g[row:].sum(), h[row:].sum())
        gain = a[0] * _leaf(*a) + b[0] * _leaf(*b) - total + upper[1] + lower[1]
        best = max(best, (gain, row, upper[0], lower[0]))
    gain, row, upper, lower = best
    if gain <= 1e-9:
        return out, 0.0
    for rows, cut in ((slice(0, row), upper), (slice(row, None), lower)):
        for columns in ((slice(0, cut), slice(cut, None)) if cut else (slice(None),)):
            out[rows, columns] = _leaf(g[rows, columns].sum(), h[rows, columns].sum())
    return out, gain


def fit_additive(values: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of main effects, then of the strongest pairs."""
    rate = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
    model = AdditiveModel(bias=math.log(rate / (1 - rate)))
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    width = values.shape[1]
    model.edges = [_cuts(values[:, k], BINS) for k in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [_cuts(values[:, k], PAIR_BINS) for k in range(width)]
    bins = [np.searchsorted(model.edges[k], values[:, k], side="right") for k in range(width)]
    margin = np.full(len(labels), model.bias)

    def pull():
        p = 1 / (1 + np.exp(-margin))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = pull()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            model.tables[k] += step
            margin += step[bins[k]]

    coarse = [np.searchsorted(model.coarse[k], values[:, k], side="right") for k in range(width)]

    def cells(i, j):
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        return coarse[i] * shape[1] + coarse[j], shape

    def sums(i, j):
        flat, shape = cells(i, j)
        g, h = pull()
        count = shape[0] * shape[1]
        return np.bincount(flat, g, count).reshape(shape), np.bincount(flat, h, count).reshape(shape)

    gains = [(_pair_tree(*sums(i, j))[1], i, j) for i in range(width) for j in range(i)]
    chosen = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    tables = {(i, j): np.zeros(cells(i, j)[1]) for i, j in chosen}
    for _ in range(ROUNDS // 2):
        for i, j in chosen:
            step = RATE * _pair_tree(*sums(i, j))[0]
            tables[i, j] += step
            margin += step[coarse[i], coarse[j]]
    model.pairs = [(i, j, tables[i, j]) for i, j in chosen]
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="quality", limit=MAX_LABELLED
) -> AdditiveModel:
    """Fit on labelled documents outside the held-out fold (crc32 of the key modulo 5 is 0).

    The label sample is bounded by ``limit``, so it is broadcast and the corpus is not shuffled.
    """
    learning = labels.where(~is_remainder(F.col(key), 5, 0))
    sample = label_sample(learning, key, label, limit)
    features = F.pandas_udf(lambda texts: pd.Series(list(_matrix(texts))), "array<double>")
    rows = (
        sampled_texts(docs, sample, key, text)
        .select("sample_key", "sample_label", features("sample_text").alias("features"))
        .toPandas()
        .sort_values("sample_key", kind="stable")
    )
    values = np.array(rows["features"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit_additive(values, rows["sample_label"].to_numpy(dtype=np.float64))


def quality_score(text: Column, model: AdditiveModel) -> Column:
    """The score (0 to 1) of a text column under a fitted model."""

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    return F.pandas_udf(score, "double")(text)
