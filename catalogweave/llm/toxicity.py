"""Toxicity: cumulative-link ordinal regression over sparse text features.

Features of a text are the words it holds and the first four to six letters of each
(insults are often inflected), weighted by log(1 + occurrences). From a bounded,
documented sample of labelled documents (``MAX_LABELLED``) all features with enough evidence, a
likelihood-ratio statistic, are taken. What is enough follows from the number of features looked at, so that
only about ``CHANCE`` pass without a reason. The labels say toxic or not; severity grades are
graded evidence among the toxic ones: 0 clean, 1, 2 and 3 for few, several and many
occurrences of strongly toxic features. The ordinal model has ONE weight vector and
ordered thresholds: P(grade > k) = logistic(w x - theta_k). Its output is the expected grade.

Scoring is one narrow pass over all documents, in Arrow batches.

Defined results: a null or empty text has no features and severity of the bare thresholds;
without toxic labels every severity is 0. Of texts that repeat a labelled key the smallest is
learned from; all are scored.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_remainder, label_sample, sampled_texts, stage

MAX_LABELLED = 40_000  # labelled keys, and rows, used for fitting, at most (about)
EVIDENCE = 0.5  # least log likelihood ratio of a feature of the model, however few features there are
BLOCK = 1024  # rows fitted at a time
CHANCE = 3_000  # features that may reach the required ratio by chance, about
BANDS = (3, 6)  # occurrences of strong features at which grades 2 and 3 begin
STRONG = 3.0  # log odds from which a feature counts as strong
WORDS = re.compile(r"[^\W\d_]+")
SEVERITY = T.StructType(
    [
        T.StructField("severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("toxic", T.DoubleType()),
    ]
)


def word_features(word: str) -> tuple[str, ...]:
    return (word + "$", *(word[:k] for k in range(4, min(6, len(word)) + 1)))


def words_of(text: str | None) -> Counter:
    return Counter(WORDS.findall((text or "").lower()))


def text_features(text: str | None) -> Counter:
    """Occurrences of the words of a text ("word$") and of their beginnings ("word")."""
    out = Counter()
    for word, n in words_of(text).items():
        for feature in word_features(word):
            out[feature] += n
    return out


@dataclass
class OrdinalModel:
    weights: dict  # feature -> weight
    thresholds: np.ndarray  # ascending

    def exceed(self, texts) -> np.ndarray:
        """P(grade > k) of each text for every threshold k."""
        weights, known = self.weights, {}
        margin = np.zeros(len(texts))
        for row, text in enumerate(texts):
            counts = Counter()
            for word, n in words_of(text).items():
                held = known.get(word)
                if held is None:
                    if len(known) > 200_000:
                        known.clear()
                    held = known[word] = tuple(f for f in word_features(word) if f in weights)
                for feature in held:
                    counts[feature] += n
            margin[row] = sum(weights[f] * np.log1p(n) for f, n in counts.items())
        return 1 / (1 + np.exp(self.thresholds[None, :] - margin[:, None]))


def fit_ordinal(rows, columns, values, grades, width, levels, steps=400, rate=0.05, ridge=1e-4):
    """Weights and thresholds by full-batch gradient ascent (Adam) on the cumulative-link likelihood.

    ``rows`` ascends; entries are visited in blocks of rows, so that working memory stays small.
    Thresholds are kept ordered through their logarithmic distances.
    """
    n = len(grades)
    starts = [*range(0, n, BLOCK), n]
    ends = np.searchsorted(rows, np.array(starts, dtype=rows.dtype))
    blocks = list(zip(starts, starts[1:], ends, ends[1:]))
    w, base = np.zeros(width), np.array([1.0] + [0.0] * (levels - 2))
    m = [np.zeros(width), np.zeros(levels - 1)]
    v = [np.zeros(width), np.zeros(levels - 1)]
    for step in range(1, steps + 1):
        gaps = np.exp(base[1:])
        theta = base[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        margin = np.empty(n)
        for first, last, a, b in blocks:
            margin[first:last] = np.bincount(rows[a:b] - first, values[a:b] * w[columns[a:b]], last - first)
        above = 1 / (1 + np.exp(theta[None, :] - margin[:, None]))  # P(y > k)
        edge = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        slope = edge * (1 - edge)
        pick = np.arange(n)
        p = np.maximum(edge[pick, grades] - edge[pick, grades + 1], 1e-12)
        g_margin = (slope[pick, grades] - slope[pick, grades + 1]) / p
        g_theta = np.zeros(levels - 1)
        for k in range(levels - 1):
            lower, upper = grades == k, grades == k + 1  # theta_k bounds these two grades
            g_theta[k] = (slope[lower, k + 1] / p[lower]).sum() - (slope[upper, k + 1] / p[upper]).sum()
        g_base = np.array([g_theta.sum()] + [g_theta[k + 1 :].sum() * gaps[k] for k in range(levels - 2)])
        g_w = -ridge * w
        for first, last, a, b in blocks:
            g_w += np.bincount(columns[a:b], values[a:b] * g_margin[rows[a:b]], width) / n
        for k, (x, g) in enumerate(((w, g_w), (base, g_base / n))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return w, base[0] + np.concatenate(([0.0], np.cumsum(np.exp(base[1:]))))


def _document_counts(only):
    """Task-side document frequencies per feature, split by label; ``only`` limits the features."""

    def count(batches):
        totals = {}
        for batch in batches:
            for label, text in zip(batch["sample_label"], batch["sample_text"]):
                side = int(label > 0)
                for feature in text_features(text):
                    if only is None or feature in only:
                        totals.setdefault(feature, [0, 0])[side] += 1
        if totals:
            yield pd.DataFrame([(f, a, b) for f, (a, b) in totals.items()], columns=["feature", "clean", "bad"])

    return count


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="toxic", limit=MAX_LABELLED
) -> OrdinalModel:
    """Choose features, grade the labelled sample and fit the ordinal model.

    Learns outside the held-out fold (crc32 of the key modulo 5 is 0). The label sample is
    bounded, so it is broadcast; counts are aggregated in the tasks before they are shuffled.
    """
    sample = label_sample(labels.where(~is_remainder(F.col(key), 5, 0)), key, label, limit)
    rows = stage(sampled_texts(docs, sample, key, text), "toxicity-sample")
    schema = "feature string, clean long, bad long"

    def totals(frame, only):
        counted = frame.select("sample_label", "sample_text").mapInPandas(_document_counts(only), schema)
        return counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))

    is_bad = F.col("sample_label") > 0
    bad, clean = rows.agg(F.count_if(is_bad), F.count_if(~is_bad)).first()
    if not bad or not clean:
        return OrdinalModel({}, np.array([50.0, 51.0, 52.0]))
    toxic = stage(totals(rows.where("sample_label > 0"), None).where("bad >= 2"), "toxicity-features")
    share, least = bad / (bad + clean), max(EVIDENCE, math.log(max(toxic.count(), 1) / CHANCE))
    # The ratio is largest for a feature of toxic documents only: what fails then need not be counted elsewhere.
    best = F.col("bad") * F.log((F.col("bad") + 0.25) / (F.col("bad") * share + 0.25)) - F.col("bad") * (1 - share)
    candidates = toxic.where(best >= least).select("feature")
    counted = totals(rows, frozenset(r[0] for r in candidates.collect())).toPandas()
    a, b = counted["bad"].to_numpy(float), counted["clean"].to_numpy(float)
    odds = np.log((a + 0.25) / (bad + 0.5)) - np.log((b + 0.25) / (clean + 0.5))
    expected = (a + b) * bad / (bad + clean)
    ratio = np.abs(a * np.log((a + 0.25) / (expected + 0.25)) - (a - expected))
    order = np.lexsort((counted["feature"].to_numpy(), -ratio))[: (ratio >= least).sum()]
    names = counted["feature"].to_numpy()[order]
    strong = {f for f, o, n in zip(names, odds[order], a[order]) if o >= STRONG and n >= 3}
    index = {f: i for i, f in enumerate(names)}
    del counted, a, b, odds, expected, ratio

    def vectors(batches):
        for batch in batches:
            out = []
            for doc, label, text in zip(batch["sample_key"], batch["sample_label"], batch["sample_text"]):
                counts = text_features(text)
                held = [(index[f], n) for f, n in counts.items() if f in index]
                hits = sum(n for word, n in words_of(text).items() if not strong.isdisjoint(word_features(word)))
                grade = 0 if label <= 0 else 1 + sum(hits >= band for band in BANDS)
                ids, counts = np.array(held, dtype=np.int32).reshape(-1, 2).T
                out.append((doc, grade, ids.tobytes(), np.log1p(counts, dtype=np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["doc", "grade", "columns", "values"])

    held = rows.select("sample_key", "sample_label", "sample_text").mapInPandas(
        vectors, f"doc {rows.schema['sample_key'].dataType.simpleString()}, grade int, columns binary, values binary"
    )
    # Fetched part by part: the driver holds the packed sample, and never its rows in several forms at once.
    found = sorted(stage(held, "toxicity-vectors").toLocalIterator(), key=lambda r: r["doc"])
    lengths = np.array([len(r["columns"]) // 4 for r in found])
    grades = np.array([r["grade"] for r in found])
    columns = np.frombuffer(b"".join(r["columns"] for r in found), dtype=np.int32)
    values = np.frombuffer(b"".join(r["values"] for r in found), dtype=np.float32)
    rows_of = np.repeat(np.arange(len(found), dtype=np.int32), lengths)
    del found
    weights, thresholds = fit_ordinal(rows_of, columns, values, grades, len(names), len(BANDS) + 2)
    return OrdinalModel({f: float(weights[i]) for f, i in index.items() if weights[i]}, thresholds)


def toxicity(text: Column, model: OrdinalModel) -> Column:
    """Struct (severity: expected grade, grade: likeliest grade, toxic: P(grade > 0)) of a text column."""

    def score(texts: pd.Series) -> pd.DataFrame:
        above = model.exceed(list(texts))
        edge = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1)
        return pd.DataFrame(
            {
                "severity": above.sum(axis=1),
                "grade": (edge[:, :-1] - edge[:, 1:]).argmax(axis=1).astype(np.int32),
                "toxic": above[:, 0],
            }
        )

    return F.pandas_udf(score, SEVERITY)(text)
