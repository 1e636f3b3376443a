"""Periodic runs against brute force: Lyndon arrays, runs and the query's digests."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from catalogweave.llm import runs
from catalogweave.llm.suite import op12_runs


def brute_lyndon(codes):
    """The longest Lyndon word at each place ends where a smaller suffix starts."""
    out = []
    for i in range(len(codes)):
        j = i + 1
        while j < len(codes) and codes[j:] > codes[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(words, times, shortest):
    out = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, times * q):
                part = words[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(size, letters):
    words = [random.randrange(letters) for _ in range(size)]
    if size and random.random() < 0.6:
        start, period = random.randrange(size), random.randint(1, max(1, size // 4))
        words = [words[i if i < start else min(start + (i - start) % period, size - 1)] for i in range(size)]
    return words


def test_lyndon_arrays():
    random.seed(11)
    for _ in range(1500):
        words = random_words(random.randint(1, 40), random.randint(1, 4))
        rank = sorted(set(words))
        codes = [rank.index(w) for w in words]
        assert runs.lyndon_lengths(codes) == brute_lyndon(codes)


@pytest.mark.parametrize("times, shortest", [(4, 6), (2, 2), (3, 4), (2, 5), (5, 6)])
def test_runs(times, shortest):
    random.seed(12)
    for _ in range(600):
        words = [b"%d" % w for w in random_words(random.randint(0, 60), random.randint(1, 5))]
        assert runs.word_runs(words, times, shortest) == brute_runs(words, times, shortest)


def test_nested_and_long_runs():
    inner = [b"a", b"b"] * 5 + [b"c"]
    words = [b"x", *inner * 40, b"y"]
    found = runs.word_runs(words)
    assert (1, 11 * 40, 11) in found and len(found) == 41 == len(brute_runs(words, 4, 6))
    assert runs.collapse(words, found) == [b"x", b"a", b"b", b"c", b"y"]
    assert runs.word_runs([b"w"] * 200_000) == [(0, 200_000, 1)]
    assert runs.gram_length(4, 6) == 5 and runs.gram_length(2, 2) == 1


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 4, 6)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in found)]
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found).encode()
    row = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
    return (*row, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query(spark, sf_dir, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_runs(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    short = [i for i, t in texts.items() if len((t or "").split()) < 1500]
    assert len(short) > 0.9 * len(texts)
    for doc in short:
        assert got[doc] == brute_row(doc, texts[doc])
    assert any(row[0] for row in got.values())


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    found = runs.periodic_runs(odd_docs)
    rows = found.collect()
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["n_words"] == 0 and by_id[0]["runs"] == [] and by_id[0]["collapsed"] == ""
    assert [tuple(r) for r in by_id[11]["runs"]] == [(0, 3000, 1)] and by_id[11]["collapsed"] == "word"
    assert runs.periodic_runs(no_docs).count() == 0
    # The query on the same rows: keys and words decide, null keys are never edited.
    odd_docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    query = op12_runs(spark, str(tmp_path)).collect()
    wanted = [brute_row(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None]
    assert sorted((tuple(r)[1:] for r in query if r["doc_id"] is not None), key=str) == sorted(wanted, key=str)
    assert sum(r["doc_id"] is None for r in query) == 1
