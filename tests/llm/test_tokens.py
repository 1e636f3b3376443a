"""Packing and byte-level BPE against the tokenizer libraries, text by text."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalogweave.llm import blocks, bpe, packing
from catalogweave.llm.suite import op4_packing, op8_bpe

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(JSON)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def loaded():
    """The tokenizer as its file says, added tokens included."""
    return Tokenizer.from_file(JSON)


def library_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = [
    "<|endoftext|> is text", "a  b", "a \n b", "\n\n\nx", "x\n", "x ", " x", "\u00a0x\u3000y", "tab\tx", "it's 'S", "½Ⅷ²3",
    "\U0001f469\u200d\U0001f680", "e\u0301", "\x00\x01", "a" * 700, "don't\x1cx", "x \n", "A\r\nB",
]


def test_units_are_whole_matches(tokenizer):
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    random.seed(3)
    alphabet = ["a", "B", "é", "1", "²", "_", ".", "'", "'s", " ", " ", "\n", "\t", "\u00a0", "\x1c", "\x85", "字"]
    texts = ODD + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    for text in texts:
        words = bpe.cut_words(text, pattern)
        assert "".join(words) == text
        assert [m for w in words for m in pattern.findall(w)] == pattern.findall(text), repr(text)


def test_packing_query(spark, sf_dir, texts, loaded):
    rows = op4_packing(spark, sf_dir).toPandas()
    ids = {i: np.array([*library_ids(loaded, t), 2], dtype="<u4") for i, t in texts.items()}
    for doc, own in rows.sort_values("piece").groupby("doc_id"):
        whole = ids[doc]
        assert own["piece"].tolist() == list(range(len(own)))
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
        assert own["length"].sum() == len(whole)
        assert (own["length"].iloc[1:] == 1024).all() and (len(own) == 1 or len(whole) > 1024)
        assert own["ids_crc32"].tolist() == [
            zlib.crc32(whole[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])
        ]
    assert set(rows["doc_id"]) == set(texts)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 1024
    short = rows.loc[rows["length"] < 1024, "length"].to_numpy()
    bound = packing.lower_bound(short, 1024) + (rows["length"] == 1024).sum()
    assert bound <= rows["sequence_id"].nunique() <= bound * 1.02 + 1


def test_many_partitions_exchange(spark):
    """Small partitions leave gaps that the exchange closes; nothing is lost on the way."""
    random.seed(1)
    rows = [(k, 0, 0, random.randint(200, 700), k) for k in range(600)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(found, per_partition=40).toPandas()
    assert sorted(got["doc_id"]) == list(range(600))
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024
    lengths = np.array([r[3] for r in rows])
    apart = packing.pack(found, per_partition=40, rounds=0).toPandas()["sequence_id"].nunique()
    assert packing.lower_bound(lengths, 1024) <= got["sequence_id"].nunique() <= apart


def test_pieces_hold_the_ids_of_the_loaded_file(spark, loaded):
    docs = spark.createDataFrame(list(enumerate(ODD + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>"])), "doc_id long, text string")
    for row in packing.pieces(docs, JSON).join(docs, "doc_id").collect():
        ids = np.array([*library_ids(loaded, row["text"]), 2], dtype="<u4")
        assert row["length"] == len(ids) and row["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_repeated_rows_are_spread(spark):
    """One row a thousand times: no group takes more than a few times its share, and nothing is lost."""
    found = spark.createDataFrame([(1, 0, 0, 300, 7)] * 1000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(found, per_partition=50).toPandas()
    assert len(got) == 1000 and got.groupby("sequence_id")["length"].sum().max() <= 1024
    assert got["sequence_id"].nunique() <= -(-1000 // 3) + 20
    dealt = packing._dealt(found.withColumn("row", F.monotonically_increasing_id()), 1000, 0, 1024, 50)
    assert dealt.groupBy("part").count().agg(F.max("count")).first()[0] < 150


def test_lower_bound_never_exceeds_best_fit():
    random.seed(2)
    for _ in range(200):
        size = random.choice([10, 17, 64])
        lengths = np.array([random.randint(1, size) for _ in range(random.randint(1, 30))])
        bins, offsets = packing.best_fit_decreasing(lengths, size)
        assert all(lengths[bins == b].sum() <= size for b in set(bins))
        assert packing.lower_bound(lengths, size) <= bins.max() + 1
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([4] * 5), 10) == 3
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(2049, 1024) == [(0, 1), (1, 1024), (1025, 1024)]


def test_bpe_query(spark, sf_dir, texts, tokenizer):
    rows = {r["doc_id"]: r for r in op8_bpe(spark, sf_dir).collect()}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        ids = np.array(library_ids(tokenizer, text), dtype="<u4")
        assert rows[doc]["n_tokens"] == len(ids)
        assert rows[doc]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[doc]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("most", [250_000, 3])
def test_odd_rows(spark, odd_docs, no_docs, tokenizer, monkeypatch, most):
    """Round trip of odd texts, in one block and in many."""
    monkeypatch.setattr(blocks, "MOST_WORDS", most)
    docs = odd_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    )
    encoded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    rows = encoded.join(docs.distinct(), encoded["doc_id"].eqNullSafe(docs["doc_id"])).select("text", "ids", "decoded")
    assert encoded.count() == docs.count() and rows.count() == docs.count()
    for row in rows.collect():
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
        assert np.frombuffer(row["ids"], "<u4").tolist() == library_ids(tokenizer, row["text"])
    large = spark.createDataFrame([(2**62 + 1, "a b"), (None, "a b"), (2**62 + 3, "c")], "doc_id long, text string").coalesce(1)
    wanted = {None, 2**62 + 1, 2**62 + 3}
    assert {r["doc_id"] for r in bpe.encode(large, RANKS, public_tokenizers.PATTERN).collect()} == wanted
    assert {r["doc_id"] for r in packing.pack(packing.pieces(large, JSON)).collect()} == wanted
    pieces = packing.pack(packing.pieces(odd_docs, JSON)).toPandas()
    assert pieces["doc_id"].isna().sum() == 1 and pieces.loc[pieces["doc_id"] == 0, "length"].tolist() == [1]
    assert packing.pack(packing.pieces(no_docs, JSON)).count() == 0
    assert bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_freed_memory_goes_back_to_the_system():
    """An idle Python worker does not keep what its last task has freed."""
    import os
    import sys

    import pytest

    from catalogweave.llm.common import release_memory

    if sys.platform != "linux":
        pytest.skip("reads /proc")

    def resident():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    held = [bytearray(b"x" * 50_000) for _ in range(4000)]
    kept = held[::400]  # scattered, so the heap cannot simply shrink
    full = resident()
    del held
    release_memory()
    assert len(kept) == 10 and resident() < full - (150 << 20)
