"""Token counts against the tokenizers library as it is loaded."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from catalogweave.llm import token_counts
from catalogweave.llm.suite import op11_tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x <|endoftext", "<|endo<|endoftext|>ftext|>",
    "a  b", "a \n b", "\n\n\nx", "x\n", "x ", " x", " x　y", "tab\tx", "it's 'S \"'s ''s", "½Ⅷ²3 _a_",
    "\U0001f469‍\U0001f680", "é", "\x00\x01", "a" * 700, "don't\x1cx", "x \n", "A\r\nB",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def library_count(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_query_equals_the_library(spark, sf_dir, texts, tokenizer):
    rows = {r["doc_id"]: r for r in op11_tokens(spark, sf_dir).collect()}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        count = library_count(tokenizer, text)
        assert rows[doc]["n_tokens"] == count and rows[doc]["over_limit"] == (count > 1024)
        assert rows[doc]["n_bytes"] == len((text or "").encode())


@pytest.mark.parametrize("share, remembered, size", [(1 / 40_000, 400_000, 1 << 18), (1 / 50, 2, 3)])
def test_odd_rows(spark, odd_docs, no_docs, tokenizer, monkeypatch, share, remembered, size):
    """Odd texts, also with a tiny first tier, a forgetful second one and slices of three characters."""
    monkeypatch.setattr(token_counts, "REMEMBERED", remembered)
    monkeypatch.setattr(token_counts, "SLICE", size)
    random.seed(5)
    alphabet = ["a", "B", "é", "1", "²", "_", ".", "'", "'s", " ", " ", "\n", "\t", " ", "\x1c", "\x85", "字", "<|endoftext|>"]
    made = ODD + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 14))) for _ in range(1500)]
    added = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(made)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(added)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, JSON, share=share).collect())
    wanted = Counter((r["doc_id"], len((r["text"] or "").encode()), library_count(tokenizer, r["text"])) for r in docs.collect())
    assert got == wanted
    assert token_counts.token_counts(no_docs, JSON, share=share).count() == 0
    assert token_counts.token_counts(odd_docs, JSON).columns == ["doc_id", "n_bytes", "n_tokens"]


def test_first_tier_holds_all_that_reach_the_share(spark, monkeypatch):
    random.seed(6)
    words = [f"w{'abcdefghij'[random.randrange(10)] * random.randrange(1, 60)}" for _ in range(6000)] + ["often"] * 600
    random.shuffle(words)
    texts = [(" ".join(words[at : at + 50]),) for at in range(0, len(words), 50)]
    docs = spark.createDataFrame(texts, "text string").repartition(4)
    share = 1 / 60
    found = {r["word"] for r in token_counts.frequent_lengths(docs, JSON, share=share).collect()}
    counts = Counter(w for (text,) in texts for _, part in token_counts.pre_tokens(text, token_counts.splitter(JSON)) for w in part)
    total = sum(counts.values())
    assert {w for w, n in counts.items() if n >= share * total} <= found and len(found) <= 4 / (3 * share)
    assert {w for w in found if counts[w] < 0.75 * share * total} == set()


def test_trim_keeps_the_frequent():
    counts = Counter({"a": 100, "b": 50, "c": 2, "d": 2, "e": 1})
    token_counts.trim(counts, 2)
    assert counts == {"a": 98, "b": 48}
