"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

A text is split into the vocabulary's pre-tokens, and the number of tokens of each is looked up.

* First tier: the pre-tokens that make up at least ``SHARE`` of all, with their token counts, in a
  compact table that is broadcast. Every task summarises its own pre-tokens (Misra-Gries, bounded
  memory) and reports those near that share of them; only these reports meet. What
  reaches the share over the whole corpus reaches it in some task, so none is missed. The table
  holds at most 4 / (3 x ``SHARE``) pre-tokens of ``LONGEST`` bytes, whatever the corpus.
* Second tier: all others are encoded by the library and remembered by the Python worker, in two
  generations of ``REMEMBERED`` pre-tokens: when the younger is full it becomes the older one, so what
  is still in use moves on and memory stays bounded.

The tiers only save work: a count never depends on them. Strings of added tokens in a text count
as one token each, as the library has it by default. A text beyond ``SLICE`` characters is worked
on in slices cut between two pre-tokens.

Defined results: a null or empty text has no bytes and no tokens. Repeated rows and null keys
give a row each; an empty table gives none.
"""

import json
import os
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, worker_cache
from .packing import byte_alphabet

SHARE = 1 / 40_000  # of all pre-tokens
LONGEST = 64  # bytes of a pre-token in the first tier or in a worker's memory
REMEMBERED = 400_000  # pre-tokens of a generation
SLICE = 1 << 18
CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")  # a single space between letters or digits starts a pre-token


@dataclass
class Splitter:
    """What a tokenizer file says about splitting, and its model."""

    pattern: object  # compiled pre-token pattern
    added: object  # compiled alternatives of the added tokens, or None
    model: object  # the library's model
    alphabet: list  # the stand-in character of every byte

    def length(self, pre_token: str) -> int:
        return len(self.model.tokenize("".join(map(self.alphabet.__getitem__, pre_token.encode()))))


def splitter(path: str) -> Splitter:
    """The splitter of a byte-level BPE tokenizer file, one per Python worker."""
    cache = worker_cache("token-splitters")
    if path not in cache:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        split, added = content["pre_tokenizer"], content.get("added_tokens", [])
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or content.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        byte_of = byte_alphabet()
        cache[path] = Splitter(
            regex.compile(public_tokenizers.PATTERN),
            regex.compile("|".join(map(regex.escape, names))) if names else None,
            Tokenizer.from_file(path).model,
            [c for _, c in sorted((b, c) for c, b in byte_of.items())],
        )
    return cache[path]


def slices(text: str):
    """The text in parts that no pre-token reaches across, of about ``SLICE`` characters."""
    at = 0
    while len(text) - at > SLICE:
        found = CUT.search(text, at + SLICE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def pre_tokens(text: str | None, split: Splitter):
    """(number of added tokens, list of pre-tokens) for each slice of a text."""
    if not text:
        return
    parts = split.added.split(text) if split.added else [text]
    if len(parts) > 1:
        yield len(parts) - 1, []
    for part in parts:
        for piece in slices(part):
            yield 0, split.pattern.findall(piece)


def trim(counts: Counter, most: int) -> None:
    """Misra-Gries: take the (most + 1)-th largest count off all, so at most ``most`` remain."""
    values = np.fromiter(counts.values(), np.int64, len(counts))
    floor = int(np.partition(values, len(values) - most - 1)[len(values) - most - 1])
    kept = {word: n - floor for word, n in counts.items() if n > floor}
    counts.clear()
    counts.update(kept)


def frequent_lengths(docs: DataFrame, tokenizer: str, text="text", share=SHARE) -> DataFrame:
    """(word, n): the frequent pre-tokens and their number of tokens."""
    most = int(4 / share)

    def summarise(batches):
        split, counts, total = splitter(tokenizer), Counter(), 0
        for batch in batches:
            for value in batch.column("text"):
                for _, words in pre_tokens(value.as_py(), split):
                    counts.update(words)
                    total += len(words)
                if len(counts) > 2 * most:
                    trim(counts, most)
        # A trimmed count is short by a quarter of the share at most.
        least = 0.75 * share * total
        near = {w: n for w, n in counts.items() if n >= least and len(w.encode()) <= LONGEST}
        yield pa.RecordBatch.from_arrays(
            [pa.array([*near, None], pa.string()), pa.array([*near.values(), total], pa.int64())], names=["word", "seen"]
        )

    reports = stage(docs.select(F.col(text).alias("text")).mapInArrow(summarise, "word string, seen long"), "pre-tokens")
    total = reports.where("word IS NULL").agg(F.sum("seen")).first()[0] or 0
    heavy = reports.where("word IS NOT NULL").groupBy("word").agg(F.sum("seen").alias("seen"))

    def lengths(batches):
        split = splitter(tokenizer)
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays(
                [words, pa.array([split.length(w.as_py()) for w in words], pa.int64())], names=["word", "n"]
            )

    return heavy.where(F.col("seen") >= 0.75 * share * total).select("word").mapInArrow(lengths, "word string, n long")


def compact(table: pd.DataFrame) -> bytes:
    """Words and token counts in one deflated block."""
    words = [w.encode() for w in table["word"]]
    numbers = np.array([[len(w) for w in words], table["n"]], dtype="<u2")
    return len(words).to_bytes(4, "little") + zlib.compress(numbers.tobytes() + b"".join(words))


def expand(block: bytes) -> dict[str, int]:
    size, content = int.from_bytes(block[:4], "little"), zlib.decompress(block[4:])
    sizes, counts = np.frombuffer(content[: 4 * size], "<u2").reshape(2, size).tolist()
    ends = np.cumsum([4 * size, *sizes]).tolist()
    return {content[a:b].decode(): n for a, b, n in zip(ends, ends[1:], counts)}


class Lookup(dict):
    """The first tier; what it lacks is looked for in the second."""

    def __init__(self, first: dict[str, int], split: Splitter):
        super().__init__(first)
        self.split, self.young, self.old = split, {}, {}

    def __missing__(self, word: str) -> int:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self.split.length(word)
            if len(word) <= LONGEST:
                if len(self.young) >= REMEMBERED:
                    self.young, self.old = {}, self.young
                self.young[word] = found
        return found

    def count(self, text: str | None) -> int:
        return sum(extra + sum(map(self.__getitem__, words)) for extra, words in pre_tokens(text, self.split))


def token_counts(docs: DataFrame, tokenizer: str, key="doc_id", text="text", share=SHARE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row; ``tokenizer`` is a byte-level BPE file of the tokenizers library."""
    spark = docs.sparkSession
    table = frequent_lengths(docs, tokenizer, text, share).toPandas()
    first = spark.sparkContext.broadcast(compact(table))

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        cache, known = worker_cache("token-lookups"), (tokenizer, first.value)
        if cache.get("of") != known:  # a worker keeps its memory from task to task
            cache["of"], cache["lookup"] = known, Lookup(expand(first.value), splitter(tokenizer))
        return pd.Series([cache["lookup"].count(t) for t in texts], dtype="int64")

    return docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
        counted(F.col(text)).alias("n_tokens"),
    )
