"""Byte-level BPE: encode every distinct word of the corpus once; decode by the token-byte table.

Texts are cut into words where the pre-token pattern can never match across, their
positions stay in their block (see ``blocks``), and the distinct words of all blocks are
shuffled by word. Each is encoded once in its partition, pre-token by pre-token, and the
ids go back to the blocks, where the documents are put together by position. Decoding
looks every id up in the table of token bytes, a table of fixed size.

Defined results: a null or empty text has no ids and decodes to no bytes. Repeated rows and
null keys give a row each.
"""

import base64
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import pack_numbers, unpack_numbers, word_blocks, words_of
from .common import release_memory, worker_cache

SLICE = 512  # documents decoded at a time
REMEMBERED = 1_000_000  # words whose ids a task remembers; beyond that it starts afresh
# White space other than single spaces and single line breaks inside a text.
ODD_SPACE = re.compile(r"[^\S\n ]| [ \n]|\n[ \n]| \Z")
PLAIN_WORD = re.compile(r"\n| ?[^ \n]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _vocabulary(path: str, pattern: str):
    """(encoder, token bytes by id, compiled pattern), one per Python worker."""
    cache = worker_cache("bpe-ranks")
    if (path, pattern) not in cache:
        import regex
        import tiktoken

        ranks = read_ranks(path)
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        cache[path, pattern] = encoder, table, regex.compile(pattern)
    return cache[path, pattern]


def cut_words(text: str, pattern) -> list[str]:
    """Words that the pre-token pattern never matches across; joined they are the text.

    With only single spaces and line breaks these are the runs without white space, each
    with the space before it, and the line breaks. Any other text is cut by the pattern.
    """
    return pattern.findall(text) if ODD_SPACE.search(text) else PLAIN_WORD.findall(text)


def _deflated(words: list[bytes]) -> bytes:
    lengths = pack_numbers(np.fromiter(map(len, words), np.int64, len(words)))
    return len(lengths).to_bytes(4, "little") + lengths + zlib.compress(b"".join(words), 6)


def _inflated(packed: bytes) -> list[bytes]:
    size = int.from_bytes(packed[:4], "little")
    ends = np.cumsum(unpack_numbers(packed[4 : 4 + size])).tolist()
    joined = zlib.decompress(packed[4 + size :])
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def encode(docs: DataFrame, ranks: str, pattern: str, key="doc_id", text="text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit numbers."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(value):
        return cut_words(value, _vocabulary(ranks, pattern)[2])

    blocks = word_blocks(docs, cut, buckets, F.lit(False), key, text)

    def pack_words(batches):
        """Word lists as deflated bytes, as they are shuffled."""
        for batch in batches:
            words = [_deflated([w.encode() for w in v.as_py()]) for v in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(words)], packed)
            del words, batch
        release_memory()

    def encode_words(batches):
        encoder, known = _vocabulary(ranks, pattern)[0], {}
        for batch in batches:
            sizes, flat = [], []
            for words in batch.column("words"):
                parts = []
                for word in _inflated(words.as_py()):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        ids = known[word] = np.array(encoder.encode_ordinary(word.decode()), dtype="<u4").tobytes()
                    parts.append(ids)
                sizes.append(pack_numbers(np.fromiter(map(len, parts), np.int64, len(parts)) // 4))
                flat.append(pack_numbers(np.frombuffer(b"".join(parts), "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(sizes), pa.array(flat)], done)
            del sizes, flat, batch
        known.clear()
        release_memory()

    packed, done = ["block", "bucket", "words"], ["in_block", "in_bucket", "sizes", "ids"]
    words = words_of(blocks).select(*packed).mapInArrow(pack_words, "block long, bucket int, words binary")
    encoded = words.repartition(buckets, "bucket").mapInArrow(
        encode_words, "in_block long, in_bucket int, sizes binary, ids binary"
    )
    # The block's own rows, where they were staged: documents with codes, buckets with their words' numbers.
    # Keys travel as text, because pandas would turn a column with nulls into floats.
    own_rows = blocks.select("block", F.col("doc_id").cast("string").alias("doc_id"), "codes", "bucket", "numbers")

    def assemble(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        documents, numbered = rows[rows["bucket"].isna()], rows[rows["bucket"].notna()].set_index("bucket")["numbers"]
        none = [np.zeros(0, np.int64)]
        numbers = np.concatenate(none + [np.asarray(numbered[b], dtype=np.int64) for b in words["in_bucket"]])
        sizes, ids = (np.concatenate(none + [unpack_numbers(v) for v in words[c]]) for c in ("sizes", "ids"))
        many_of, start_of = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        many_of[numbers], start_of[numbers] = sizes, np.cumsum(sizes) - sizes
        ids, out = ids.astype("<u4"), []
        for codes in documents["codes"]:
            own = unpack_numbers(codes)
            many = many_of[own]
            ends = np.cumsum(many)
            places = np.repeat(start_of[own] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
            out.append(ids[places].tobytes())
        return pd.DataFrame({"doc_id": documents["doc_id"].to_numpy(), "ids": out})

    kind = blocks.schema["doc_id"].dataType
    grouped = own_rows.groupBy("block").cogroup(encoded.groupBy("in_block"))
    found = grouped.applyInPandas(assemble, "doc_id string, ids binary")
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), "ids")


def decode(encoded: DataFrame, ranks: str, pattern: str, ids="ids", into="decoded") -> DataFrame:
    """Add the bytes of the ids as the last column; rows with null ids decode to null."""
    kept = [f for f in encoded.schema.fields if f.name != into]

    def run(batches):
        table = _vocabulary(ranks, pattern)[1]
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                found = [
                    None if v is None else b"".join(map(table.__getitem__, np.frombuffer(v, dtype="<u4").tolist()))
                    for v in part.column(ids).to_pylist()
                ]
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], [*[f.name for f in kept], into])

    schema = T.StructType([*kept, T.StructField(into, T.BinaryType())])
    return encoded.select(*[F.col(f.name) for f in kept]).mapInArrow(run, schema)
