"""Documents as blocks of word numbers, each block with its own dictionary.

One narrow pass cuts every text into words and replaces each by its number in the
dictionary of the block (some thousand documents of one task). What later has to be
shuffled by word is then one entry per distinct word and BLOCK instead of one per
occurrence; positions stay in the block's documents. A block closes at a bounded number
of words or occurrences, so its memory is bounded, whatever the table's size; a single long
document is a block of its own.

The staged table has a row per document (codes, packed) and rows per block and bucket
(words with their numbers in the block): ``bucket`` is null in the former. Numbers are
given by frequency, so frequent words have small ones and codes pack well. The table is
bucketed by block, so its documents need no shuffle to meet what comes back for a block.
"""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, stage_by

MOST_WORDS = 350_000
MOST_OCCURRENCES = 2_500_000


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers, byte plane by byte plane, deflated."""
    planes = np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(planes.tobytes(), 6)


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def word_blocks(docs: DataFrame, cut, buckets: int, counted: Column, key="doc_id", text="text") -> DataFrame:
    """Stage ``docs`` as blocks. ``cut(text)`` lists the words of a text, never null.

    ``counts`` holds each word's occurrences in documents where ``counted`` is true.
    """
    known = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), counted.alias("counted"))
    kind = known.schema["doc_id"].dataType.simpleString()
    schema = (
        f"block long, doc_id {kind}, counted boolean, codes binary, bucket int, numbers array<int>, "
        "words array<string>, counts array<long>"
    )

    def closed(block, id_type, ids, flags, codes, place):
        """The rows of a finished block."""
        seen = np.bincount(np.concatenate(codes), minlength=len(place))
        ranked = np.argsort(-seen, kind="stable")
        rank = np.empty(len(seen), np.int32)
        rank[ranked] = np.arange(len(seen), dtype=np.int32)
        codes, listed = [rank[own] for own in codes], list(place)
        words = [listed[k] for k in ranked]
        counts = np.zeros(len(words), np.int64)
        learned = [own for flag, own in zip(flags, codes) if flag]
        if learned:
            counts += np.bincount(np.concatenate(learned), minlength=len(words))
        bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words], dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        used, starts = np.unique(bucket[order], return_index=True)
        own = [order[a:b] for a, b in zip(starts, [*starts[1:], len(words)])]
        n, m = len(ids), len(used)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (n + m), pa.int64()),
                pa.array(ids + [None] * m, id_type),
                pa.array(flags + [None] * m, pa.bool_()),
                pa.array([pack_numbers(c) for c in codes] + [None] * m, pa.binary()),
                pa.array([None] * n + used.tolist(), pa.int32()),
                pa.array([None] * n + [o.astype(np.int32) for o in own], pa.list_(pa.int32())),
                pa.array([None] * n + [[words[k] for k in o] for o in own], pa.list_(pa.string())),
                pa.array([None] * n + [counts[o] for o in own], pa.list_(pa.int64())),
            ],
            names=["block", "doc_id", "counted", "codes", "bucket", "numbers", "words", "counts"],
        )

    def run(batches):
        task, blocks = TaskContext.get().partitionId(), itertools.count()
        ids, flags, codes, size, id_type = [], [], [], 0, None
        place = defaultdict(itertools.count().__next__)
        for batch in batches:
            id_type = batch.column("doc_id").type
            for doc, value, flag in zip(batch.column("doc_id"), batch.column("text"), batch.column("counted")):
                own = np.fromiter(map(place.__getitem__, cut(value.as_py() or "")), np.int32)
                ids.append(doc.as_py())
                flags.append(bool(flag.as_py()))
                codes.append(own)
                size += len(own)
                if size > MOST_OCCURRENCES or len(place) > MOST_WORDS:
                    done = closed((task << 24) + next(blocks), id_type, ids, flags, codes, place)
                    ids, flags, codes, size = [], [], [], 0
                    place = defaultdict(itertools.count().__next__)  # gone before the block is handed over
                    yield done
                    del done
        if ids:
            done = closed((task << 24) + next(blocks), id_type, ids, flags, codes, place)
            del ids, flags, codes, place
            yield done
            del done
        release_memory()

    return stage_by(known.mapInArrow(run, schema), "blocks", "block", buckets)


def documents_of(blocks: DataFrame) -> DataFrame:
    return blocks.where("bucket IS NULL").select("block", "doc_id", "counted", "codes")


def words_of(blocks: DataFrame) -> DataFrame:
    """One row per block and bucket: block, bucket, numbers, words, counts."""
    return blocks.where("bucket IS NOT NULL").select("block", "bucket", "numbers", "words", "counts")
