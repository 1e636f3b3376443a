"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

Documents become token counts and checksums in one narrow pass. Only documents longer
than a sequence are cut: full pieces are sequences of their own, the rest (the first
piece) is packed like any short document. The short pieces are dealt by a hash into
partitions of bounded size; each is packed by best-fit decreasing and certified by the
lower bounds of dual feasible functions. Where a partition uses more sequences than its
bound, there may be a gap: all such partitions pool their documents, are dealt anew, and
best-fit decreasing runs again; the new packing is kept when the pool needs fewer
sequences. Certified partitions stay as they are.

Defined results: a null text counts as empty (one end token); a null id is packed like any
other; repeated rows are documents of their own. An empty table gives no sequences.
"""

import base64
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, worker_cache

SEQUENCE = 1024
END_TOKEN = 2
PER_PARTITION = 16_384  # short pieces dealt to one partition, on average
ROUNDS = 3
# The printable stand-ins that byte-level vocabularies use for bytes.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte."""
    others = [b for b in range(256) if b not in PLAIN_BYTES]
    return {**{chr(b): b for b in PLAIN_BYTES}, **{chr(256 + k): b for k, b in enumerate(others)}}


def vocabulary_encoder(path: str):
    """An encoder for the byte-level BPE of a tokenizer file, one per Python worker.

    The file's vocabulary is numbered in merge order, so its ids are merge ranks and the
    ids equal those of the tokenizers library (see the tests), at several times the speed.
    Added tokens in a text become their ids, as in the library with the file as loaded.
    """
    cache = worker_cache("bpe-json")
    if path not in cache:
        import public_tokenizers
        import tiktoken

        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"]: t["id"] for t in content.get("added_tokens", ())}
        ranks = {
            bytes(alphabet[c] for c in token): rank
            for token, rank in content["model"]["vocab"].items()
            if token not in special
        }
        cache[path] = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return cache[path]


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``size``."""
    first = length % size or size if length > size else length
    return [(0, first)] + [(at, size) for at in range(first, length, size)]


def pieces(docs: DataFrame, tokenizer: str, key="doc_id", text="text", size=SEQUENCE, end=END_TOKEN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def tokenise(batches):
        encoder = vocabulary_encoder(tokenizer)
        for batch in batches:
            rows, out = [], []
            for row, value in enumerate(batch.column("text")):
                ids = encoder.encode_to_numpy(value.as_py() or "", allowed_special="all").astype("<u4")
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), size)):
                    rows.append(row)
                    out.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            table = np.array(out, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(table[:, 0].astype(np.int32)),
                    *[pa.array(table[:, k]) for k in (1, 2, 3)],
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    known = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = known.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(tokenise, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item; the open bin with the least sufficient room takes the next largest item.

    A bit mask holds which amounts of room occur, so each item takes constant time.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room, mask, used = [[] for _ in range(size + 1)], 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, at, used = size, used, used + 1
        bins[item], offsets[item] = at, size - room
        left = room - need
        if left:
            by_room[left].append(at)
            mask |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best bound of two families of dual feasible functions on the number of bins.

    ``near``: items over size - t count as full and items under t as nothing, for any t up to
    half a bin. ``step``: item x counts as floor((k+1) x / size) / k, or x / size where that
    is whole, for k up to 20.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    items, mass = np.cumsum(counts), np.cumsum(counts * x)
    best = -(-int(mass[-1]) // size)
    for t in range(1, size // 2 + 1):
        full = items[-1] - items[size - t]
        best = max(best, int(full) + -(-int(mass[size - t] - mass[t - 1]) // size))
    for k in range(1, 21):
        whole = (k + 1) * x % size == 0
        scaled = np.where(whole, x * k, (k + 1) * x // size * size)  # times k * size
        best = max(best, -(-int((counts * scaled).sum()) // (k * size)))
    return best


def _pack(size: int, salt: int):
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "ids_crc32"], ascending=[False, True, True], kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, size)
        used, bound = int(bins.max()) + 1, lower_bound(lengths, size)
        return group.assign(
            bin=bins, offset=offsets, part=int(key[0]), salt=salt, used=used, gap=used - bound
        )[["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "part", "salt", "used", "gap", "row"]]

    return pack


def _dealt(short: DataFrame, count: int, salt: int, size: int, per_partition: int) -> DataFrame:
    parts = max(1, -(-count // per_partition))
    deal = F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts))  # by row, so copies spread like any others
    kind = short.schema["doc_id"].dataType
    schema = (
        "doc_id string, piece int, start long, length long, ids_crc32 long, bin long, offset long, "
        "part long, salt int, used long, gap long, row long"
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    # Keys travel as text, because pandas would turn a column with nulls into floats.
    keyed = short.select(*columns, deal.cast("long").alias("deal")).withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = keyed.groupBy("deal").applyInPandas(_pack(size, salt), schema)
    return stage(packed.withColumn("doc_id", F.col("doc_id").cast(kind)), f"packing-{salt}")


def pack(found: DataFrame, size=SEQUENCE, per_partition=PER_PARTITION, rounds=ROUNDS) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``. ``found`` is staged first, as it is read several times."""
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    short, full = found.where(F.col("length") < size), found.where(F.col("length") >= size)
    count = short.count()
    current, kept = _dealt(short, count, 0, size, per_partition), []
    for salt in range(1, rounds + 1):
        open_parts = current.where("gap > 0")
        summary = open_parts.groupBy("part").agg(F.first("used").alias("used"), F.count("*").alias("n"))
        pool = summary.agg(F.sum("used").alias("used"), F.sum("n").alias("n"), F.count("*").alias("parts")).first()
        if not pool["parts"] or pool["parts"] < 2 and salt > 1:
            break
        again = _dealt(open_parts, pool["n"], salt, size, per_partition)
        used = again.groupBy("part").agg(F.first("used").alias("used")).agg(F.sum("used")).first()[0]
        if used >= pool["used"]:
            break
        kept.append(current.where("gap = 0"))
        current = again
    kept.append(current)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # One number per (round, partition, bin) for shared sequences; full pieces count downwards from -1.
    sequence = F.shiftleft(F.col("salt").cast("long"), 60) + F.shiftleft(F.col("part"), 24) + F.col("bin")
    out = full.select(
        *columns, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    for part in kept:
        out = out.unionByName(part.select(*columns, sequence.alias("sequence_id"), "offset"))
    return out
