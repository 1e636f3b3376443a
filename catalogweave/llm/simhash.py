"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has bit b set when more than half of the hashes of its word
shingles have it. Fingerprints within ``TOLERANCE`` differing bits are linked.

Search. The 64 bits are divided into m parts, correlated bits together. If two
fingerprints differ in at most d bits and the parts' thresholds add up to d - m + 1, then
in some part they differ by no more than its threshold (a threshold of -1 ignores a part).
Dynamic programming chooses the thresholds, and with them m, from the number of probes and
of candidate pairs that each part costs at each threshold. Candidate counts come from the
exact histogram of part values over all fingerprints and from the bits' agreement rates.
Every fingerprint probes all values within the threshold of its own part value; candidates
are verified with the whole fingerprint.

Crowded values. Where a value of a part would give more pairs than ``CROWDED`` per row, its
rows do not meet in pairs. They are linked exactly through midpoints instead: two
fingerprints differ in at most two bits if and only if some 64-bit word is within one bit
of both. Each such row is dealt to the 65 words around it, and a word can have 65
different fingerprints at most. Work stays linear in the rows, whatever the crowd.

Exact copies have one fingerprint and are one vertex. Components are found by star
contraction; neither links nor fingerprints reach the driver, only 4,097 sums of bits and
one cost per part.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is
linked like any other. Repeated rows and ids are documents of their own; a component is
named by its smallest non-null id (null when it has none).
"""

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_one, stage, text_key
from .components import connected_components

TOLERANCE = 2
SHINGLE = 3
SEED = 42
BITS = 64
CROWDED = 130  # candidate pairs per row of a value from which midpoints are cheaper
CHUNK = 1 << 16  # hashes counted at a time


def spans(text: str | None, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The lower-cased words of a text, joined by spaces, with the starts and ends of their shingles."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return joined, [0] * bool(words), [len(joined)] * bool(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths)[: len(words) - shingle + 1].tolist()
    return joined, starts, stops[shingle - 1 :].tolist()


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    joined, starts, ends = spans(text, shingle)
    if not starts:
        return 0
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = zip(starts[at : at + CHUNK], ends[at : at + CHUNK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(BITS) if 2 * int(counts[b]) > len(starts))


def fingerprints(docs: DataFrame, key="doc_id", text="text", shingle=SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number; one narrow pass."""

    def run(batches):
        for batch in batches:
            values = np.array([simhash(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    known = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return known.mapInArrow(run, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, fp long")


def bit_sums(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for every two bits, how many have both set."""

    def run(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            total += len(values)
        flat = np.append(both.ravel(), total).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = {r["cell"]: r["n"] for r in cells.collect()}
    flat = np.array([found.get(k, 0) for k in range(BITS * BITS + 1)], dtype=np.float64)
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Divide the bits into parts of equal size, each grown from the bit pair that correlates most."""
    rate = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    strength = np.abs(both / max(total, 1) - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        order = sorted(free)
        group = [max(order, key=lambda b: strength[b, order].max())]
        free.discard(group[0])
        while len(group) < width:
            pick = max(sorted(free), key=lambda b: strength[b, group].sum())
            group.append(pick)
            free.discard(pick)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """A signed 64-bit mask of the given bits."""
    return int(np.array(sum(1 << b for b in bits), dtype=np.uint64).view(np.int64))


def flips(bits: list[int], most: int) -> list[int]:
    """Masks of every choice of at most ``most`` of the bits, the empty one first."""
    out = [[]]
    level = [[]]
    for _ in range(most):
        level = [[*chosen, b] for chosen in level for b in bits if not chosen or b > chosen[-1]]
        out += level
    return [mask_of(chosen) for chosen in out]


def _growth(total: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """P(at most t of the bits differ) / P(none differs) for two fingerprints, t = 0..most."""
    rate = np.diag(both)[bits] / max(total, 1)
    exact = np.zeros(most + 1)
    exact[0] = 1.0
    for differ in 2 * rate * (1 - rate):
        exact[1:] = exact[1:] * (1 - differ) + exact[:-1] * differ
        exact[0] *= 1 - differ
    return (np.cumsum(exact) / max(exact[0], 1e-300)).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost that add up to ``total``. ``costs[i][t + 1]`` is part i's cost at t = -1, 0, ..."""
    best = {0: (0.0, [])}
    for row in costs:
        following = {}
        for spent, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                option = (cost + more, [*chosen, k - 1])
                if spent + k - 1 not in following or option < following[spent + k - 1]:
                    following[spent + k - 1] = option
        best = following
    return best[total]


def partition_plan(fps: DataFrame, tolerance=TOLERANCE, most_parts=4) -> list[tuple[list[int], int]]:
    """The parts to probe, as (bits, threshold); parts with threshold -1 are left out."""
    total, both = bit_sums(fps)
    divisions = [group_bits(total, both, m) for m in range(1, most_parts + 1)]
    groups = [bits for division in divisions for bits in division]
    values = F.array(*[F.col("fp").bitwiseAND(F.lit(mask_of(bits))) for bits in groups])
    sizes = fps.select(F.posexplode(values).alias("part", "value")).groupBy("part", "value").agg(F.count("*").alias("n"))
    pairs = F.least(F.col("n") * (F.col("n") - 1) / 2, F.col("n") * CROWDED)
    meeting = {r["part"]: r["pairs"] for r in sizes.groupBy("part").agg(F.sum(pairs).alias("pairs")).collect()}
    plans, at = [], 0
    for m, division in enumerate(divisions, 1):
        costs = []
        for bits in division:
            growth = _growth(total, both, bits, tolerance)
            probes = np.cumsum([comb(len(bits), t) for t in range(tolerance + 1)])
            costs.append([0.0] + [total * float(p) + meeting.get(at, 0) * g for p, g in zip(probes, growth)])
            at += 1
        cost, chosen = allocate(costs, tolerance - m + 1)
        plans.append((cost, [(bits, t) for bits, t in zip(division, chosen) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def near_pairs(fps: DataFrame, tolerance=TOLERANCE) -> DataFrame:
    """(a, b): links between different fingerprints that connect all within the tolerance.

    ``fps`` has distinct fingerprints in a staged table. Outside crowds every pair within
    the tolerance is returned; within crowds, links that connect the same fingerprints.
    """
    if tolerance != 2:
        raise ValueError("crowded values are resolved through midpoints, which needs a tolerance of 2")
    probes = []
    for part, (bits, threshold) in enumerate(partition_plan(fps, tolerance)):
        own = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        probes += [
            F.struct(F.lit(part).alias("part"), own.bitwiseXOR(F.lit(flip)).alias("value"), F.lit(flip == 0).alias("own"))
            for flip in flips(bits, threshold)
        ]
    spread = fps.select("fp", F.inline(F.array(*probes)))
    crowd = spread.groupBy("part", "value").agg(F.count_if("own").alias("held"), F.count("*").alias("met"))
    crowd = crowd.where("held > 0 AND met > 1").select(
        "part", "value", (F.col("held") * F.col("met") > CROWDED * (F.col("held") + F.col("met"))).alias("crowded")
    )
    met = stage(spread.join(crowd, ["part", "value"]), "probes")
    calm = met.where("NOT crowded")
    asking = calm.select("part", "value", F.col("fp").alias("a"))
    held = calm.where("own").select("part", "value", F.col("fp").alias("b"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = asking.join(held, ["part", "value"]).where((F.col("a") < F.col("b")) & (differ <= tolerance)).select("a", "b")
    middle = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips(list(range(BITS)), 1)]))
    around = met.where("crowded").select("fp").distinct().select("fp", middle.alias("word"))
    # At most 65 fingerprints are within one bit of a word, so these sets are bounded.
    circles = around.groupBy("word").agg(F.collect_set("fp").alias("circle")).where(F.size("circle") > 1)
    linked = circles.select(F.array_min("circle").alias("a"), F.explode("circle").alias("b")).where("a <> b")
    return pairs.unionByName(linked).distinct()


def near_duplicates(docs: DataFrame, key="doc_id", text="text", shingle=SHINGLE, tolerance=TOLERANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every document."""
    marked = stage(fingerprints(docs, key, text, shingle), "fingerprints")
    fps = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct-fingerprints")
    found = connected_components(near_pairs(fps, tolerance), "a", "b")
    labelled = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = stage(labelled.select("fp", "smallest", F.coalesce("component", "fp").alias("component")), "labelled")
    names = stage(labelled.groupBy("component").agg(F.min("smallest").alias("component_id")), "names")
    named = stage(labelled.join(names, "component").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, key="doc_id", text="text", shingle=SHINGLE, tolerance=TOLERANCE) -> DataFrame:
    """One row for each component: the one with the smallest id; a row without an id only where all lack one."""
    texts = docs.select(text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    found = near_duplicates(texts, "text_key", "text", shingle, tolerance)
    groups = found.select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("component")).distinct()
    return keep_one(docs, key, text, stage(groups, "text-groups"))
