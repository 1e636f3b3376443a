"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

The terms of a document are its lower-cased words, weighted by their occurrences. Sample j
of a term w with weight x draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from a hash of
(w, j) alone and computes

  t = floor(ln x / r + b),   ln a = ln c - r (t - b) - r

The sample keeps the (w, t) with the smallest a. Two documents keep the same one with a
probability equal to the generalised Jaccard similarity of their weighted terms, so the
share of equal samples of two fingerprints estimates it.

Spark computes all samples of a term in one aggregation: a sample's state is one long, ln a
in its upper bits and a tag of (w, t) in its lower 24, so a minimum is all there is to
aggregate. The inverse distribution of Gamma(2, 1) is a table of ``QUANTILES`` values.

The edited text of a document ends with the beginning of the next document. Positions in
the order of ids come from a range-partitioned sort of ids alone; texts are shuffled by
document, and only the needed beginnings once more to the document before.

Defined results: a null or empty text has no terms and a fingerprint of ``EMPTY`` samples;
two such fingerprints are alike (1.0). Rows that repeat both id and text are computed once
and give as many rows; the next document of each is the next different one. Null ids come
last; ties are ordered by a hash of the text. A row is identified by a hash of its id and
one of its id and text, 128 bits together.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import with_position
from .common import stage

SAMPLES = 64
TAG_BITS = 24
EMPTY = "f" * (TAG_BITS // 4)
QUANTILES = 2048  # a power of two: eleven bits of a hash choose a quantile
AT_ONCE = 16
REPEATED_AT_ONCE = 4096
KEY = ["row", "id_hash"]
SEPARATORS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def gamma_quantiles(shares: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x)."""
    wanted, count = np.asarray(shares), len(shares)
    low, high = np.zeros(count), np.full(count, 40.0)
    for _ in range(80):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < wanted
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def _constant(values: np.ndarray) -> Column:
    """A foldable array column; the optimiser turns it into one literal."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def weighted_terms(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, log_weight): the hash of each word of a text and the logarithm of its occurrences.

    Where the rows are partitioned by one of the keys already, counting needs no shuffle. A
    text without words gives one row with nulls.
    """
    plain = F.trim(F.lower(F.col(text)), F.lit(SPACES))
    words = rows.select(*keys, F.explode_outer(F.when(plain != "", F.split(plain, SEPARATORS))).alias("word"))
    term = F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term")
    counted = words.groupBy(*keys, term).agg(F.count("word").alias("weight"))
    return counted.select(*keys, "term", F.when(F.col("weight") > 0, F.ln(F.col("weight").cast("double"))).alias("log_weight"))


def _sample(j: int, radii: Column, log_scales: Column) -> Column:
    """Order and tag of sample ``j`` of a part of the columns term and log_weight, as one long; null without a term.

    There is no condition around it: Spark shares subexpressions only outside of conditions.
    """
    drawn = F.xxhash64("term", "part", F.lit(j))

    def bits(at: int, width: int) -> Column:
        return F.shiftrightunsigned(drawn, at).bitwiseAND(F.lit((1 << width) - 1))

    r, log_c = F.get(radii, bits(0, 11).cast("int")), F.get(log_scales, bits(11, 11).cast("int"))
    b = bits(22, 18) / float(1 << 18)
    t = F.floor(F.col("log_weight") / r + b)
    log_a = log_c - r * (t - b) - r
    order = ((F.greatest(log_a, F.lit(-500.0)) + 512.0) * float(1 << 29)).cast("long")
    tag = bits(40, TAG_BITS).bitwiseXOR(t.bitwiseAND(F.lit((1 << TAG_BITS) - 1)))
    return F.shiftleft(order, TAG_BITS).bitwiseOR(tag)


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``samples`` array of tags per group of ``keys`` from (term, log_weight) rows; -1 without terms.

    Samples are made in parts of ``AT_ONCE``: an aggregation with more of them is a method that
    the virtual machine no longer compiles well.
    """
    quantiles = gamma_quantiles((np.arange(QUANTILES) + 0.5) / QUANTILES)
    radii, log_scales = _constant(quantiles), _constant(np.log(quantiles))
    parts = F.explode(F.array(*[F.lit(p) for p in range(-(-samples // AT_ONCE))])).alias("part")
    spread = terms.select(*keys, "term", "log_weight", parts)
    least = spread.groupBy(*keys, "part").agg(
        *[F.min(_sample(j, radii, log_scales)).alias(f"s{j}") for j in range(AT_ONCE)]
    )
    low = F.lit((1 << TAG_BITS) - 1)
    tags = [F.coalesce(F.col(f"s{j}").bitwiseAND(low), F.lit(-1)).cast("int") for j in range(AT_ONCE)]
    whole = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", F.array(*tags).alias("tags")))).alias("parts"))
    return whole.select(*keys, F.slice(F.flatten(F.col("parts.tags")), 1, samples).alias("samples"))


def as_text(samples: Column) -> Column:
    """Fixed-width hexadecimal digits of every sample."""
    return F.array_join(
        F.transform(samples, lambda s: F.when(s < 0, EMPTY).otherwise(F.lower(F.lpad(F.hex(s), TAG_BITS // 4, "0")))), ""
    )


def likeness(first: Column, second: Column) -> Column:
    """Share of equal samples: the estimated generalised Jaccard similarity."""
    same = F.filter(F.zip_with(first, second, lambda a, b: a == b), lambda x: x)
    return F.size(same) / F.size(first).cast("double")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id_hash, doc_id, text) of every row; equal rows have equal keys."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("doc_id").alias("id_hash"), "doc_id", "text")


def _repeated(rows: DataFrame) -> DataFrame:
    """Every row ``copies`` times, by arrays of bounded length."""
    blocks = F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / REPEATED_AT_ONCE))
    spread = rows.withColumn("block", F.explode(blocks))
    own = F.least(F.col("copies") - F.col("block") * REPEATED_AT_ONCE, F.lit(REPEATED_AT_ONCE)).cast("int")
    return spread.withColumn("copy", F.explode(F.sequence(F.lit(1), own))).drop("block", "copy", "copies")


def _without_hot_rows(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """The texts with one copy of each row that holds more than 1/(4 x partitions) of all rows; fewer than 4 x partitions do."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    large = (F.col("copies") > 1) & (F.col("copies") * F.lit(4 * partitions) > total)
    hot = [r["row"] for r in counted.where(large).select("row").collect()]
    if not hot:
        return texts
    is_hot = F.col("row").isin(hot)
    return texts.where(~is_hot).unionByName(texts.where(is_hot).dropDuplicates(KEY))


def fingerprint_documents(docs: DataFrame, key="doc_id", text="text", samples=SAMPLES) -> DataFrame:
    """(doc_id, samples): one fingerprint per row."""
    rows = _keyed(docs, key, text)
    counted = rows.groupBy(*KEY, "doc_id").agg(F.count("*").alias("copies"))
    # Copies are dropped in the map tasks before texts move.
    signed = signatures(weighted_terms(rows.dropDuplicates(KEY), KEY, "text"), KEY, samples)
    return _repeated(signed.join(counted, KEY)).select("doc_id", "samples")


def neighbours(rows: DataFrame) -> DataFrame:
    """(row, id_hash, doc_id, copies, before, before_hash, before_chars): each row and the one before it in descending order of ids, as a ring."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("row")]
    counted = rows.groupBy(*KEY, "doc_id", "n_chars").agg(F.count("*").alias("copies"))
    places = stage(with_position(counted, order), "places")
    total = places.count()
    ring = places.select(
        F.col("row").alias("before"),
        F.col("id_hash").alias("before_hash"),
        F.col("n_chars").alias("before_chars"),
        ((F.col("position") + 1) % max(total, 1)).alias("position"),
    )
    return places.join(ring, "position").select(*KEY, "doc_id", "copies", "before", "before_hash", "before_chars")


def edited_documents(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """(row, id_hash, doc_id, copies, n_chars, next, next_hash, text, edited): every different document with its edited text.

    The last half (rounded down) of the code points gives way to as many from the beginning
    of the next document, or all of that document when it is shorter. A row that holds a
    large share of all rows comes once, others as often as they repeat.
    """
    texts = _keyed(docs, key, text)
    ring = stage(neighbours(texts.select(*KEY, "doc_id", F.char_length("text").cast("long").alias("n_chars"))), "ring")
    half = F.floor(F.col("n_chars") / 2)
    met = _without_hot_rows(texts, ring).drop("doc_id").join(ring, KEY)
    given = met.select(
        F.col("before").alias("row"),
        F.col("before_hash").alias("id_hash"),
        F.col("row").alias("next"),
        F.col("id_hash").alias("next_hash"),
        F.substring("text", F.lit(1), F.floor(F.col("before_chars") / 2).cast("int")).alias("tail"),
    ).dropDuplicates(KEY)
    kept = met.select(*KEY, "doc_id", "copies", "text", F.char_length("text").cast("long").alias("n_chars"))
    both = kept.join(given, KEY)
    head = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    return both.select(*KEY, "doc_id", "copies", "n_chars", "next", "next_hash", "text", F.concat(head, "tail").alias("edited"))


def compared_documents(docs: DataFrame, key="doc_id", text="text", samples=SAMPLES) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, samples, edited_samples, near_edited, near_next.
    """
    # Rows that repeat id and text have met in one partition, sorted by their key: dropping them moves nothing.
    rows = edited_documents(docs, key, text).dropDuplicates(KEY)
    # Both branches name the same columns below the join of texts, so that they read the same shuffled texts.
    keys = [*KEY, "next", "next_hash"]
    facts = rows.select(*keys, "doc_id", "copies", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    versions = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("words")),
        F.struct(F.lit(1).alias("version"), F.col("edited").alias("words")),
    )
    spread = rows.select(*keys, F.inline(versions))
    # Grouped by the key that the rows are partitioned by already: no further shuffle.
    signed = signatures(weighted_terms(spread, [*keys, "version"], "words"), [*keys, "version"], samples)
    signed = stage(signed.select(*KEY, "version", "samples").join(facts, KEY), "signatures")
    own, edited = signed.where("version = 0"), signed.where("version = 1")
    plain = own.join(edited.select(*KEY, F.col("samples").alias("edited_samples")), KEY)
    following = own.select(
        F.col("row").alias("next"),
        F.col("id_hash").alias("next_hash"),
        F.col("doc_id").alias("next_id"),
        F.col("samples").alias("next_samples"),
    )
    return _repeated(plain.join(following, ["next", "next_hash"])).select(
        "doc_id",
        "n_chars",
        "next_id",
        "edited_sha256",
        "samples",
        "edited_samples",
        likeness(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        likeness(F.col("samples"), F.col("next_samples")).alias("near_next"),
    )
