"""A Merkle manifest of a dataset: an append log of hashes and the proofs read from it.

Every row is a leaf. The leaves of one tree ascend by key; every ``FAN`` consecutive nodes become
one until a single node is left, the tree's subroot. The subroots, in order of their trees' names,
are the leaves of one more tree, whose last node is the root.

* Log. A node is appended as soon as its last child is, so the log is the tree in postorder.
  Aligned builders write it in parallel: one takes the ``FAN ** HEIGHT`` leaves of a block and appends
  their nodes in the order they complete. The roots of a tree's blocks are leaves of the builders
  above, until a tree has one block.
* Addresses. A node's place in the log follows from its level, its index and the number of leaves
  alone (``position``): the leaves up to its last one, plus a subtree size's worth of nodes for every
  run completed by then. So siblings are read by address, never searched or joined one by one.
* Proofs. From the top builders down, each block reads the siblings of its leaves out of its own log
  and adds those of its root. A proof is a list of steps, each with the digests left and right of the
  path's node; folding the steps over a leaf gives the root.

A tree may hold any share of the rows: its leaves are placed by a range-partitioned sort and built in
blocks of bounded size. Rows carry digests and keys, never texts. One count and one digest reach the
driver.

Defined results: null columns count as ``-``; null names sort first, and so do null keys. Rows that
repeat a key are leaves of their own, in the order of their digests. An empty table gives no rows.
"""

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import with_position
from .common import stage

FAN = 3
HEIGHT = 7  # levels that one builder adds: blocks of 2,187 leaves
SPAN = FAN**HEIGHT
STEP = "array<string>"


def field(column: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon, the value; ``-`` for null."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    steps = F.arrays_zip(left.alias("left"), right.alias("right"))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def height_of(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    height, size = 0, 1
    while size < leaves:
        height, size = height + 1, size * FAN
    return height


def position(level: int, index: int, leaves: int, height: int) -> int:
    """Where the log of a tree of so many leaves holds a node; ``height`` levels are built."""
    last = (index + 1) * FAN**level  # leaves up to the node's end
    if last <= leaves:
        return last - 1 + sum((last - 1) // FAN**k for k in range(1, height + 1)) + level
    # The last node of a level may lack leaves: such nodes are closed at the end, from the bottom up.
    closed = sum(leaves % FAN**k != 0 for k in range(1, level))
    return leaves + sum(leaves // FAN**k for k in range(1, height + 1)) + closed


def width(level: int, leaves: int) -> int:
    """Nodes of a level."""
    return -(-leaves // FAN**level)


def append_log(leaves: list[str], height: int) -> list[str]:
    """All nodes over the leaves in the order they complete."""
    log, open_nodes = [], [[] for _ in range(height + 1)]

    def close(level):
        node = hashlib.sha256("".join(open_nodes[level]).encode()).hexdigest()
        open_nodes[level].clear()
        log.append(node)
        open_nodes[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        open_nodes[0].append(leaf)
        level = 0
        while level < height and len(open_nodes[level]) == FAN:
            close(level)
            level += 1
    for level in range(height):
        if open_nodes[level]:
            close(level)
    return log


def steps(log: list[str], leaves: int, height: int) -> tuple[list[list[str]], list[list[str]]]:
    """For every leaf the digests left and right of its path, level by level."""
    left, right = [], []  # by level, then by index
    for level in range(height):
        count = width(level, leaves)
        nodes = [log[position(level, index, leaves, height)] for index in range(count)]
        runs = [nodes[at : at + FAN] for at in range(0, count, FAN)]
        left.append(["".join(run[:k]) for run in runs for k in range(len(run))])
        right.append(["".join(run[k + 1 :]) for run in runs for k in range(len(run))])
    return tuple(
        [[side[level][leaf // FAN**level] for level in range(height)] for leaf in range(leaves)] for side in (left, right)
    )


def block_shape(block: int, leaves: int) -> tuple[int, int]:
    """(leaves, levels) of a block in a tree of so many leaves."""
    return min(SPAN, leaves - block * SPAN), min(HEIGHT, height_of(leaves))


def _pack(nodes: list[str]) -> bytes:
    return bytes.fromhex("".join(nodes))


def _unpack(log: bytes) -> list[str]:
    text = log.hex()
    return [text[at : at + 64] for at in range(0, len(text), 64)]


@dataclass
class Manifest:
    """``builders[k]`` has a row per block of level k: tree, block, n (leaves of the tree), leaves, log, root."""

    builders: list[DataFrame]
    top: list[DataFrame]  # the builders of the tree over the subroots
    subroots: DataFrame  # tree, subroot
    root: str | None
    carried: list[str]


def _build(leaves: DataFrame, carried: list[str]) -> DataFrame:
    """One level of builders over (tree, at, n, digest, carried columns)."""
    entry = F.struct("at", "digest", *carried)
    blocks = leaves.groupBy("tree", F.expr(f"at div {SPAN}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("leaves")
    )

    def run(batches):
        for batch in batches:
            logs, roots = [], []
            for row in range(len(batch)):
                block, count = batch.column("block")[row].as_py(), batch.column("n")[row].as_py()
                digests = batch.column("leaves")[row].values.field("digest").to_pylist()
                log = append_log(digests, block_shape(block, count)[1])
                logs.append(_pack(log))
                roots.append(log[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(logs, pa.binary()), pa.array(roots, pa.string())],
                names=[*batch.schema.names, "log", "root"],
            )

    schema = T.StructType([*blocks.schema.fields, T.StructField("log", T.BinaryType()), T.StructField("root", T.StringType())])
    return stage(blocks.mapInArrow(run, schema), "merkle-log")


def _levels(leaves: DataFrame, carried: list[str], most: int) -> list[DataFrame]:
    """Builders from the leaves up; ``most`` is the number of leaves of the largest tree."""
    out = [_build(leaves, carried)]
    while most > SPAN:
        roots = out[-1].where(F.col("n") > SPAN)
        upper = F.expr(f"cast((n + {SPAN - 1}) div {SPAN} as bigint)")
        out.append(_build(roots.select("tree", F.col("block").alias("at"), upper.alias("n"), F.col("root").alias("digest")), []))
        most = -(-most // SPAN)
    return out


def _finished(levels: list[DataFrame]) -> list[DataFrame]:
    """The builders whose tree has a single block, level by level."""
    return [level.where(F.col("n") <= SPAN) for level in levels]


def build_manifest(docs: DataFrame, tree: str, key: str, digest: Column, carry: dict[str, Column] | None = None) -> Manifest:
    """Hash the rows of ``docs`` into a tree for each value of ``tree``, its leaves ordered by ``key``.

    ``digest`` is a row's leaf; ``carry`` names further small columns that travel with the leaf.
    """
    carried = {"doc_id": F.col(key), **(carry or {})}
    rows = docs.select(
        F.col(tree).alias("name"),
        F.struct(*[c.alias(n) for n, c in carried.items()]).alias("carried"),
        digest.alias("digest"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = stage(rows, "leaves").select("name", F.col("carried.doc_id").alias("key"), "digest", "tie", "carried")
    placed = with_position(rows, ["name", "key", "digest", "tie"])
    # A tree is known by the place of its first leaf, which is unique, ordered like the names and never null.
    trees = stage(placed.groupBy("name").agg(F.min("position").alias("tree"), F.count("*").alias("n")), "trees")
    most = trees.agg(F.max("n")).first()[0] or 0
    own = trees.withColumnRenamed("name", "tree_name")
    leaves = placed.join(own, F.col("name").eqNullSafe(F.col("tree_name"))).select(
        "tree", (F.col("position") - F.col("tree")).alias("at"), "n", "digest", "carried"
    )
    builders = _levels(leaves, ["carried"], most)
    subroots = None
    for level in _finished(builders):
        part = level.select("tree", F.col("root").alias("subroot"))
        subroots = part if subroots is None else subroots.unionByName(part)
    count = trees.count()
    ranked = with_position(subroots, ["tree"]).select(
        F.lit(0).cast("long").alias("tree"),
        F.col("position").alias("at"),
        F.lit(count).cast("long").alias("n"),
        F.col("subroot").alias("digest"),
        F.col("tree").alias("source_tree"),
    )
    top = _levels(ranked, ["source_tree"], count)
    last = top[-1].select("root").first()
    return Manifest(builders, top, subroots, last[0] if last else None, list(carried))


def _proofs(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """(tree, at, digest, carried columns, left, right) for every leaf; ``above`` (tree, block) has the steps of the roots."""
    if above is None:
        none = F.array().cast(STEP)
        joined = blocks.withColumn("up_left", none).withColumn("up_right", none)
    else:
        joined = blocks.join(above, ["tree", "block"])
    entry = blocks.schema["leaves"].dataType.elementType
    names, used = entry.fieldNames(), ["tree", "block", "n", "leaves", "log", "up_left", "up_right"]

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                value = {n: batch.column(n)[row] for n in used}
                count, height = block_shape(value["block"].as_py(), value["n"].as_py())
                left, right = steps(_unpack(value["log"].as_py()), count, height)
                up_left, up_right = value["up_left"].as_py(), value["up_right"].as_py()
                leaves = value["leaves"].values
                columns = [
                    pa.array([value["tree"].as_py()] * count, pa.int64()),
                    *[leaves.field(n) for n in names],
                    pa.array([own + up_left for own in left], pa.list_(pa.string())),
                    pa.array([own + up_right for own in right], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", *names, "left", "right"])

    sides = [T.StructField(n, T.ArrayType(T.StringType())) for n in ("left", "right")]
    schema = T.StructType([T.StructField("tree", T.LongType()), *entry.fields, *sides])
    return joined.select(*used).mapInArrow(run, schema)


def _descend(levels: list[DataFrame], roots: DataFrame | None) -> DataFrame:
    """Proofs of the leaves of ``levels``; ``roots`` (tree, up_left, up_right) has the steps of each tree's own root."""
    above = None
    for level in reversed(levels):
        if roots is not None:  # trees of one block end at this level
            ending = level.where(F.col("n") <= SPAN).select("tree", "block").join(roots, "tree")
            above = ending if above is None else above.unionByName(ending)
        found = _proofs(level, above)
        above = found.select("tree", F.col("at").alias("block"), F.col("left").alias("up_left"), F.col("right").alias("up_right"))
    return found


def proofs(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, left, right, carried columns) for every row of the dataset."""
    over = _descend(manifest.top, None)
    roots = over.select(
        F.col("source_tree").alias("tree"), F.col("left").alias("up_left"), F.col("right").alias("up_right")
    )
    roots = stage(roots, "subroot-proofs")
    found = _descend(manifest.builders, roots).join(manifest.subroots, "tree")
    return found.select(
        *[F.col(f"carried.{c}").alias(c) for c in manifest.carried],
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(manifest.root).alias("root"),
        "left",
        "right",
    )


def log_entries(manifest: Manifest) -> DataFrame:
    """The log of every tree as rows: tree, position, level, index, digest."""
    parts = []
    for k, level in enumerate(manifest.builders):

        def run(batches, base=k * HEIGHT):
            for batch in batches:
                for row in range(len(batch)):
                    tree, block = batch.column("tree")[row].as_py(), batch.column("block")[row].as_py()
                    total, own = batch.column("total")[row].as_py(), batch.column("n")[row].as_py()
                    count, height = block_shape(block, own)
                    log, whole = _unpack(batch.column("log")[row].as_py()), height_of(total)
                    out = []
                    for up in range(min(base, 1), height + 1):  # a builder's leaves are listed by the one below
                        for index in range(width(up, count)):
                            node, at = block * FAN ** (HEIGHT - up) + index, base + up
                            digest = log[position(up, index, count, height)]
                            out.append((tree, position(at, node, total, whole), at, node, digest))
                    names = ["tree", "position", "level", "index", "digest"]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, entry)) for entry in out])

        sizes = manifest.builders[0].groupBy("tree").agg(F.first("n").alias("total"))
        joined = level.select("tree", "block", "n", "log").join(sizes, "tree")
        parts.append(joined.mapInArrow(run, "tree long, position long, level long, index long, digest string"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
