"""Merkle manifest of a table, its blocks of digests laid out in van Emde Boas order.

A node is the SHA-256 of its children's digests as hex text; ``FAN`` consecutive nodes have one parent,
the last parent of a level may have fewer. A tree is stored in aligned blocks of ``HEIGHT`` levels: a
block holds up to ``FAN ** HEIGHT`` leaves and all nodes above them. Inside a block the nodes stand in
van Emde Boas order: the upper half of the levels first, then the subtrees below it from left to
right, each laid out the same way. ``Layout`` gives the place of a node from its level and
number alone, to the builder as well as to the reader of siblings. The roots of a tree's blocks are
the leaves of the next tier of blocks, until one is left.

Spark does the rest: leaves get their positions from a range sort and one count per partition, blocks
are groups of bounded size, so a group of rows as large as the table spreads over all tasks, and proofs
come down again tier by tier, each node joined to its own block alone.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fields
from tickloom.session import staged

#: Children of a node.
FAN = 8
#: Levels of nodes above the leaves of a block: 8 ** 4 leaves, 150 KB of digests.
HEIGHT = 4
_WIDTH = 32


class Layout:
    """Places of the nodes of a complete tree of ``levels`` levels in van Emde Boas order."""

    def __init__(self, levels: int, fan: int = FAN):
        self.levels, self.fan = levels, fan
        self.sizes = [(fan**k - 1) // (fan - 1) for k in range(levels + 1)]

    def place(self, depth: int, number: np.ndarray) -> np.ndarray:
        """Places of the nodes with these numbers on level ``depth`` (the root's is 0)."""
        place, levels = np.zeros_like(number), self.levels
        while levels > 1:
            top = levels // 2
            if depth < top:
                levels = top
                continue
            # past the top, and past the subtrees to the left of the one that holds the node
            inside = self.fan ** (depth - top)
            place = place + self.sizes[top] + number // inside * self.sizes[levels - top]
            number, depth, levels = number % inside, depth - top, levels - top
        return place


@functools.cache
def layout(levels: int) -> Layout:
    return Layout(levels)


def levels_above(leaves: int, height: int) -> int:
    """Levels above the leaves of a block of a tree with ``leaves`` leaves: fewer only if it is the only one."""
    level = 0
    while level < height and leaves > 1:
        leaves, level = -(-leaves // FAN), level + 1
    return level


def _digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def build_block(leaves: list[bytes], above: int) -> bytes:
    """The digests of a block in van Emde Boas order; places of nodes that are not there are zero."""
    plan = layout(above + 1)
    out = np.zeros((plan.sizes[above + 1], _WIDTH), np.uint8)
    nodes = leaves
    for depth in range(above, -1, -1):
        out[plan.place(depth, np.arange(len(nodes)))] = np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, _WIDTH)
        if depth:
            nodes = [_digest(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
    return out.tobytes()


def siblings(block: bytes, above: int, number: int, leaves: int) -> list[tuple[list[bytes], list[bytes]]]:
    """Per level from the leaf upwards the digests left and right of its ancestor in the same run."""
    plan, path = layout(above + 1), []
    for depth in range(above, 0, -1):
        first = number // FAN * FAN
        places = plan.place(depth, np.arange(first, min(first + FAN, leaves))).tolist()
        run = [block[p * _WIDTH : (p + 1) * _WIDTH] for p in places]
        path.append((run[: number - first], run[number - first + 1 :]))
        number, leaves = number // FAN, -(-leaves // FAN)
    return path


def fold(leaf: bytes, path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = _digest([*left, leaf, *right])
    return leaf


def pack_path(path: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """A path as bytes: per level the counts on both sides, then the digests."""
    return b"".join(bytes([len(left), len(right)]) + b"".join(left) + b"".join(right) for left, right in path)


def unpack_path(data: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    path, at = [], 0
    while at < len(data):
        counts, at = data[at : at + 2], at + 2
        sides = []
        for n in counts:
            sides.append([data[at + i * _WIDTH : at + (i + 1) * _WIDTH] for i in range(n)])
            at += n * _WIDTH
        path.append((sides[0], sides[1]))
    return path


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``at``, the place of each row in the order of the columns, nulls first, from 0.

    The rows are range-partitioned and written; one count per partition reaches the driver.
    """
    rows = staged(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "merkle-order")
    pid = F.shiftright("_mid", 33)
    sizes = {r["pid"]: r["n"] for r in rows.groupBy(pid.alias("pid")).agg(F.count("*").alias("n")).collect()}
    starts, total = [0], 0
    for i in range(max(sizes, default=0)):
        total += sizes.get(i, 0)
        starts.append(total)
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), (pid + 1).cast("int"))
    return rows.withColumn("at", start + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """``tree, block, total, above, digests`` from ``tree, number, total, digest``; ``total`` are the tree's nodes."""

    def build(key, table):
        table = table.sort_by("number")
        total = table.column("total")[0].as_py()
        above = levels_above(total, height)
        data = build_block(table.column("digest").to_pylist(), above)
        return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "total": [total], "above": [above], "digests": [data]}, schema=_BLOCK)

    block = F.expr(f"number div {FAN**height}").alias("block")
    return nodes.groupBy("tree", block).applyInArrow(build, "tree long, block long, total long, above int, digests binary")


_BLOCK = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("total", pa.int64()), ("above", pa.int32()), ("digests", pa.binary())])


def build_tiers(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """All blocks of the trees of ``leaves`` (``tree, number, total, digest``), tier by tier from the leaves up."""
    tiers, nodes, size = [], leaves, FAN**height
    while True:
        tiers.append(staged(_blocks(nodes, height), "merkle-blocks"))
        nodes = tiers[-1].where(F.col("total") > size).select(
            "tree", F.col("block").alias("number"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), F.substring("digests", 1, _WIDTH).alias("digest")
        )
        if nodes.isEmpty():
            return tiers


def roots(tiers: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """``tree, digest`` of every tree: the root of its only block of some tier."""
    one = [t.where(F.col("total") <= FAN**height).select("tree", F.substring("digests", 1, _WIDTH).alias("digest")) for t in tiers]
    return functools.reduce(DataFrame.unionByName, one)


def _with_blocks(nodes: DataFrame, blocks: DataFrame, emit, schema: str, height: int) -> DataFrame:
    """``emit(nodes of a block, block, its path)`` for every block; ``nodes`` have ``tree, number``."""
    size = FAN**height

    def run(key, left, right):
        if not left.num_rows:
            return emit(left, None, None)
        block = right.slice(0, 1).to_pylist()[0]
        here = min(size, block["total"] - block["block"] * size)

        def path(number: int) -> list:
            return siblings(block["digests"], block["above"], number % size, here)

        return emit(left, path, block["path"])

    keyed = nodes.withColumn("block", F.expr(f"number div {size}"))
    return keyed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, schema)


def with_paths(tiers: list[DataFrame], top: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest blocks with ``path``, the packed siblings of their root up to the end of the path ``top``.

    ``top`` gives ``tree, path`` for the root of every tree.
    """

    def emit(nodes, path, above):
        found = [pack_path(path(n)) + above for n in nodes.column("number").to_pylist()] if path else []
        return pa.table([nodes.column("tree"), nodes.column("number"), pa.array(found, pa.binary())], schema=_PATH)

    size, known = FAN**height, None
    for blocks in reversed(tiers):
        # a tree's only block has the path of the tree, the others that of their place in the tier above
        found = blocks.where(F.col("total") <= size).join(top, "tree")
        if known is not None:
            nodes = blocks.where(F.col("total") > size).select("tree", F.col("block").alias("number"))
            below = _with_blocks(nodes, known, emit, "tree long, number long, path binary", height).withColumnRenamed("number", "block")
            found = found.unionByName(blocks.join(below, ["tree", "block"]))
        known = staged(found, "merkle-paths")
    return known


_PATH = pa.schema([("tree", pa.int64()), ("number", pa.int64()), ("path", pa.binary())])


def prove(leaves: DataFrame, blocks: DataFrame, schema: str, emit, height: int = HEIGHT) -> DataFrame:
    """``emit(rows, paths)`` for the rows of each block of ``leaves`` (``tree, number`` and more), ``paths`` one list per row.

    ``blocks`` are the lowest blocks as ``with_paths`` gives them.
    """

    def run(rows, path, above):
        if path is None:
            return emit(rows, [])
        over = unpack_path(above)
        return emit(rows, (path(n) + over for n in rows.column("number").to_pylist()))

    return _with_blocks(leaves, blocks, run, schema, height)


def _stated(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256, as bytes, of the values: each ``-`` if null, else its UTF-8 length, a colon and itself."""
    return F.unhex(F.sha2(F.concat(*[_stated(v) for v in values]), 256))


def manifest(leaves: DataFrame, group: str, *order: str, height: int = HEIGHT) -> tuple[DataFrame, DataFrame, list[DataFrame], list[DataFrame]]:
    """Trees over the rows of each ``group`` in the given order, and one tree over their roots.

    ``leaves`` has ``digest`` besides; rows that agree in all columns of the order are ordered by their digest. Returns
    the rows with ``tree, number, total``; ``group, tree, number, total, digest`` of the roots; the tiers of blocks of
    the groups; and those of the tree over them. Groups stand in order with null first.
    """
    placed = numbered(leaves, group, *order, "digest")
    groups = staged(placed.groupBy(group).agg(F.min("at").alias("tree"), F.count("*").alias("total")), "merkle-groups")
    same = placed[group].eqNullSafe(groups[group])
    rows = staged(placed.join(groups, same).drop(groups[group]).withColumn("number", F.col("at") - F.col("tree")).drop("at"), "merkle-leaves")
    tiers = build_tiers(rows.select("tree", "number", "total", "digest"), height)
    tops = numbered(groups.drop("total").join(roots(tiers, height), "tree"), "tree").withColumnRenamed("at", "number")
    tops = staged(tops.withColumn("total", F.lit(groups.count()).cast("long")), "merkle-roots")
    over = build_tiers(tops.select(F.lit(0).cast("long").alias("tree"), "number", "total", "digest"), height)
    return rows, tops, tiers, over


def manifest_digest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Documents are the leaves of one tree per language, in the order of doc_id (null first, equal ones by their leaf).
    Where 3 divides the CRC-32 of doc_id, the leaf that is folded up is that of the text in lower case (A to Z); a null
    doc_id changes nothing. Nulls in any column are leaves like others, texts are hashed whole, repeated rows are a leaf
    each, an empty table gives an empty result, further columns are not read.
    """
    rows = fields(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest(*named, lower))
    # written before the sort, which samples its input: texts are hashed once
    leaves = staged(rows.select("doc_id", "lang", leaf_digest(*named, F.col("text")).alias("digest"), changed.alias("changed")), "merkle-hashed")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    placed, tops, tiers, over = manifest(leaves, "lang", "doc_id", height=height)
    root = roots(over, height).first()["digest"]

    over = with_paths(over, docs.sparkSession.createDataFrame([(0, b"")], "tree long, path binary"), height)

    def top_paths(nodes, paths):
        return pa.table({"tree": nodes.column("own"), "path": pa.array([pack_path(p) for p in paths], pa.binary()), "subroot": nodes.column("digest")})

    top = prove(tops.select(F.lit(0).cast("long").alias("tree"), "number", F.col("tree").alias("own"), "digest"), over, "tree long, path binary, subroot binary", top_paths, height)
    top = staged(top, "merkle-tops")
    blocks = with_paths(tiers, top.select("tree", "path"), height)

    def proofs(nodes, paths):
        leaf, changed, sub = (nodes.column(c).to_pylist() for c in ("digest", "changed", "subroot"))
        told, folded = [], []
        for i, path in enumerate(paths):
            told.append(_digest([d for left, right in path for d in left + right]).hex())
            folded.append(fold(changed[i] or leaf[i], path))
        return pa.table(
            {
                "doc_id": nodes.column("doc_id"),
                "leaf": pa.array([x.hex() for x in leaf], pa.string()),
                "subroot": pa.array([x.hex() for x in sub], pa.string()),
                "root": pa.array([root.hex()] * len(leaf), pa.string()),
                "proof_sha256": pa.array(told, pa.string()),
                "folded_root": pa.array([x.hex() for x in folded], pa.string()),
                "verified": pa.array([x == root for x in folded], pa.bool_()),
            }
        )

    return prove(placed.join(top.select("tree", "subroot"), "tree"), blocks, schema, proofs, height)
