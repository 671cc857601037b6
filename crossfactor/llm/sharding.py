"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard levels. At each inner node every child draws
``-ln(u) / weight`` with ``u`` hashed from the document id and the child's name; the smallest draw
wins, so a child is chosen in proportion to its weight and a child whose weight does not change
keeps its draw. If a weight changes, rows move only into or out of the subtrees on its path.

``grow`` adds a shard as a region of its own: only the new region's draw is new, so rows move into
the new shard and nowhere else (the ``key`` law: the id and the shard count decide).

Slots are counted in blocks of rows, whose number follows the rows: a block is a hash of id, size and text, so one
id, or none, on many rows fills many blocks.

Defined results: null ids draw as the text ``null``; null and empty texts have no bytes; texts of any length count
whole; repeated ids land in one shard, repeated rows in slots next to one another; of equal draws the first child
wins; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossfactor.llm.common import sized, text_or_empty, written

#: Blocks of rows per shard for slot numbers, at least, and rows of a block, about: each block is sorted in one task.
SLOT_BLOCKS, BLOCK_ROWS = 64, 500_000


@dataclass(frozen=True)
class Tree:
    """A node: a leaf has a shard number and a weight, an inner node has children."""

    name: str
    children: tuple[Tree, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0
    weight: float = field(init=False, default=0.0)

    def __post_init__(self) -> None:
        object.__setattr__(self, "weight", sum(c.weight for c in self.children) if self.children else self.own_weight)

    def leaves(self) -> list[Tree]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def balanced(shards: int = 16, racks: int = 4, in_rack: int = 4, in_region: int = 2) -> Tree:
    """``racks`` racks of ``in_rack`` shards, ``in_region`` racks a region; further shards grow the tree."""
    base = min(shards, racks * in_rack)
    if base < racks * in_rack:
        regions: list[Tree] = []
    else:
        made = [Tree(f"g{k // in_region}k{k}", tuple(Tree(f"g{k // in_region}k{k}s{k * in_rack + j}", shard=k * in_rack + j) for j in range(in_rack))) for k in range(racks)]
        regions = [Tree(f"g{i}", tuple(made[i * in_region : (i + 1) * in_region])) for i in range(-(-racks // in_region))]
    tree = Tree("root", tuple(regions))
    for _ in range(len(tree.leaves()) if regions else 0, shards):
        tree = grow(tree)
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    shard = max((x.shard for x in tree.leaves() if x.shard is not None), default=-1) + 1
    name = f"n{shard}"
    return Tree("root", (*tree.children, Tree(name, (Tree(f"{name}k", (Tree(f"{name}ks", shard=shard, own_weight=weight),)),))))


def table(tree: Tree) -> str:
    """SQL: an array with the children of each inner node; ``next`` is a child's place there, or its shard."""
    places: list[Tree] = [tree]
    for node in places:
        places.extend(c for c in node.children if c.children)
    at = {node.name: i + 1 for i, node in enumerate(places)}
    rows = [", ".join(f"struct('{c.name}' as name, {c.weight}D as weight, {i} as i, {at.get(c.name, c.shard)} as next)" for i, c in enumerate(node.children)) for node in places]
    return "array(" + ", ".join(f"array({r})" for r in rows) + ")"


def descend(docs: DataFrame, tree: Tree, key: str, out: str) -> DataFrame:
    """``docs`` with the shard of each row in ``out``: at each level the smallest draw wins.

    52 bits of an MD5 of key and child name make ``u`` in (0, 1].
    """
    nodes = table(tree)
    place = "1"
    for level in range(3):
        drawn = f"-ln((cast(conv(substr(md5(concat({key}, ':', c.name)), 1, 13), 16, 10) as double) + 1) / 4503599627370496D) / c.weight"
        docs = docs.withColumn(f"__{out}_{level}", F.expr(f"array_min(transform({nodes}[{place} - 1], c -> struct({drawn} as d, c.i as i, c.next as next))).next"))
        place = f"__{out}_{level}"
    return docs.withColumn(out, F.col(place).cast("int")).drop(*(f"__{out}_{level}" for level in range(3)))


def block(blocks: int) -> Column:
    return F.expr(f"cast(conv(substr(md5(concat_ws(':', __key, text_crc32, size)), 1, 8), 16, 10) as bigint) % {blocks}")


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    blocks = max(SLOT_BLOCKS, -(-docs.count() // (BLOCK_ROWS * len(tree.leaves()))))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__key"), (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    placed = descend(keyed, tree, "__key", "shard").withColumn("__block", block(blocks))
    counts = placed.groupBy("shard", "__block").count()
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = written(counts.select(F.col("shard").alias("__of"), F.col("__block").alias("__at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")), "shard-blocks")
    placed = descend(placed, grown, "__key", "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    inside = Window.partitionBy("shard", "__block").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("__rank", F.row_number().over(inside))
    out = numbered.join(sized(starts, 24), (F.col("shard") == F.col("__of")) & (F.col("__block") == F.col("__at")))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + F.col("__rank") - 1).alias("slot"), "grown_shard")
