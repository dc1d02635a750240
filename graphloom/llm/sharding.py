"""Operator 1: placement by a hierarchical weighted hash tree.

A tree of regions, racks and shards is descended from the top.  At each level
every child draws ln(u) / weight with u hashed from (row key, child's path), and
the largest draw wins, so a child gets rows in proportion to its weight.  A child's
draw depends on nothing but its own path and weight: when weights change, a row
moves only if a child whose weight grew now wins, or one whose weight fell now
loses.  Subtrees whose weights stay the same exchange nothing with each other.

``HashTree.grown`` opens each added shard as a region of its own; then no other
weight changes, and the new shard takes rows only into itself.

Native expressions only; no shuffle for placement itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gapless_index


@dataclass(frozen=True)
class Node:
    """A shard (``shard`` set) or an inner node with children; ``weight`` of an inner node is its children's sum."""

    name: str
    own_weight: float = 0.0
    shard: int | None = None
    children: tuple["Node", ...] = field(default=())

    @property
    def weight(self) -> float:
        return self.own_weight if self.shard is not None else math.fsum(c.weight for c in self.children)


@dataclass(frozen=True)
class HashTree:
    regions: tuple[Node, ...]

    @staticmethod
    def uniform(regions: int = 2, racks: int = 3, shards: int = 4, weight: float = 1.0) -> "HashTree":
        """regions x racks x shards equal shards, numbered in order."""
        number = iter(range(regions * racks * shards))
        return HashTree(
            tuple(
                Node(f"r{r}", children=tuple(Node(f"k{k}", children=tuple(Node(f"s{s}", weight, next(number)) for s in range(shards))) for k in range(racks)))
                for r in range(regions)
            )
        )

    @property
    def n_shards(self) -> int:
        return sum(len(k.children) for r in self.regions for k in r.children)

    def grown(self, extra: int = 1, weight: float = 1.0) -> "HashTree":
        """``extra`` more shards, each in a region of its own, so that rows move only into the new shards."""
        out, n, at = list(self.regions), self.n_shards, len(self.regions)
        for i in range(extra):
            out.append(Node(f"r{at + i}", children=(Node("k0", children=(Node("s0", weight, n + i),)),)))
        return HashTree(tuple(out))

    def with_weight(self, shard: int, weight: float) -> "HashTree":
        """The same tree with another weight for one shard; weights above it follow."""

        def put(node: Node) -> Node:
            if node.shard is not None:
                return Node(node.name, weight if node.shard == shard else node.own_weight, node.shard)
            return Node(node.name, children=tuple(put(c) for c in node.children))

        return HashTree(tuple(put(r) for r in self.regions))


def _draw(key: Column, path: str, weight: float) -> Column:
    """ln(u) / weight with u in (0, 1) from 53 bits of a 64-bit hash."""
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double")
    return F.log((h + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[int, str, float]]) -> Column:
    live = [(i, p, w) for i, p, w in children if w > 0]
    if not live:
        raise ValueError("a subtree without positive weight was drawn")
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.greatest(*[F.struct(_draw(key, p, w).alias("d"), F.lit(i).alias("i")) for i, p, w in live])["i"]


def place(df: DataFrame, tree: HashTree, key: Column, shard: str = "shard", region: str = "region", rack: str = "rack") -> DataFrame:
    """Add region, rack (its number in the region) and shard columns.

    A null key is placed like the empty string; equal keys always share a shard.
    """
    k = F.coalesce(key.cast("string"), F.lit(""))
    out = df.withColumn(region, _winner(k, [(i, r.name, r.weight) for i, r in enumerate(tree.regions)]))
    cases = None
    for i, r in enumerate(tree.regions):
        if r.weight <= 0:
            continue
        pick = _winner(k, [(j, f"{r.name}/{x.name}", x.weight) for j, x in enumerate(r.children)])
        cases = F.when(F.col(region) == i, pick) if cases is None else cases.when(F.col(region) == i, pick)
    out = out.withColumn(rack, cases)
    cases = None
    for i, r in enumerate(tree.regions):
        for j, x in enumerate(r.children):
            if x.weight <= 0:
                continue
            here = (F.col(region) == i) & (F.col(rack) == j)
            pick = _winner(k, [(s.shard, f"{r.name}/{x.name}/{s.name}", s.weight) for s in x.children])
            cases = F.when(here, pick) if cases is None else cases.when(here, pick)
    return out.withColumn(shard, cases.cast("int"))


def shard_documents(docs: DataFrame, tree: HashTree, grown: HashTree | None = None) -> DataFrame:
    """Digest of the placement: doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    * null doc_id: placed like an empty key; null text: size 8, crc32 of no bytes (0);
    * repeated rows and equal doc_ids share a shard and get distinct slots;
    * an empty table gives an empty result; other columns are not read.
    """
    own = docs.select("doc_id", "text")
    narrow = own.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(narrow, tree, F.col("doc_id"))
    if grown is not None:
        placed = place(placed, grown, F.col("doc_id"), "grown_shard", "_r", "_k").drop("_r", "_k")
    else:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    out = gapless_index(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def write_shards(docs: DataFrame, tree: HashTree, path: str, key: str = "doc_id") -> None:
    """Write whole rows under ``path/shard=N``; a third of the rows in one shard still spreads over many files."""
    placed = place(docs, tree, F.col(key), "shard", "_gl_region", "_gl_rack").drop("_gl_region", "_gl_rack")
    placed.write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = HashTree.uniform(2, 3, 4)
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tree, tree.grown(1))
