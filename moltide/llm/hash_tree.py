"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws -ln(u) / weight, u a hash of the row's key and the child's path, and the least draw wins,
so a child's share follows its weight. A draw depends on nothing but the key and the child: where the weights of a subtree
change, rows move only into it or out of it, and where a subtree is added, rows move only into it. Shards beyond those the
tree was laid out for are appended as subtrees of their own, so that one more shard takes rows only into itself.

All of it is DataFrame expressions; every leaf is equally deep. A null key draws as the empty string; equal keys share a shard. Slots number the rows of a shard without
gaps, ties between equal rows in any order. Null texts have size `overhead` and the checksum of no bytes. An empty table
gives no rows; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, number_rows, table

#: Layout of a new tree: racks in a region, shards in a rack.
RACKS, RACK_SHARDS = 4, 5

@dataclass
class Node:
    """Inner node, or leaf if shard is set. weight: of a leaf its own, of an inner node the sum below."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: list[Node] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.children:
            self.weight = sum(c.weight for c in self.children)


def lay_out(shards: int, planned: int) -> Node:
    """Tree of `shards` shards of weight 1; those from `planned` on are regions of one rack and one shard each."""
    per, regions = RACKS * RACK_SHARDS, []
    first = min(shards, planned)
    for r in range(0, first, per):
        racks = [Node(f"k{k // RACK_SHARDS}", children=[Node(f"s{s}", shard=s) for s in range(k, min(k + RACK_SHARDS, r + per, first))]) for k in range(r, min(r + per, first), RACK_SHARDS)]
        regions.append(Node(f"r{r // per}", children=racks))
    regions += [Node(f"new{s}", children=[Node("k", children=[Node(f"s{s}", shard=s)])]) for s in range(first, shards)]
    return Node("", children=regions)


def uniform(key: Column, path: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of key and path."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), path)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def inner_nodes(node: Node, path: str = "") -> list[tuple[str, Node]]:
    """Path and node of every node with children."""
    found = [(path, node)] if node.children else []
    return found + [x for c in node.children for x in inner_nodes(c, f"{path}/{c.name}")]


def leaves(node: Node, path: str = "") -> list[tuple[str, int]]:
    return [(path, node.shard)] if node.shard is not None else [x for c in node.children for x in leaves(c, f"{path}/{c.name}")]


def descend(df: DataFrame, key: Column, tree: Node, to: str) -> DataFrame:
    """df with the column `to`: the shard (int) to which the key's descent through the tree, a level at a time, leads."""
    nodes = inner_nodes(tree)
    children = F.create_map(*[x for path, node in nodes for x in (F.lit(path), F.array(*[F.struct(F.lit(f"{path}/{c.name}").alias("path"), F.lit(float(c.weight)).alias("weight")) for c in node.children if c.weight > 0]))])
    depth = max(path.count("/") for path, _ in nodes) + 1
    at = F.lit("")
    for level in range(depth):
        draws = F.transform(F.element_at(children, at), lambda c: F.struct((-F.ln(uniform(key, c["path"])) / c["weight"]).alias("d"), c["path"].alias("path")))
        df = df.withColumn(f"__{to}{level}", F.array_min(draws)["path"])
        at = F.col(f"__{to}{level}")
    shards = F.create_map(*[F.lit(x) for leaf in leaves(tree) for x in leaf])
    return df.withColumn(to, F.element_at(shards, at)).drop(*[f"__{to}{level}" for level in range(depth)])


def assign(df: DataFrame, tree: Node, grown: Node, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (by the tree `grown`) of every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = descend(descend(rows, key, tree, "shard"), key, grown, "grown_shard")
    rows = materialise(rows, "rows")
    return number_rows(rows, "shard", ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), lay_out(40, 40), lay_out(41, 40))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
