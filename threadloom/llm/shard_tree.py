"""Sharding by a hierarchical weighted hash tree: descend region, rack and shard, drawing at every level.

A child's draw is -ln(u) / weight, u being a hash of the key and the child; the least draw wins, so each child gets
its weight's share. Changing a weight changes the draws of that child alone: at its level keys only enter or leave
it, and below a node whose children keep their weights nothing moves. A shard added as a region of its own therefore
takes keys and no others move; a shard added to a rack also lets that rack and its region take keys, which spread
over them.

The key and the tree decide alone. Null keys share one shard. The tree is a parameter and rides along as a constant.
Repeated rows go to one shard and get slots of their own; a null text counts as empty; empty tables give empty
tables. Only the columns named are read and the result has fixed columns, so other names cannot clash.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut_lineage


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def regular_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> list[Shard]:
    """Equal shards, filled rack by rack."""
    return [Shard(s, s // (racks_per_region * shards_per_rack), s // shards_per_rack) for s in range(shards)]


def with_region(tree: list[Shard], shard: int, weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, as the only shard of a new region and rack."""
    return [*tree, Shard(shard, max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, weight)]


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key: three draws deep, one hash for each child of the nodes on the way."""
    children: dict[str, dict[str, float]] = {}
    for s in tree:
        for parent, child in (("", f"g{s.region}"), (f"g{s.region}", f"k{s.rack}"), (f"k{s.rack}", f"s{s.shard}")):
            weights = children.setdefault(parent, {})
            weights[child] = weights.get(child, 0.0) + s.weight
    table = {p: [{"node": c, "weight": w} for c, w in cs.items() if w > 0] for p, cs in children.items()}
    nodes = F.from_json(F.lit(json.dumps(table)), "map<string,array<struct<node:string,weight:double>>>")

    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, child["node"]), 11) + F.lit(0.5)) / F.lit(2.0**53)
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["node"].alias("node"))

    node = F.lit("")
    for _ in range(3):
        node = F.array_min(F.transform(F.element_at(nodes, node), draw))["node"]
    return F.substring(node, 2, 10).cast("int")


def assign(
    docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, key: str = "doc_id", text: str = "text",
    rows_per_group: int = 100_000,
) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every row.

    Size: UTF-8 bytes and 16. Slots count from 0 without gaps inside a shard. No task numbers a whole shard: rows are
    numbered inside groups of about ``rows_per_group`` and every group starts where the ones before it end. The small
    rows are checkpointed, so that counting and numbering see the same groups.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    groups = max(1, math.ceil(docs.count() / rows_per_group))
    rows = docs.select(
        F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("__group"),
    )
    rows = cut_lineage(rows)
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "__group").count()
    starts = counts.select("shard", "__group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__group").orderBy(key, "text_crc32", "size")
    numbered = rows.withColumn("__row", F.row_number().over(inside))
    out = numbered.join(starts, ["shard", "__group"])
    return out.select(key, "size", "text_crc32", "shard", (F.col("__start") + F.col("__row") - 1).cast("long").alias("slot"), "grown_shard")
