"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

The tree's regions hold racks, racks hold shards, and a node weighs what its shards weigh together. A key descends by one
weighted draw a level: each child draws -ln(u) / weight, u hashed from the key and the child, and the least draw wins, first
among the regions, then among the racks of the region won, then among the shards of the rack won. Draws of one node do not
depend on its siblings, so a changed weight moves keys only into or out of the region, and within it the rack, and within
that the shard, whose weights change; all other subtrees keep their keys among themselves. A shard added by `grow` is a
region of its own, so it takes keys from the others and nothing else moves (law `key`).

Defined cases: a null text is empty; rows with a null key are all dealt alike, to one shard; repeated rows get one slot
each; rows of one key are ordered by text checksum and size, ties as they come, as they are alike; very long texts are taken
whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import blank, cut

#: Rows of a shard are numbered in this many hash buckets, so that no task orders a whole shard.
SLOT_BUCKETS = 1024

#: Shards' weights by region and rack; racks have numbers of their own over all regions.
Tree = dict[int, dict[int, dict[int, float]]]


def topology(shards: int = 24, racks: int = 6, regions: int = 2, weights: dict[int, float] | None = None) -> Tree:
    """Shard s stands on rack s % racks, rack r in region r % regions; a weight is 1 unless given."""
    tree: Tree = {}
    for s in range(shards):
        rack = s % racks
        tree.setdefault(rack % regions, {}).setdefault(rack, {})[s] = (weights or {}).get(s, 1.0)
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, which is a region of its own."""
    racks = [k for r in tree.values() for k in r]
    shards = [s for r in tree.values() for k in r.values() for s in k]
    return tree | {max(tree) + 1: {max(racks) + 1: {max(shards) + 1: weight}}}


def _pick(key: Column, level: int, weights: dict[int, float], seed: int) -> Column:
    """The child of least draw; with one child nothing is drawn."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = []
    for node, weight in weights.items():
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(level), F.lit(node)), 11) + 0.5) * 2.0**-53
        draws.append(F.struct((-F.log(u) / weight).alias("draw"), F.lit(node).alias("node")))
    return F.least(*draws)["node"]


def _within(parent: Column, picks: dict[int, Column]) -> Column:
    out = F.lit(None).cast("int")
    for node, pick in picks.items():
        out = F.when(parent == node, pick).otherwise(out)
    return out


def descend(rows: DataFrame, key: Column, tree: Tree, prefix: str = "", seed: int = 6) -> DataFrame:
    """Adds the key's region, rack and shard, named with the prefix."""
    racks = {k: shards for r in tree.values() for k, shards in r.items()}
    region, rack, shard = (prefix + x for x in ("region", "rack", "shard"))
    rows = rows.withColumn(region, _pick(key, 0, {r: sum(w for k in inner.values() for w in k.values()) for r, inner in tree.items()}, seed))
    rows = rows.withColumn(rack, _within(F.col(region), {r: _pick(key, 1, {k: sum(s.values()) for k, s in inner.items()}, seed) for r, inner in tree.items()}))
    return rows.withColumn(shard, _within(F.col(rack), {k: _pick(key, 2, shards, seed) for k, shards in racks.items()}))


def shard_documents(docs: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, size, text_crc32, law ('key'), shard, slot (gapless from 0 in each shard), grown_shard, region, rack."""
    tree = tree or topology()
    text = blank(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = descend(descend(rows, F.col("_id"), tree), F.col("_id"), grow(tree), "grown_")
    bucket = F.pmod(F.xxhash64("_id", "text_crc32", F.lit(97)), F.lit(SLOT_BUCKETS)).cast("int")
    rows = cut(rows.select("_id", "size", "text_crc32", "shard", "grown_shard", "region", "rack", bucket.alias("_bucket")), "shard-rows")
    # counts by shard and bucket: at most shards * SLOT_BUCKETS rows, whatever the input
    counts = rows.groupBy("shard", "_bucket").count()
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_id", "text_crc32", "size"))
    slot = (F.col("_before") + nth - 1).alias("slot")
    rows = rows.join(F.broadcast(counts), ["shard", "_bucket"])
    return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard", "region", "rack")
