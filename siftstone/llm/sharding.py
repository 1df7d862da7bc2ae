"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.common import clean_text, documents, session_of, staged

#: Shards of a rack, and racks of a region, in the tree a shard count stands for.
RACK, REGION = 4, 2
#: Shards of the founding tree; each shard added later is a region of its own.
FOUNDED = 16
#: Blocks in which the rows of a shard are numbered side by side.
BLOCKS = 4096


@dataclass(frozen=True)
class Leaf:
    """A shard and its place in the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, founded: int = FOUNDED) -> list[Leaf]:
    """The tree for a shard count.

    The founding shards fill racks and regions. A shard added later opens a
    region: the one subtree whose weight changes is then its own, so rows move
    into the new shard and nowhere else.
    """
    leaves = [Leaf(s // (RACK * REGION), s // RACK, s) for s in range(min(shards, founded))]
    regions, racks = len({x.region for x in leaves}), len({x.rack for x in leaves})
    return leaves + [Leaf(regions + i, racks + i, founded + i) for i in range(shards - len(leaves))]


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw with the node's weight as rate, from 52 bits of md5(key|node); the least draw wins."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + node))), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def _descend(key: Column, leaves: list[Leaf], levels: tuple[str, ...]) -> Column:
    level, deeper = levels[0], levels[1:]
    groups: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        groups.setdefault(getattr(leaf, level), []).append(leaf)
    below = {at: _descend(key, own, deeper) if deeper else F.lit(at) for at, own in groups.items()}
    if len(groups) == 1:
        return next(iter(below.values()))
    draws = [F.struct(_draw(key, f"{level}{at}", sum(x.weight for x in own)).alias("draw"), F.lit(at).alias("at")) for at, own in groups.items()]
    won = F.array_min(F.array(*draws))["at"]
    if not deeper:
        return won
    (_, first), *rest = below.items()
    out = first
    for at, inside in rest:
        out = F.when(won == at, inside).otherwise(out)
    return out


def shard_of(key: str | Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: at each level the child with the least weighted draw, down to a leaf.

    A child's draw depends on the key, the child and its weight alone, so a
    change of weight moves rows only into or out of the subtrees where weights
    change. A null key is the empty text. Weights must be positive.
    """
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return _descend(text, [x for x in leaves if x.weight > 0], ("region", "rack", "shard")).cast("int")


def slots(assigned: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in a column `slot`.

    Rows fall into blocks by a hash of the whole row; block counts, at most
    shards * blocks rows, give each block its first slot, and rows are numbered
    within blocks. No task holds a whole shard.
    """
    own = assigned.withColumn("block", F.pmod(F.xxhash64(*assigned.columns), F.lit(blocks)).cast("int"))
    counts = own.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "block").orderBy(*(c for c in assigned.columns if c != "shard"))
    numbered = own.withColumn("at", F.row_number().over(within))
    return numbered.join(F.broadcast(first), ["shard", "block"]).withColumn("slot", F.col("first") + F.col("at") - 1).drop("block", "first", "at")


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Place the rows of (doc_id, text) into shards by the law `key`.

    doc_id and the shard count decide; one more shard takes rows only into
    itself (`grown_shard`). Null texts have size 1 and the crc of the empty
    text; a null id is the empty key; repeated rows share a shard and get slots
    of their own; extra columns are ignored; an empty table gives none.
    """
    session_of(docs)
    text = F.encode(clean_text(), "utf-8")
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of("doc_id", tree(shards)).alias("shard"),
        shard_of("doc_id", tree(shards + 1)).alias("grown_shard"),
    )
    return slots(staged(placed, "placed")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op4_hash_tree_sharding(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 for all documents, and their shards when one is added."""
    return assign(documents(spark, sf_dir))
