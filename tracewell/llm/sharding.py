"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every shard draws log(u) / weight for a row's key, where u in (0, 1) is a hash of the key and the shard.
A rack draws the best of its shards' draws, a region the best of its racks': that is a weighted draw
too, of the weights' sum. A row descends from the root to the region, the rack and the shard of the
largest draw. A subtree's draw depends on nothing but the key and the subtree's own weights, so a change
of weights moves rows only into or out of the shards whose weights change, whatever lies beside them.

``tree_for(n)`` fills racks of SHARDS_PER_RACK and regions of RACKS_PER_REGION one after another. One more
shard, of any n, takes rows only into itself, and the key and n alone decide where a row is.

Edge cases: a null key is a key of its own; a null text has no bytes (size 8, CRC of the empty text);
equal rows get different slots of one shard; an empty table gives an empty result; columns beside the
named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARDS, SEED = 24, 20240501
RACKS_PER_REGION, SHARDS_PER_RACK = 2, 4
ROW_OVERHEAD = 8
#: Parts of a shard that are numbered on their own; fixed, so a shard's numbering never meets in one task.
SLOT_PARTS = 512
#: Copies of a row that are numbered at once.
COPIES = 1 << 16


@dataclass(frozen=True)
class Tree:
    """regions: (region id, weight); racks: by region; leaves: by rack, the leaf's id is its shard."""

    regions: tuple[tuple[int, float], ...]
    racks: tuple[tuple[tuple[int, float], ...], ...]
    leaves: tuple[tuple[tuple[int, float], ...], ...]


def tree_for(n: int, weights: dict[int, float] | None = None) -> Tree:
    """The tree of n shards; a shard weighs 1 unless weights says otherwise, an inner node what its children weigh."""
    weigh = lambda s: float((weights or {}).get(s, 1.0))
    racks = [tuple((s, weigh(s)) for s in range(at, min(at + SHARDS_PER_RACK, n))) for at in range(0, n, SHARDS_PER_RACK)]
    total = lambda kids: sum(w for _, w in kids)
    by_region = [tuple((r, total(racks[r])) for r in range(at, min(at + RACKS_PER_REGION, len(racks)))) for at in range(0, len(racks), RACKS_PER_REGION)]
    return Tree(tuple((i, total(r)) for i, r in enumerate(by_region)), tuple(by_region), tuple(racks))


def _literal(tree: Tree) -> Column:
    """regions of racks of shards."""
    node = lambda c: F.struct(F.lit(c[0]).cast("int").alias("id"), F.lit(c[1]).alias("w"))
    rack = lambda r: F.array(*(node(c) for c in tree.leaves[r]))
    return F.array(*(F.array(*(rack(r) for r, _ in tree.racks[region])) for region, _ in tree.regions))


def _descend(key: Column, tree: Tree, seed: int) -> Column:
    """The shard that the largest draws lead to; a weight of zero or less never wins, the smaller number goes first."""

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), c["id"], key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct(F.when(c["w"] > 0, F.log(u) / c["w"]).otherwise(F.lit(float("-inf"))).alias("draw"), (-c["id"]).alias("first"))

    best = lambda kids, of: F.array_max(F.transform(kids, of))
    return -best(_literal(tree), lambda region: best(region, lambda rack: best(rack, draw)))["first"]


def with_shard(df: DataFrame, key: Column, tree: Tree, to: str, seed: int = SEED) -> DataFrame:
    """df with the shard of each row's key in column ``to``."""
    return df.withColumn(to, _descend(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")), tree, seed))


def with_slots(df: DataFrame, shard: str, key: list[str], to: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard, in the order of a hash of key and key itself; df: key, shard.

    Equal rows are counted before they are numbered, so that copies fill no task. A shard's keys are
    dealt into SLOT_PARTS parts by their hash; each part is numbered by itself after the rows of the
    parts before it, whose counts are the only thing that is gathered.
    """
    rest = [c for c in df.columns if c not in (shard, *key)]
    rows = df.groupBy(shard, *key, *rest).agg(F.count(F.lit(1)).alias("__n")).withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(SLOT_PARTS)).cast("int"))
    ahead = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(shard, "__part").agg(F.sum("__n").alias("__of"))
    offsets = counts.select(shard, "__part", F.coalesce(F.sum("__of").over(ahead), F.lit(0)).alias("__before"))
    inside = W.partitionBy(shard, "__part").orderBy(*key).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("__first", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(offsets, [shard, "__part"]).withColumn("__first", F.col("__first") + F.col("__before"))
    pieces = placed.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))))  # copies are many at most in pieces
    each = pieces.withColumn("__k", F.explode(F.sequence("__at", F.least(F.col("__at") + COPIES, F.col("__n")) - 1)))
    return each.withColumn(to, F.col("__first") + F.col("__k")).select(*df.columns, to)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, grow: bool = True) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and, with one shard more, grown_shard."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = with_shard(rows, F.col("doc_id"), tree_for(shards), "shard", seed)
    wider = with_shard(rows, F.col("doc_id"), tree_for(shards + 1), "grown_shard", seed) if grow else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = with_slots(wider, "shard", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
