"""Hierarchical weighted hash tree for placing documents, in DataFrame functions only.

A document descends region, rack and shard. At each level every child draws
``ln(u) / weight`` with ``u`` in (0, 1) from a hash of the document's id and the child's
name; the highest draw wins, so children win in proportion to their weights, and a child
whose weight grows only takes documents while its siblings' draws stay as they are. Changes
of weight thus move documents within the subtrees whose weights change. A shard that is added
stands in a region of its own: whoever wins against it stays where it was.

The law is ``key``: id and shard count alone decide. A null id is a key like any other, null
and empty texts have 16 bytes, equal rows get neighbouring slots, and an empty table gives an
empty table. Slots are dealt within (shard, block of the input) and blocks are added up per
shard, so neither a hot shard nor a hot id is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed

HASH_BITS = 52
BASE = 20


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def grown(tree: list[Shard]) -> list[Shard]:
    """``tree`` with one more shard, in a region and rack of its own."""
    n = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(n, f"+{n}", f"+{n}/r0")]


def layout(shards: int, per_rack: int = 5, racks: int = 2) -> list[Shard]:
    """``shards`` equal shards, numbered from 0: the first ``BASE`` fill racks and regions in
    turn, the others are grown one by one. So from ``BASE`` on there is one tree for each number
    of shards, and that of one more is the same tree, grown."""
    per_region = per_rack * racks
    tree = [Shard(i, f"g{i // per_region}", f"g{i // per_region}/r{i % per_region // per_rack}") for i in range(min(shards, BASE))]
    while len(tree) < shards:
        tree = grown(tree)
    return tree


def _draw(key: Column, name: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", key, name).cast("binary")), 1, HASH_BITS // 4)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**HASH_BITS)
    return F.log(u) / weight


def _best(key: Column, children: Column) -> Column:
    """Name of the child with the highest draw."""
    return F.array_max(F.transform(children, lambda c: F.struct(_draw(key, c["name"], c["weight"]), c["name"])))["name"]


def _children(nodes: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(nodes.items())])


def _below(parents: dict[str, dict[str, float]]) -> Column:
    return F.create_map(*[x for p, nodes in sorted(parents.items()) for x in (F.lit(p), _children(nodes))])


def place(docs: DataFrame, tree: list[Shard], key: str, to: str) -> DataFrame:
    """Adds the column ``to``: the shard of each row by the tree."""
    if not tree or any(s.weight <= 0 for s in tree):
        raise ValueError("a tree needs shards of positive weight")
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    leaves: dict[str, dict[str, float]] = {}
    for s in tree:
        regions[s.region] = regions.get(s.region, 0) + s.weight
        racks.setdefault(s.region, {})[s.rack] = racks.get(s.region, {}).get(s.rack, 0) + s.weight
        leaves.setdefault(s.rack, {})[f"s{s.number}"] = s.weight
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    a, b = f"{to}_region_", f"{to}_rack_"
    df = docs.withColumn(a, _best(k, _children(regions)))
    df = df.withColumn(b, _best(k, F.element_at(_below(racks), F.col(a))))
    df = df.withColumn(to, F.substring(_best(k, F.element_at(_below(leaves), F.col(b))), 2, 9).cast("int"))
    return df.drop(a, b)


def shard_documents(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """Digest of ``docs`` (doc_id, text): size, checksum, shard, slot, and the shard it would
    have with one more. Slots follow the input's order."""
    body = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    base = place(place(base, tree, "doc_id", "shard"), grown(tree), "doc_id", "grown_shard")
    # The input is read once, and places stay the same whoever asks for them.
    base = checkpointed(base.withColumn("block", F.shiftright("place", 33)))
    counts = base.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("place")
    numbered = base.withColumn("i", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("i")).cast("long").alias("slot"), "grown_shard"
    )
