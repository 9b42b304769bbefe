"""Hierarchical weighted hash tree: documents descend region, rack and shard levels by weighted hash draws.

At each level every child draws ``-ln(u) / weight`` with ``u`` from a hash of the key and the child's name; the least
draw wins. A child's draw depends on nothing but the key and its own weight, so a child that gains weight only takes
keys, and only keys that enter a changed subtree can move. Only column expressions are used.

Defined cases: a null key hashes as the empty string; a null text has no bytes (size 1, CRC-32 of nothing, 0); empty
tables give empty results; repeated rows each get a slot of their own; other columns, whatever their names, are left
out by :func:`shard_documents` and kept by :func:`with_shard`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_before

#: Regions, racks in a region, and shards in a rack of the base layout.
BASE = (2, 2, 2)


def layout(shards: int, base: tuple[int, int, int] = BASE) -> list[dict]:
    """The tree of ``shards`` shards: the base layout, then one region for each shard that is added later.

    A new shard never changes the weight of a subtree that is there already, so from the base size on growth by one
    moves rows only into the new shard. Fewer shards than the base fill regions in order.
    """
    regions, racks, leaves = base
    tree: list[dict] = []
    for shard in range(shards):
        region = shard // (racks * leaves)
        if region >= regions:
            region = regions + shard - regions * racks * leaves
            tree.append({"name": f"r{region}", "racks": [{"name": f"r{region}k0", "shards": [(shard, 1.0)]}]})
            continue
        rack = shard // leaves % racks
        if region == len(tree):
            tree.append({"name": f"r{region}", "racks": []})
        if rack == len(tree[region]["racks"]):
            tree[region]["racks"].append({"name": f"r{region}k{rack}", "shards": []})
        tree[region]["racks"][rack]["shards"].append((shard, 1.0))
    return tree


def draw(key: Column, child: str, weight: float) -> Column:
    """The child's weighted draw for the key: exponential with rate ``weight``."""
    digits = F.substring(F.md5(F.concat(F.lit(child + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def _least(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; the first of equal draws."""
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*[F.struct(draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, w, _) in enumerate(children)])
    won = F.array_min(draws)["i"]
    out = F.when(won == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        out = out.when(won == i, value)
    return out


def descend(key: Column, tree: list[dict]) -> Column:
    """The shard of the key; weights of inner nodes are sums over their shards, and shards of weight 0 take nothing."""
    regions = []
    for region in tree:
        racks = []
        for rack in region["racks"]:
            leaves = [(f"s{shard}", w, F.lit(shard)) for shard, w in rack["shards"] if w > 0]
            if leaves:
                racks.append((rack["name"], sum(w for _, w, _ in leaves), _least(key, leaves)))
        if racks:
            regions.append((region["name"], sum(w for _, w, _ in racks), _least(key, racks)))
    if not regions:
        raise ValueError("a tree needs a shard with positive weight")
    return _least(key, regions)


def with_shard(docs: DataFrame, shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """The rows with their shard under the key law."""
    return docs.withColumn(out, descend(F.col(key), layout(shards)).cast("int"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Place every document, number each shard's documents without gaps, and show where one more shard would put them.

    Slots follow the key's hash. Equal rows are counted first and numbered together, so that neither a large shard nor
    a repeated row meets in one task.
    """
    light = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    counted = light.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = with_shard(counted, shards).withColumn("__key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    numbered = running_before(placed, "shard", "__key", "copies", ["doc_id", "size", "text_crc32"], docs.count(), "__first")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("copies") - 1)).alias("slot"),
        descend(F.col("doc_id"), layout(shards + 1)).cast("int").alias("grown_shard"),
    )
