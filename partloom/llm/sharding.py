"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn level by level."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from partloom.llm.common import gapless


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, base: int = 40, regions: int = 4, racks: int = 2) -> list[Leaf]:
    """A tree of n_shards leaves. The first `base` fill regions x racks; each later shard opens a region of its own.

    Opening a subtree raises no existing weight, so that rows move into the new shard only. A shard
    added to an existing rack would raise the weights above it and draw rows to its siblings too.
    """
    per = -(-base // (regions * racks))
    spot = lambda s: (s // (per * racks), s // per % racks) if s < base else (regions + s - base, 0)
    return [Leaf(*spot(s), s) for s in range(n_shards)]


def _uniform(key: Column, node: Column) -> Column:
    """In (0, 1], from 52 bits of MD5, which DuckDB can compute too."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", key, node).cast("binary")), 1, 13), 16, 10)
    return (head.cast("double") + 1) / float(1 << 52)


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key. A change of weights moves keys only between subtrees whose weights change.

    The tree is a constant map from each node to its children; from the root on, the child with the least
    -ln(u) / weight is entered, so that its odds are its share of the weights.
    """
    weight: dict[str, float] = defaultdict(float)
    below: dict[str, set[str]] = defaultdict(set)
    number: dict[str, int] = {}
    for x in leaves:
        path = (str(x.region), f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}")
        number[path[-1]] = x.shard
        for above, node in zip(("", *path), path, strict=False):
            if x.weight > 0:
                below[above].add(node)
                weight[node] += x.weight
    if not below:
        raise ValueError("the tree has no shard with a weight")
    child = lambda n: F.struct(F.lit(n).alias("name"), F.lit(weight[n]).alias("weight"))
    tree = F.create_map(*[x for above, nodes in below.items() for x in (F.lit(above), F.array(*map(child, sorted(nodes))))])
    node = F.lit("")
    for _ in range(3):
        draws = F.transform(F.element_at(tree, node), lambda c: F.struct((-F.ln(_uniform(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name")))
        node = F.array_min(draws)["name"]
    return F.element_at(F.create_map(*[x for n, i in number.items() for x in (F.lit(n), F.lit(i))]), node)


def shard(df: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """df with size, text_crc32, shard, slot and grown_shard (the shard in the tree `grown`).

    Rows with equal keys share a shard; a null key is one key, the empty text. A null text has no
    bytes; a very long one is measured whole. Slots number a shard's rows by (bucket, key, crc, size), where the bucket is drawn from
    key and crc, so that the rows of one key are dealt to many tasks. Ties are rows alike in all three, which get neighbouring slots.
    Columns of df stay, but for those named as the new ones. An empty table gives an empty one.
    """
    k = F.coalesce(df[key].cast("string"), F.lit(""))
    bytes_ = F.coalesce(F.octet_length(df[text]), F.lit(0)).cast("long")
    made = ("size", "text_crc32", "shard", "slot", "grown_shard")
    # The draws stand in columns of their own, so that each is evaluated once a row.
    rows = df.drop(*made).withColumns(
        {
            "size": bytes_ + 16,
            "text_crc32": F.crc32(F.coalesce(df[text], F.lit("")).cast("binary")),
            "shard": place(k, leaves),
            "grown_shard": place(k, grown) if grown else F.lit(None).cast("int"),
        }
    )
    drawn = F.md5(F.concat_ws("|", k, F.col("text_crc32").cast("string"), F.lit("slot")).cast("binary"))
    bucket = (F.conv(F.substring(drawn, 1, 6), 16, 10).cast("long") % buckets).cast("int")
    return gapless(rows, ["shard"], bucket, [F.col(key), F.col("text_crc32"), F.col("size")], "slot")
