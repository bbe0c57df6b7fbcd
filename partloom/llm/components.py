"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from partloom.llm.common import ROWS_PER_TASK, cut, join_spread

#: Links of a part of what a round writes, and the parts that it has at least.
ROWS_PER_PART, LEAST_PARTS = 50_000, 8


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of links: the smallest node that it reaches, itself included.

    Each step takes a minimum for each node and gives it to the node's links. With so few links that a node cannot have too many for
    one task, that is one exchange; else minima combine before the shuffle, and the links of a node with very many are dealt to several
    tasks. Each round is written to the shared folder, in parts of some size. Links with a null end are left out. It ends when nothing
    changes: every round but the last lowers an end of some link, so that it does end, after about log2 of the links or fewer rounds.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state, total = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        made = (_step if 2 * total <= ROWS_PER_TASK else _spread_step)(both)
        edges = cut(made.where("u <> v").distinct().coalesce(max(LEAST_PARTS, 2 * total // ROWS_PER_PART)))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state, total = now, now[0]
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _step(both: DataFrame) -> DataFrame:
    """Large star, then small star: links from each greater neighbour to the least one, then from all lesser ones."""
    least = F.min("v").over(Window.partitionBy("u"))
    large = both.withColumn("m", F.least(least, F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return large.withColumn("m", least).select(F.explode(ends).alias("e")).select("e.u", "e.v")


def _spread_step(both: DataFrame) -> DataFrame:
    size = F.count(F.lit(1)).alias("n")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), size)
    large = join_spread(both.where("v > u"), least, ["u"], "n", ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"), size)
    small = join_spread(large, down, ["u"], "n", ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(down.select("u", F.col("m").alias("v")))
