"""Exact top-k search by inner product over buckets of vectors of like length.

By Cauchy-Schwarz a row of length l scores no more than |q| l, so that buckets whose longest row is too short for
what a query has found already are not visited at all. Within a bucket the local cosine threshold t = theta / (|q| l)
says how alike a row must be to count. Where t is low, rows are cut off by their length (below theta / |q|) and the rest is
multiplied; where it is high, each of the query's largest coordinates confines the same coordinate of a row to a range,
and only rows within all ranges are multiplied. Scores are whole numbers and exact.

A first round scores every query against the longest rows of all (about SEEDS of them), which gives the threshold theta; the second
visits the other buckets, in blocks, and raises theta as it goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.llm.common import cut, join_spread
from partloom.llm.vectors import SLACK, first_of, of_tiles, products, ranked, tiles, unpack, whole

TOP = 5
#: The longest row of a bucket is at most so many times as long as the shortest.
RATIO = 1.05
#: Queries and rows of a tile, and rows that are pruned by one local threshold.
QUERIES, BLOCK, BUCKET = 2048, 8192, 1024
#: About so many of the longest rows make the first threshold.
SEEDS = 4096
#: Local threshold from which coordinates prune, and the coordinates of a query that do.
STEEP, FOCUS = 0.7, 6
_NONE = np.iinfo(np.int64).min


def length_bucket(norm: Column) -> Column:
    return F.when(norm <= 0, -(1 << 20)).when(norm == float("inf"), 1 << 20).otherwise(F.floor(F.log(norm) / np.log(RATIO))).cast("int")


class Bucket:
    """Rows of like length, from the longest, of which coordinates are sorted when first asked for."""

    def __init__(self, x: np.ndarray, norm: np.ndarray) -> None:
        self.x, self.norm = x, norm
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            v = self.x[:, f] / np.where(self.norm > 0, self.norm, 1)
            order = np.argsort(v, kind="stable")
            self.lists[f] = order, v[order]
        return self.lists[f]

    def within(self, q: np.ndarray, t: float, focus: int = FOCUS) -> np.ndarray:
        """Places of rows that every focus coordinate of the unit vector q allows a cosine of t or more, for 0 < t <= 1."""
        of = np.argsort(-np.abs(q), kind="stable")[:focus]
        met = np.zeros(len(self.x), np.int8)
        for f in of:
            a = float(np.clip(q[f], -1, 1))
            spread = np.sqrt(max(0.0, (1 - a * a) * (1 - t * t)))
            # The cap around q holds the pole of the coordinate itself where q is that near to it.
            low = -1.0 if -a >= t else a * t - spread
            high = 1.0 if a >= t else a * t + spread
            order, v = self._list(int(f))
            met[order[np.searchsorted(v, low - 1e-6) : np.searchsorted(v, high + 1e-6, "right")]] += 1
        return np.flatnonzero(met == len(of))


def best(q: pd.DataFrame, c: pd.DataFrame, k: int, steep: float = STEEP, bucket: int = BUCKET) -> pd.DataFrame:
    """The k best rows of c, sorted from the longest, for each query of q that score `theta`, a whole number as text, or more (empty: any)."""
    dim = int(q["dim"].iat[0])
    a, x = unpack(q["body"], dim), unpack(c["body"], dim)
    qn, cn = q["norm"].to_numpy(np.float64), c["norm"].to_numpy(np.float64)
    qid, cid = q["vec_id"].to_numpy(np.int64), c["vec_id"].to_numpy(np.int64)
    theta = np.array([int(t) if t else _NONE for t in q["theta"]], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)

    def add(i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        own = (ids != qid[i]) & (scores >= theta[i])
        if own.any():
            s, d = np.concatenate((found[i][0], scores[own])), np.concatenate((found[i][1], ids[own]))
            at = first_of(s, d, k)
            found[i] = s[at], d[at]
            if len(at) == k:
                theta[i] = max(theta[i], s[at[-1]])

    for start in range(0, len(c), bucket):
        s = slice(start, start + bucket)
        b, ids = Bucket(x[s], cn[s]), cid[s]
        reach = qn * b.norm[0] * (1 + SLACK)
        floor = np.where(theta == _NONE, -np.inf, theta.astype(np.float64))
        live = ~(reach < floor - np.abs(floor) * SLACK)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where((floor > 0) & (reach > 0) & np.isfinite(reach), floor / reach * (1 - SLACK), 0.0)
        by_length = np.flatnonzero(live & (t < steep))
        if len(by_length):
            # Rows below theta / |q| are too short for the query that reaches furthest down; they are a tail of the bucket.
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.nanmin(np.where((floor > 0) & (qn > 0), floor / qn, 0.0)[by_length])
            n = int(np.searchsorted(-b.norm, -least * (1 - SLACK), "right"))
            scores = products(a[by_length], b.x[:n], qn[by_length], b.norm[:n])
            for i, row in zip(by_length, scores, strict=True):
                add(i, row, ids[:n])
        for i in np.flatnonzero(live & (t >= steep)):
            at = b.within(a[i] / qn[i], min(1.0, float(t[i])))
            if len(at):
                add(i, products(a[i : i + 1], b.x[at], qn[i : i + 1], b.norm[at])[0], ids[at])
    n = [len(s) for s, _ in found]
    return pd.DataFrame({
        "query_id": np.repeat(qid, n), "h": np.repeat(q["h"].to_numpy(np.int64), n),
        "vec_id": np.concatenate([d for _, d in found]), "score": np.concatenate([s for s, _ in found]),
    })


def _work(k: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q, c in of_tiles(frames):
            yield best(q, c, k)

    return work


FOUND = "query_id long, h long, vec_id long, score long"


def top_k(df: DataFrame, asks: Column, k: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which `asks` (over vec_id) holds, the k other rows of the highest inner products.

    Components x are floor(256 x). Ties go to the smaller vec_id, equal vectors included. Rows meet rows of as many components, and never those of their own
    id. Null ids, vectors that are null or empty, and those with components that are null or not finite (256-fold) take no
    part. Rows that repeat id and vector are one; other vectors of an id are rows, and queries, of their own. Scores beyond 64 bits count as
    its ends. Other columns of df, whatever their names, are not carried. An empty table gives an empty one.
    """
    n_of = lambda when: F.count(F.when(when, 1))
    rows = whole(df, vec_id, embedding).drop("label").withColumns({"bucket": length_bucket(F.col("norm")), "query": F.coalesce(asks, F.lit(False))})
    sizes = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    # How much of each bucket belongs to the first round: all of the longest ones, then a share of one.
    above = F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = cut(sizes.withColumn("share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (SEEDS - above) / F.col("n")))))
    asking = rows.where("query").withColumn("h", F.xxhash64("body"))
    per_dim = asking.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    parts = lambda n, per: F.ceil(n / per).cast("int")
    part = lambda of: F.pmod(F.xxhash64("vec_id", F.lit(7)), of).cast("int")
    placed = join_spread(rows, buckets.withColumn("n_rows", F.col("n")), ["dim", "bucket"], "n_rows", ["vec_id"])
    draw = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    placed = cut(placed.withColumns({"seed": draw < F.col("share"), "block": part(parts(F.col("n"), BLOCK))}).select("vec_id", "dim", "body", "norm", "bucket", "block", "seed"))

    queries = cut(join_spread(asking, per_dim.withColumn("n_rows", F.col("n")), ["dim"], "n_rows", ["vec_id"]).withColumn("part", part(parts(F.col("n"), QUERIES))))
    queries = queries.select("vec_id", "h", "dim", "body", "norm", "part")
    name = lambda *of: F.concat_ws("/", *of)
    seeds = placed.where("seed").join(per_dim.withColumn("parts", parts(F.col("n"), QUERIES)).drop("n"), "dim")
    seeds = seeds.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(name("dim", "part").alias("tile"), "vec_id", "dim", "body", "norm")
    first = queries.select(name("dim", "part").alias("tile"), "vec_id", "h", "dim", "body", "norm", F.lit("").alias("theta"))
    one = cut(tiles(first, seeds).mapInPandas(_work(k), FOUND))

    theta = one.groupBy("query_id", "h").agg(F.min("score").alias("theta"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    known = queries.join(theta.select(F.col("query_id").alias("vec_id"), "h", "theta"), ["vec_id", "h"], "left")
    # Queries that need rows of like length are visited together.
    need = F.when((F.col("theta") > 0) & (F.col("norm") > 0), F.col("theta") / F.col("norm") * (1 - SLACK)).otherwise(0.0)
    known = cut(known.drop("part").withColumn("need", need).withColumn("group", length_bucket(F.col("need"))))
    groups = known.groupBy("dim", "group").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("least"))
    known = join_spread(known, groups.select("dim", "group", "n", F.col("n").alias("n_rows")), ["dim", "group"], "n_rows", ["vec_id"])
    known = known.withColumn("part", part(parts(F.col("n"), QUERIES))).drop("n")
    span = lambda n, per: F.explode(F.sequence(F.lit(0), parts(n, per) - 1))
    query_blocks = groups.select("dim", "group", "least", span(F.col("n"), QUERIES).alias("part"))
    row_blocks = buckets.where("share < 1").select("dim", "bucket", "longest", span(F.col("n"), BLOCK).alias("block"))
    # Which blocks a block of queries visits: a table of blocks, not of rows.
    visits = cut(query_blocks.join(row_blocks, "dim").where("longest >= least").select("dim", "group", "part", "least", "bucket", "block"))
    tile = name("dim", "group", "part", "bucket", "block").alias("tile")
    second = known.join(visits.drop("least"), ["dim", "group", "part"]).select(tile, "vec_id", "h", "dim", "body", "norm", F.coalesce(F.col("theta").cast("string"), F.lit("")).alias("theta"))
    rest = placed.where("NOT seed").join(visits, ["dim", "bucket", "block"]).where("norm >= least").select(tile, "vec_id", "dim", "body", "norm")
    two = tiles(second, rest).mapInPandas(_work(k), FOUND)
    return ranked(one.unionByName(two), ["query_id", "h"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
