"""Embedding near-duplicates by randomly rotated binary codes with correction factors.

A unit vector x, rotated at random, is stored as the signs b of its coordinates and the factor
f = <b / sqrt(D), x>. For a rotated unit vector y, <b / sqrt(D), y> / f is an unbiased estimate of
<x, y>, with an error of about sqrt(1 - f^2) / f / sqrt(D - 1) standard deviations. y itself is stored in
4 bits a coordinate, rounded up or down at random so that the estimate stays unbiased. Pairs whose
upper bound is below the threshold are dropped; the others are recomputed exactly from the vectors.

Pairs meet in buckets of equal label and equal code bits, in several tables. A label has so many bits that a
bucket holds about BUCKET vectors on average however many there are, and so many tables that a pair at the threshold
shares no bucket with probability MISS, closer ones more rarely. A pair is decided in the first table
that it shares, once and for all, so that counts and components tell of the same links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from partloom.llm.common import cut, join_spread, runs, small
from partloom.llm.components import components

LEAST = 0.93
#: Vectors of a bucket on average, the odds that a pair at the threshold shares none, and the most bits of a table.
BUCKET, MISS, MOST_BITS = 128, 0.0002, 32
#: Standard deviations of an estimate's error within which a pair is recomputed.
BOUND = 4.0
#: Larger buckets are compared block by block, each pair of blocks in a task of its own.
BLOCK = 2048
SMALL = 32
SEED = 9


def layout(n: Column, least: float = LEAST) -> tuple[Column, Column]:
    """(bits, tables) for n vectors that are compared with each other; up to about BUCKET meet all in one bucket."""
    bits = F.greatest(F.lit(0), F.least(F.lit(MOST_BITS), F.round(F.log2(n / BUCKET)).cast("int")))
    share = F.pow(F.lit(1 - math.acos(min(1.0, max(-1.0, least))) / math.pi), bits)
    return bits, F.when(share < 1, F.ceil(math.log(MISS) / F.log1p(-share))).otherwise(1).cast("int")


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of x at length 1. Where squares would leave the range of doubles, a row is scaled by its largest component first."""
    most = np.abs(x).max(axis=1, keepdims=True)
    far = (most > 1e100) | (most < 1e-100)
    x = np.where(far, x / most, x) if far.any() else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@cache
def _rotation(dim: int, n: int) -> np.ndarray:
    """The nth random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, n]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _code_bytes(dim: int, bits: int) -> int:
    """Bytes of whole rotations' signs, at least `bits` and one rotation."""
    return -(-max(1, -(-bits // dim)) * dim // 8)


def encode(x: np.ndarray, seed: int, bits: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of unit vectors: packed signs of at least `bits` turned coordinates, factors, 4-bit coordinates, and their (low, step)."""
    dim = x.shape[1]
    turned = [x @ _rotation(dim, n) for n in range(max(1, -(-bits // dim)))]
    y = turned[0]
    signs = np.concatenate(turned, axis=1) > 0
    factor = np.maximum(np.abs(y).sum(axis=1) / np.sqrt(dim), 1e-6)
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / 15, 1e-12)
    up = np.random.default_rng([SEED, seed]).random(y.shape)
    q = np.clip(np.floor((y - low[:, None]) / step[:, None] + up), 0, 15).astype(np.uint8)
    return np.packbits(signs, axis=1), factor.astype(np.float32), q, np.stack([low, step], axis=1).astype(np.float32)


def _keys(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each table, from the first bits of the codes."""
    signs = np.unpackbits(code, axis=1, count=tables * bits).reshape(len(code), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    key = np.uint64(0xCBF29CE484222325)
    for x in parts:
        key = (key ^ np.asarray(x).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(31))
    return key.view(np.int64)


def _buckets(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each vector and table."""
    for frame in small(frames):
        for (dim, bits, tables), rows in frame.groupby(["dim", "bits", "tables"], sort=False):
            x = unit(np.array(rows["embedding"].tolist(), np.float64))
            code, factor, q, scale = encode(x, int(rows["h1"].iat[0]) & 0x7FFFFFFF, int(bits * tables))
            packed = (q[:, : dim // 2 * 2 : 2] << 4 | q[:, 1::2]) if dim > 1 else q
            if dim % 2 and dim > 1:
                packed = np.concatenate([packed, q[:, -1:]], axis=1)
            figures = np.concatenate([code, factor[:, None].view(np.uint8), scale.view(np.uint8), packed], axis=1)
            body = [row.tobytes() for row in figures]
            key = _keys(code, int(bits), int(tables))
            label = rows["label_hash"].to_numpy()
            for t in range(int(tables)):
                made = {"g": _mix(label, int(dim), t, key[:, t]), "t": np.int32(t), "dim": np.int32(dim), "bits": np.int32(bits), "tables": np.int32(tables)}
                yield pd.DataFrame({**made, "rep": rows["rep"].to_numpy(), "h1": rows["h1"].to_numpy(), "body": body})


class _Codes:
    """The columns of packed bodies of one dimension and layout."""

    def __init__(self, bodies: list[bytes], dim: int, bits: int) -> None:
        raw = np.frombuffer(b"".join(bodies), np.uint8).reshape(len(bodies), -1)
        n = _code_bytes(dim, bits)
        self.code = raw[:, :n]
        figures = np.ascontiguousarray(raw[:, n : n + 12]).view("<f4").astype(np.float32)
        self.factor, low, step = figures.T
        p = raw[:, n + 12 :]
        q = np.empty((len(raw), dim), np.float32)
        if dim > 1:
            half = dim // 2
            q[:, : 2 * half : 2], q[:, 1::2] = p[:, :half] >> 4, p[:, :half] & 15
            if dim % 2:
                q[:, -1] = p[:, -1]
        else:
            q[:] = p
        self.y = q * step[:, None] + low[:, None]
        self.b = (np.unpackbits(self.code, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
        # The rounding of y errs by half a step a coordinate at most in standard deviations, at random.
        spread = np.sqrt(np.maximum(0, 1 - self.factor**2) / max(1, dim - 1))
        self.slack = BOUND * spread / self.factor
        self.rough = BOUND * step / 2

    def hopeful(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Pairs i, j whose upper bound reaches `least` from either side."""
        one = np.einsum("nd,nd->n", self.b[i], self.y[j]) / self.factor[i] + self.slack[i] + self.rough[j] / self.factor[i]
        two = np.einsum("nd,nd->n", self.b[j], self.y[i]) / self.factor[j] + self.slack[j] + self.rough[i] / self.factor[j]
        return np.minimum(one, two) >= least

    def table(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """hopeful() for all pairs of i and j."""
        one = (self.b[i] @ self.y[j].T + self.rough[j]) / self.factor[i][:, None] + self.slack[i][:, None]
        two = ((self.b[j] @ self.y[i].T + self.rough[i]) / self.factor[j][:, None]).T + self.slack[j]
        return np.minimum(one, two) >= least


def _groups(frame: pd.DataFrame) -> Iterator[tuple[int, int]]:
    g = frame["g"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return zip(first, np.append(first[1:], len(g)), strict=True)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members to compare: all with all (side 2), or those of side 0 with those of side 1."""
    if (side == 2).all():
        every = np.arange(len(side))
        return every, every
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _survivors(least: float) -> object:
    """Members of a bucket that have a hopeful partner in it."""

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in runs(frames, "g"):
            for (dim, bits), frame in whole.groupby(["dim", "bits"], sort=False):
                tables = int(frame["tables"].iat[0])
                c = _Codes(frame["body"].tolist(), int(dim), int(bits) * tables)
                g, side = frame["g"].to_numpy(), frame["side"].to_numpy()
                keep = np.zeros(len(frame), bool)
                spans = list(_groups(frame))
                size = np.concatenate([np.full(b - a, b - a) for a, b in spans])
                for d in range(1, min(SMALL, int(size.max()))):
                    i = np.flatnonzero((g[d:] == g[:-d]) & (size[d:] <= SMALL) & ((side[d:] == 2) | (side[d:] != side[:-d])))
                    i = i[c.hopeful(i, i + d, least)]
                    keep[i] = keep[i + d] = True
                for a, b in spans:
                    if b - a > SMALL:
                        i, j = _sides(side[a:b])
                        hit = c.table(a + i, a + j, least)
                        if len(i) and len(j) and i[0] == j[0]:
                            np.fill_diagonal(hit, False)
                        keep[a + i] |= hit.any(axis=1)
                        keep[a + j] |= hit.any(axis=0)
                if keep.any():
                    yield frame.loc[keep, ["g", "t", "dim", "bits", "tables", "rep", "h1", "side"]].assign(code=[row.tobytes() for row in c.code[keep]])

    return work


def _first_shared(key: np.ndarray, t: int, i: np.ndarray, j: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Which pairs i, j have different keys in all tables before t."""
    out = np.ones(len(i), bool)
    for k in range(0, len(i) if t else 0, step):
        s = slice(k, k + step)
        out[s] = ~(key[i[s], :t] == key[j[s], :t]).any(axis=1)
    return out


def _exact(least: float) -> object:
    """(rep, h1, other, n): links counted for rep (other null), and links that span what is connected (n null).

    A link is told only in the first table that its ends share; the bound was applied to it there.
    """

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in runs(frames, "g"):
            out = []
            for (dim, bits), frame in whole.groupby(["dim", "bits"], sort=False):
                x = unit(np.array(frame["embedding"].tolist(), np.float64))
                key = _keys(np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), -1), int(bits), int(frame["tables"].iat[0]))
                rep, copies, side, table = (frame[k].to_numpy() for k in ("rep", "copies", "side", "t"))
                own = frame["h1"].to_numpy()
                for a, b in _groups(frame):
                    if b - a < 2:
                        continue
                    s = slice(a, b)
                    i, j = _sides(side[s])
                    if not len(i) or not len(j):
                        continue
                    near = x[s][i] @ x[s][j].T >= least
                    if i[0] == j[0]:
                        near = np.triu(near, 1)
                    p, q = np.nonzero(near)
                    p, q = i[p], j[q]
                    first = _first_shared(key[s], int(table[a]), p, q)
                    p, q = p[first], q[first]
                    if not len(p):
                        continue
                    n = np.bincount(p, copies[s][q], b - a) + np.bincount(q, copies[s][p], b - a)
                    some = np.flatnonzero(n)
                    out.append(pd.DataFrame({"rep": rep[s][some], "h1": own[s][some], "n": n[some].astype(np.int64)}))
                    linked = np.zeros((b - a, b - a), bool)
                    linked[p, q] = linked[q, p] = True
                    left = np.ones(b - a, bool)
                    for root in range(b - a):
                        open_ = [root] if left[root] else []
                        left[root] = False
                        while open_:
                            r = open_.pop()
                            found = np.flatnonzero(linked[r] & left)
                            left[found] = False
                            open_ += found.tolist()
                            if len(found):
                                out.append(pd.DataFrame({"rep": np.repeat(rep[s][r], len(found)), "h1": own[s][r], "other": rep[s][found]}))
            if out:
                got = pd.concat(out, ignore_index=True).reindex(columns=["rep", "h1", "other", "n"])
                yield got.astype({"other": "Int64", "n": "Int64"})

    return work


def usable(embedding: Column) -> Column:
    """Not null or empty, all components finite, and not all zero."""
    wrong = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~wrong & F.exists(embedding, lambda v: v != 0), F.lit(False))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of df; vec_id is an integer.

    Vectors are compared within a label and dimension. A null label or vec_id, and vectors that
    are null, empty, zero, or hold null or non-finite components, link with nothing; a null vec_id has no
    component and is not kept. Exact copies are compared as one vector and counted each; rows that
    repeat a vec_id with its vector count once. Different vectors of one vec_id are compared each, but are one node of a component. Ties and very long vectors are nothing special. Other columns of df are not
    carried. An empty table gives an empty one.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = rows.withColumns({"fine": fine, "h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit("second"), "label", "embedding")})
    given = cut(
        rows.where("fine").groupBy("h1", "h2").agg(
            F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.count(F.lit(1)).alias("n_rows"),
            F.first(F.xxhash64("label")).alias("label_hash"), F.first(F.size("embedding")).alias("dim"),
        )
    )
    bits, tables = layout(F.col("n"), least)
    groups = given.groupBy("label_hash", "dim").agg(F.count(F.lit(1)).alias("n")).withColumns({"bits": bits, "tables": tables})
    # Equal vectors have one representative, so that each embedding is taken once.
    chosen = given.select("h1", "h2", F.col("rep").alias("vec_id"), "copies", "label_hash", "dim")
    # Rows alike combine before they move, so that no vector's copies meet in one task.
    one = rows.where("fine").select("h1", "h2", "vec_id", "embedding").dropDuplicates(["h1", "h2", "vec_id"]).join(chosen, ["h1", "h2", "vec_id"])
    vectors = cut(
        join_spread(one, groups, ["label_hash", "dim"], "n", ["vec_id"])
        .select(F.col("vec_id").alias("rep"), "h1", "label_hash", "dim", "bits", "tables", "copies", "embedding")
    )
    shape = "g long, t int, dim int, bits int, tables int, rep long, h1 long, body binary"
    spread = cut(vectors.drop("copies").mapInPandas(_buckets, shape))
    sizes = cut(spread.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.count(F.lit(1)).alias("n_rows")).where(F.col("size") > BLOCK))
    if sizes.isEmpty():  # then rows move once only, to their buckets
        tiles = spread.withColumn("side", F.lit(2))
    else:
        met = join_spread(spread, sizes, ["g"], "n_rows", ["rep"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK).cast("int"), F.lit(1)))
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        tiles = met.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            F.when(F.col("blocks") == 1, F.col("g")).otherwise(F.xxhash64("g", F.least("own", "with"), F.greatest("own", "with"))).alias("g"),
            "t", "dim", "bits", "tables", "rep", "h1", "body",
            F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1).alias("side"),
        )
    shape = "g long, t int, dim int, bits int, tables int, rep long, h1 long, side int, code binary"
    near = cut(tiles.repartition("g").sortWithinPartitions("g").mapInPandas(_survivors(least), shape))
    exact = (
        near.join(vectors.select("rep", "h1", "copies", "embedding"), ["rep", "h1"]).repartition("g").sortWithinPartitions("g")
        .mapInPandas(_exact(least), "rep long, h1 long, other long, n long")
    )
    found = cut(exact)
    counts = found.where("n IS NOT NULL").groupBy("rep", "h1").agg(F.sum("n").alias("n"))
    joined = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = given.join(counts, ["rep", "h1"], "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "n_rows", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = join_spread(rows.where("fine").select("vec_id", "h1", "h2"), known, ["h1", "h2"], "n_rows", ["vec_id"])
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
