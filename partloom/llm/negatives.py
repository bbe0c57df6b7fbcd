"""Hard-negative mining by product quantisation with stored residual norms.

Every row is stored as one code for each pair of components, of centroids learned from a sample, and the length r of what the codes leave
out. A query's products with all centroids are one lookup table; the sum s of a row's entries is off its true score by |q| r at most, so that
s - |q| r and s + |q| r bound it rigorously, however bad the codes are. Rows whose bounds miss a window, or are below what enough other rows reach for
sure, are dropped; the others are multiplied exactly in whole numbers, which completes each window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from partloom.llm.common import cut, join_spread
from partloom.llm.vectors import SLACK, first_of, of_tiles, products, ranked, tiles, unpack, whole

POSITIVES, NEGATIVES = 5, 10
#: A negative scores between these hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Components of a code, centroids, rows that they are learned from, and the components of all learned dimensions. Rows of
#: other dimensions have no codes; their residual is the whole vector, and all of them are multiplied.
PAIR, CENTROIDS, SAMPLE, COMPONENTS = 2, 256, 4096, 4096
ANCHORS, BLOCK = 1024, 8192
SEED = 11

Book = Mapping[int, np.ndarray]


def learn(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Centroids (parts, CENTROIDS, PAIR) of the rows of x by k-means in each pair of components; a last odd component has a pair of its own."""
    pad = np.pad(x, ((0, 0), (0, -x.shape[1] % PAIR))).reshape(len(x), -1, PAIR)
    rng = np.random.default_rng(SEED)
    start = rng.permutation(len(x))[: min(CENTROIDS, len(x))]
    book = np.zeros((pad.shape[1], CENTROIDS, PAIR))
    for m in range(pad.shape[1]):
        v, c = pad[:, m], pad[start, m].copy()
        for _ in range(rounds):
            near = _nearest(v, c)
            n = np.bincount(near, minlength=len(c))
            for d in range(PAIR):
                c[:, d] = np.where(n > 0, np.bincount(near, v[:, d], len(c)) / np.maximum(n, 1), c[:, d])
        book[m, : len(c)], book[m, len(c) :] = c, c[0]
    return book


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; |v|^2 does not change which."""
    return ((c**2).sum(axis=1) - 2 * (v @ c.T)).argmin(axis=1)


def encode(x: np.ndarray, book: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the rows of x, none without a book, and the length of what they leave out, rounded up."""
    if book is None:
        rest, codes = x, np.zeros((len(x), 0), np.uint8)
    else:
        pad = np.pad(x, ((0, 0), (0, -x.shape[1] % PAIR))).reshape(len(x), -1, PAIR)
        with np.errstate(over="ignore", invalid="ignore"):  # any code will do, since the residual tells what it leaves out
            codes = np.stack([_nearest(pad[:, m], c) for m, c in enumerate(book)], axis=1).astype(np.uint8)
        rest = (pad - book[np.arange(len(book)), codes]).reshape(len(x), -1)
    most = np.abs(rest).max(axis=1, initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        r = most * np.sqrt(((rest / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))
    return codes, np.nan_to_num(r, nan=np.inf, posinf=np.inf) * (1 + SLACK)


def bounds(q: np.ndarray, norm: float, codes: np.ndarray, residual: np.ndarray, long: np.ndarray, book: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each row with q, from q's lookup table and the residuals; `long` are the rows' lengths."""
    with np.errstate(over="ignore", invalid="ignore"):
        if book is None:
            s = np.zeros(len(residual))
        else:
            table = (np.pad(q, (0, -len(q) % PAIR)).reshape(-1, 1, PAIR) * book).sum(axis=2)
            s = np.zeros(len(codes))
            for entries, of in zip(table, codes.T, strict=True):
                s += entries.take(of)
        # A part for the rounding of the sum itself, which no product of lengths exceeds.
        off = norm * residual + SLACK * norm * (long + residual) + SLACK
        least, most = s - off, s + off
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


def books(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by dimension, from at most SAMPLE rows drawn by a hash of the row, of dimensions that have COMPONENTS together."""
    drawn = rows.where(F.col("dim") <= COMPONENTS).orderBy(F.xxhash64("vec_id", "body"), "vec_id").limit(SAMPLE).select("dim", "body").toPandas()
    out, left = {}, COMPONENTS
    for dim, n in drawn["dim"].value_counts().sort_index(ascending=False).sort_values(ascending=False, kind="stable").items():
        if dim <= left and n:
            x = unpack(drawn.loc[drawn["dim"] == dim, "body"], int(dim))
            if np.abs(x).max() < 2.0**100:
                left -= int(dim)
                out[int(dim)] = learn(x)
    return out


def index(rows: DataFrame, book: Book) -> DataFrame:
    """rows with the columns codes and residual; every row has them."""
    have = list(rows.columns)

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for dim, some in x.groupby("dim", sort=False):
                for k in range(0, len(some), 256):
                    part = some.iloc[k : k + 256]
                    codes, r = encode(unpack(part["body"], int(dim)), book.get(int(dim)))
                    yield part.assign(codes=[c.tobytes() for c in codes], residual=r)[[*have, "codes", "residual"]]

    return rows.mapInPandas(work, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, codes binary, residual double")


class Block:
    """Candidates of a tile."""

    def __init__(self, c: pd.DataFrame, dim: int, book: Book) -> None:
        self.x, self.norm, self.residual = unpack(c["body"], dim), c["norm"].to_numpy(np.float64), c["residual"].to_numpy(np.float64)
        # By column, as the lookups go.
        self.codes = np.asfortranarray(np.frombuffer(b"".join(c["codes"]), np.uint8).reshape(len(c), -1))
        self.id, self.label, self.book = c["vec_id"].to_numpy(np.int64), c["label"].to_numpy(np.int64), book.get(dim)

    def bounds(self, q: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        return bounds(q, norm, self.codes, self.residual, self.norm, self.book)

    def exact(self, q: np.ndarray, norm: float, at: np.ndarray) -> np.ndarray:
        return products(q[None], self.x[at], np.array([norm]), self.norm[at])[0]


def _kth(values: np.ndarray, k: int) -> float:
    """The kth largest, or minus infinity of fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _positives(book: Book, k: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q, c in of_tiles(frames):
            dim = int(q["dim"].iat[0])
            b, a = Block(c, dim, book), unpack(q["body"], dim)
            for i, (one, h, norm) in enumerate(zip(q["vec_id"], q["h"], q["norm"], strict=True)):
                least, most = b.bounds(a[i], norm)
                others = b.id != one
                at = np.flatnonzero(others & (most >= _kth(least[others], k)))
                if len(at):
                    s = b.exact(a[i], norm, at)
                    pick = first_of(s, b.id[at], k)
                    yield pd.DataFrame({"anchor_id": one, "h": h, "positive_id": b.id[at[pick]], "positive_score": s[pick]})

    return work


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole numbers s with low * score <= 100 * s <= high * score, as (first, last)."""
    return -(-low * score // 100), high * score // 100


def _negatives(book: Book, k: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The first k rows of each window of each anchor, in a tile."""

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q, c in of_tiles(frames):
            dim = int(q["dim"].iat[0])
            b, a = Block(c, dim, book), unpack(q["body"], dim)
            for i, row in enumerate(q.itertuples()):
                least, most = b.bounds(a[i], row.norm)
                other = b.label != row.label
                least, most = np.where(other, least, -np.inf), np.where(other, most, -np.inf)
                spans = [window(int(s)) for s in row.scores]
                wanted, masks = np.zeros(len(b.id), bool), []
                for lo, hi in spans:
                    may = (most >= lo) & (least <= hi)
                    may &= most >= _kth(least[may & (least >= lo) & (most <= hi)], k)
                    masks.append(may)
                    wanted |= may
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                s = b.exact(a[i], row.norm, at)
                for (lo, hi), may, positive, score in zip(spans, masks, row.positives, row.scores, strict=True):
                    fit = np.flatnonzero(may[at] & (s >= lo) & (s <= hi))
                    pick = fit[first_of(s[fit], b.id[at[fit]], k)]
                    if len(pick):
                        yield pd.DataFrame({"anchor_id": row.vec_id, "h": row.h, "positive_id": positive, "positive_score": score, "negative_id": b.id[at[pick]], "negative_score": s[pick]})

    return work


def _met(queries: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Queries and rows that agree in keys, in tiles of at most about ANCHORS by BLOCK."""
    count = F.count(F.lit(1))
    parts = lambda n, per: F.ceil(F.col(n) / per).cast("int")
    sizes = cut(rows.groupBy(*keys).agg(count.alias("n")).join(queries.groupBy(*keys).agg(count.alias("asking")), keys))
    facts = sizes.select(*keys, parts("asking", ANCHORS).alias("q_parts"), parts("n", BLOCK).alias("c_parts"), F.col("n").alias("n_rows"))
    own = lambda of: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col(of))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    tile = F.concat_ws("/", *keys, "q_part", "c_part").alias("tile")
    q = join_spread(queries, facts, keys, "n_rows", ["vec_id"]).withColumn("q_part", own("q_parts")).withColumn("c_part", each("c_parts")).select(tile, *queries.columns)
    c = join_spread(rows, facts, keys, "n_rows", ["vec_id"]).withColumn("c_part", own("c_parts")).withColumn("q_part", each("q_parts")).select(tile, *rows.columns)
    return tiles(q, c)


def mine(df: DataFrame, anchors: Column, label: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors is a condition over vec_id, label a column of df's. A row's score is its inner product with the anchor, components x taken as floor(256 x). An anchor's positives are
    its POSITIVES best other rows of its label, of which each has the NEGATIVES best rows of other labels that score LOW to HIGH hundredths of
    it; a positive below zero has none. Ties go to the smaller id, equal vectors included. Null ids, labels and vectors, empty vectors and those with components
    that are null or not finite (256-fold) take no part. Rows meet rows of as many components. Rows that repeat id, label and vector are one; other vectors
    of an id are rows of their own, and not positives of it; those that score alike as positives are told once. Scores beyond 64 bits count as its ends. Other columns of df, whatever their names, are
    not carried. An empty table gives an empty one.
    """
    spark: SparkSession = df.sparkSession
    rows = whole(df, vec_id, embedding, label)
    book = books(rows)
    rows = cut(index(rows, book))
    asking = cut(rows.where(F.coalesce(anchors, F.lit(False))).select("vec_id", "label", "dim", "body", "norm", F.xxhash64("body", "label").alias("h")))
    made = "anchor_id long, h long, positive_id long, positive_score long"
    near = _met(asking, rows, ["dim", "label"]).mapInPandas(_positives(book, POSITIVES), made)
    top = ranked(near, ["anchor_id", "h"], POSITIVES, "positive_score", "positive_id").where("positive_score >= 0")
    each = top.groupBy("anchor_id", "h").agg(F.sort_array(F.collect_set(F.struct("positive_id", "positive_score"))).alias("p"))  # at most POSITIVES
    pairs = each.select(F.col("anchor_id").alias("vec_id"), "h", F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("scores"))
    windows = cut(asking.join(pairs, ["vec_id", "h"]))
    found = _met(windows, rows, ["dim"]).mapInPandas(_negatives(book, NEGATIVES), f"{made}, negative_id long, negative_score long")
    out = ranked(found, ["anchor_id", "h", "positive_id", "positive_score"], NEGATIVES, "negative_score", "negative_id")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
