"""Whole-number vectors in compact rows, their exact products, and tiles in which queries meet candidates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.llm.common import cut, runs, small

#: Numbers are in sight of this factor what they are.
SLACK = 1e-9
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(embedding: Column) -> Column:
    """Not null or empty, all components there and finite, also when taken 256 times."""
    return F.coalesce((F.size(embedding) > 0) & ~F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) * 256 == float("inf"))), F.lit(False))


def _pack(row: np.ndarray) -> bytes:
    return (row.astype("<i2") if np.abs(row).max(initial=0) <= 32767 else row.astype("<f8")).tobytes()


def unpack(bodies: Iterable[bytes], dim: int) -> np.ndarray:
    """The vectors of bodies of one dimension as doubles, which hold each whole number as it is."""
    bodies = list(bodies)
    if all(len(b) == 2 * dim for b in bodies):
        return np.frombuffer(b"".join(bodies), "<i2").reshape(len(bodies), dim).astype(np.float64)
    return np.stack([np.frombuffer(b, "<i2" if len(b) == 2 * dim else "<f8").astype(np.float64) for b in bodies])


def length(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, rounded up; components may be as large as doubles are."""
    most = np.abs(x).max(axis=1, initial=0)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1)) * (1 + SLACK)


def whole(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | None = None) -> DataFrame:
    """(vec_id, label, dim, body, norm) of the usable rows with an id: floor(256 x) of each component x. Rows that repeat id, label and vector are one."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), (F.lit(0) if label is None else label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in small(frames):
            dims = x["embedding"].map(len).to_numpy()
            for dim in np.unique(dims):
                some = x[dims == dim]
                v = np.floor(256.0 * np.stack(some["embedding"].to_list()))
                yield pd.DataFrame({"vec_id": some["vec_id"], "label": some["label"], "dim": np.int32(dim), "body": [_pack(r) for r in v], "norm": length(v)})

    made = rows.mapInPandas(work, "vec_id long, label long, dim int, body binary, norm double")
    return cut(made.groupBy("vec_id", "label", "dim", "body").agg(F.first("norm").alias("norm")))


def products(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, of lengths na and nb, exactly; beyond the range of 64 bits they are its ends.

    Below 2^53 no partial sum of doubles is rounded, since it is no more than the product of the lengths.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        most = na.max(initial=0) * nb.max(initial=0)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    if len(a) == 1 and len(b) == 1:
        total = sum(int(x) * int(y) for x, y in zip(a[0], b[0], strict=True))
        return np.array([[min(max(total, _LEAST), _MOST)]], np.int64)
    # Few rows are so long: the others are taken together.
    i, j = (np.argsort(n, kind="stable") for n in (na, nb))
    out = np.empty((len(a), len(b)), np.int64)
    for x in np.array_split(i, 2) if len(a) > 1 else [i]:
        for y in np.array_split(j, 2) if len(b) > 1 else [j]:
            out[np.ix_(x, y)] = products(a[x], b[y], na[x], nb[y])
    return out


def tiles(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Queries and rows with a column `tile` together in the order of tiles, queries first, then rows from the longest; `asks` tells them apart.

    What only one side has is not null on the other, since nulls would turn whole numbers into doubles in frames.
    """

    def filled(df: DataFrame, other: DataFrame) -> DataFrame:
        empty = lambda kind: F.array() if kind.startswith("array") else F.lit("" if kind in ("string", "binary") else 0)
        return df.withColumns({n: empty(kind).cast(kind) for n, kind in other.dtypes if n not in df.columns})

    both = filled(queries, rows).withColumn("asks", F.lit(True)).unionByName(filled(rows, queries).withColumn("asks", F.lit(False)))
    return both.repartition("tile").sortWithinPartitions("tile", F.desc("asks"), F.desc("norm"))


def of_tiles(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """The queries and the rows of each tile that has both."""
    for frame in runs(frames, "tile"):
        for _, t in frame.groupby("tile", sort=False):
            q, c = t[t["asks"]], t[~t["asks"]]
            if len(q) and len(c):
                yield q.reset_index(drop=True), c.reset_index(drop=True)


def ranked(df: DataFrame, keys: list[str], k: int, score: str = "score", by: str = "vec_id") -> DataFrame:
    """The k rows of each key with the highest scores, ties by the smaller id, and their rank from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(by)))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller ids."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep].astype(object) if scores.min(initial=0) == _LEAST else -scores[keep]))][:k]
