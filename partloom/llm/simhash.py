"""SimHash near-duplicates, found by tables of Hamming distances to reference fingerprints (pivots).

By the triangle inequality two fingerprints x, y within r bits have |d(x, p) - d(y, p)| <= r for
every pivot p. That is used twice. To find candidates without comparing all pairs, the bits are
split into r + 1 parts with pivots of their own: in one part at least x and y do not differ, so that
all its coordinates are equal, which is an equi-join key. Within a bucket pairs whose largest coordinate
difference over full-width pivots is above r are discarded, and the survivors are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from partloom.llm.common import by_text, cut, join_spread, runs
from partloom.llm.components import components

RADIUS = 3
PARTS = RADIUS + 1
SEED = 42
FULL_PIVOTS = 16
PART_PIVOTS = 12
#: Larger buckets are split again by the bits that their key leaves open.
BUCKET_ROWS = 2048
#: Up to this size all links of a bucket are told, beyond it those of a spanning forest.
SMALL = 16
_ALL = (1 << 64) - 1


def hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of each of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # for bytes: A-Z and ASCII white space
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:k].tolist(), last.tolist(), strict=True)), "<u8", k)


def majority(h: np.ndarray) -> int:
    """The 64-bit number of the bits that over half of the hashes have; 0 of none."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text's shingles; a text without words gives 0."""
    return majority(hashes(text, words))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            fp = np.array([fingerprint(t, words) for t in x["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": x["doc_id"], "fp": fp})

    return by_text(df, doc_id, text, work, "fp long")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@cache
def _pivots(mask: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, mask & 0xFFFFFFFF, mask >> 32]).integers(0, _ALL, n, np.uint64, endpoint=True) & np.uint64(mask)


@cache
def _parts(free: int) -> list[int]:
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(bits, int), PARTS)]


def _coordinates(x: np.ndarray, mask: int, n: int) -> np.ndarray:
    return np.bitwise_count((x[:, None] ^ _pivots(mask, n)) & np.uint64(mask)).astype(np.int8)


def _split(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each (fp, g, free) becomes a row for each part of its free bits; g is the key so far."""
    for frame in frames:
        for free, rows in frame.groupby("free", sort=False):
            x, g = rows["fp"].to_numpy().view(np.uint64), rows["g"].to_numpy().view(np.uint64)
            mask = int(free) & _ALL
            for i, part in enumerate(_parts(mask)):
                key = (g ^ np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
                for c in _coordinates(x, part, PART_PIVOTS).T:
                    key = (key ^ c.astype(np.uint64)) * np.uint64(0x100000001B3)
                    key ^= key >> np.uint64(29)
                left = np.array([mask & ~part], np.uint64).view(np.int64)[0]
                yield pd.DataFrame({"fp": rows["fp"].to_numpy(), "g": key.view(np.int64), "free": left})


def _near(x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs i, j are within RADIUS: largest coordinate difference first, then the bits."""
    keep = np.abs(c[i] - c[j]).max(axis=1, initial=0) <= RADIUS
    at = np.flatnonzero(keep)
    i, j = np.broadcast_to(i, keep.shape)[at], np.broadcast_to(j, keep.shape)[at]
    keep[at] = np.bitwise_count(x[i] ^ x[j]) <= RADIUS
    return keep


def _forest(x: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected in one bucket, fewer than it has members."""
    left = np.arange(len(x))
    while len(left):
        open_, left = [left[:1]], left[1:]
        while open_ and len(left):
            s = open_.pop()
            hit = _near(x, c, s, left)
            if hit.any():
                found, left = left[hit], left[~hit]
                yield np.repeat(x[s], len(found)), x[found]
                open_ += [found[k : k + 1] for k in range(len(found))]


def _links(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in runs(frames, "g"):
        g, x = frame["g"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        sizes = np.diff(np.append(first, len(g)))
        if sizes.max() < 2:
            continue
        c, out = _coordinates(x, _ALL, FULL_PIVOTS), []
        of = np.repeat(sizes, sizes)
        for d in range(1, min(SMALL, int(sizes.max()))):
            i = np.flatnonzero((g[d:] == g[:-d]) & (of[d:] <= SMALL))
            i = i[_near(x, c, i, i + d)]
            out.append((x[i], x[i + d]))
        for k in np.flatnonzero(sizes > SMALL):
            s = slice(first[k], first[k] + sizes[k])
            out += _forest(x[s], c[s])
        if any(len(a) for a, _ in out):
            yield pd.DataFrame({"a": np.concatenate([a for a, _ in out]).view(np.int64), "b": np.concatenate([b for _, b in out]).view(np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """(a, b) among the distinct fingerprints of prints (fp): links of at most RADIUS bits that connect all that are connected so.

    Buckets over BUCKET_ROWS are split by the bits still free, four ways each time, until none is
    too large or no bits are left; at that depth a bucket has few distinct fingerprints.
    """
    shape = "fp long, g long, free long"
    todo = prints.select("fp", F.lit(0).cast("long").alias("g"), F.lit(-1).cast("long").alias("free"))
    found = []
    for depth in range(6):
        level = cut(todo.mapInPandas(_split, shape))
        size = F.count(F.lit(1))
        hot = cut(level.groupBy("g").agg(size.alias("n"), size.alias("n_rows")).where(F.col("n") > BUCKET_ROWS))
        some = depth < 5 and not hot.isEmpty()
        # Rows know whether their bucket is hot; those of a very large one are dealt to several tasks.
        told = join_spread(level, hot, ["g"], "n_rows", ["fp"], "left") if some else level
        cold = told.where("n IS NULL") if some else level
        found.append(cold.select("g", "fp").repartition("g").sortWithinPartitions("g").mapInPandas(_links, "a long, b long"))
        if not some:
            break
        todo = told.where("n IS NOT NULL").drop("n")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of df: the smallest doc_id reachable over links.

    Null and empty texts have fingerprint 0 and are linked like any other; of very long ones all words count. Repeated rows and exact
    copies share a fingerprint, which is compared once; ties are such. A null doc_id gets a fingerprint and the
    smallest other doc_id of its component, null if there is none. An empty table gives an empty one. Other columns of df, whatever
    their names, are not carried.
    """
    prints = cut(fingerprints(df, doc_id, text, words))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows")))
    found = components(links(nodes.select("fp")))
    member = nodes.join(found.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "least")
    lowest = member.groupBy("component").agg(F.min("least").alias("lowest"))
    linked = member.join(lowest, "component").select("fp", "lowest")
    of = nodes.join(linked, "fp", "left").select("fp", "n_rows", F.coalesce("lowest", "least").alias("component_id"))
    return join_spread(prints, of, ["fp"], "n_rows", ["doc_id"]).select("doc_id", "fp", "component_id")
