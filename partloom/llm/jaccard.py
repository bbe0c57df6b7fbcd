"""SimHash near-duplicates of word shingles down to a similarity that fingerprints alone do not reach.

The pivot tables of SimHash find pairs whose fingerprints differ in a few bits. Sets of shingles with a Jaccard similarity of
0.8 differ in about 10 of 64, which no table of parts can find, so that candidates come from MinHash too: they share one of BANDS
bands of ROWS values each, by which a pair at similarity s is missed with probability (1 - s^ROWS)^BANDS, 0.00007 at
0.8 and less above. Every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from partloom.llm.common import cut, join_spread, runs, small as few
from partloom.llm.components import components
from partloom.llm.simhash import SEED, hashes, links as simhash_links, majority

WORDS = 5
LEAST = 0.8
BANDS = 24
ROWS = 5
#: Up to this size all pairs of a bucket are compared. In larger ones all are compared with the member that meets most others, then those that are
#: not connected to it yet with all, in blocks of BLOCK by BLOCK sets.
SMALL, BLOCK = 16, 512
_CHUNK = 8192
_MULTIPLY = np.random.default_rng([SEED, 1]).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng([SEED, 2]).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; none without words."""
    return np.unique(hashes(text, words))


def digest(s: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set, 0 for the empty one."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).astype(np.int64)) if len(s) else 0


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band of a set, none for the empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.min([(s[i : i + _CHUNK, None] * _MULTIPLY + _ADD).min(axis=0) for i in range(0, len(s), _CHUNK)], axis=0)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _alike(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the others, none empty, are at `least` or more to one."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    common = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return common / (len(one) + sizes - common) >= least


def _sketches(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, d, fp, bands): d is a digest of the whole set, 0 for the empty one."""
    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in few(frames):
            sets = [shingles(t, words) for t in x["text"]]
            d = np.array([digest(s) for s in sets], np.int64)
            fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"key": x["key"], "d": d, "fp": fp, "bands": [bands(s) for s in sets]})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(work, "key long, d long, fp long, bands array<long>")


def _read(s: bytes) -> np.ndarray:
    return np.frombuffer(s, np.uint64)


def _verify(least: float) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield x.loc[[bool(_alike(_read(s), [_read(t)], least)[0]) for s, t in zip(x["s"], x["t"], strict=True)], ["a", "b"]]

    return work


def _tiles(least: float) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links between the asking members of a tile and its others that are of another component, one for each such component."""

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(frames, "tile"):
            for _, rows in frame.groupby("tile", sort=False):
                ask, held = rows[rows["asks"]], rows[~rows["asks"]]
                d, of = held["d"].to_numpy(), held["component"].to_numpy()
                sets = [_read(x) for x in held["s"]]
                for one, own, s in zip(ask["d"], ask["component"], ask["s"], strict=True):
                    at = np.flatnonzero(of != own)
                    if len(at):
                        at = at[_alike(_read(s), [sets[k] for k in at], least)]
                        first = np.unique(of[at], return_index=True)[1]
                        if len(first):
                            yield pd.DataFrame({"a": one, "b": d[at[first]]})

    return work


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of sets with fingerprints that the pivot tables link, by the least set of each fingerprint, and of sets with equal ones."""
    least = nodes.groupBy("fp").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    near = simhash_links(least.select("fp"))
    side = lambda fp, name: least.select(F.col("fp").alias(fp), F.col("least").alias(name))
    apart = near.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(side("fa", "x"), "fa").join(side("fb", "y"), "fb")
    equal = join_spread(nodes.select("d", "fp"), least, ["fp"], "n_rows", ["d"]).where("d <> least")
    return apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(equal.select(F.col("least").alias("a"), F.col("d").alias("b")))


def near_duplicates(df: DataFrame, key: str, text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(key, component), a row for each row of df: equal for rows connected by links of similarity `least` or more.

    key is a long that differs in all rows. It must be stored with the rows, or follow from where they are stored: df is read twice, and a
    key that is drawn anew each time, or that depends on how a scan is split, gives a text to another row, which is an error here. Texts of fewer words
    than a shingle are one shingle; those without words, and nulls, are alike. Equal sets, such as those of repeated rows, are compared
    once. All words of a very long text count; a pair at the very threshold is linked. Other columns of df, whatever their names, are not
    carried. An empty table gives an empty one.
    """
    prints = cut(_sketches(df, key, text, words))
    nodes = cut(prints.groupBy("d", "fp").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n_rows")))
    keys = prints.join(nodes.select("key"), "key", "left_semi").select("d", F.explode("bands").alias("g"))
    size = F.count(F.lit(1))
    sizes = keys.groupBy("g").agg(size.alias("n"), size.alias("n_rows")).where("n > 1")
    members = cut(join_spread(keys, sizes, ["g"], "n_rows", ["d"]))
    small, crowded = members.where(F.col("n") <= SMALL), members.where(F.col("n") > SMALL)
    met = crowded.groupBy("d").agg(F.sum("n").alias("met"))
    weighed = crowded.join(met, "d")
    roots = cut(weighed.groupBy("g").agg(F.max_by("d", F.struct("met", "d")).alias("root"), size.alias("n_rows")))
    large = cut(join_spread(crowded, roots, ["g"], "n_rows", ["d"]))
    among = small.select("g", F.col("d").alias("a")).join(small.select("g", F.col("d").alias("b")), "g").where("a < b").select("a", "b")
    to_root = large.where("d <> root").select(F.col("root").alias("a"), F.col("d").alias("b"))
    pairs = cut(among.unionByName(to_root).unionByName(_fingerprint_pairs(nodes.where("d <> 0"))).distinct())
    wanted = cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "d", "left_semi").select("key", "d"))

    def sets_of(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in few(frames):
            sets = [shingles(t, words) for t in x["text"]]
            if any(digest(s) != d for s, d in zip(sets, x["d"], strict=True)):
                raise ValueError(f"{key} belongs to another row than when df was read first")
            yield pd.DataFrame({"d": x["d"], "s": [s.tobytes() for s in sets]})

    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, "key").select("d", "text")
    sets = cut(texts.mapInPandas(sets_of, "d long, s binary"))
    if sets.count() != wanted.count():
        raise ValueError(f"{key} belongs to another row than when df was read first, or to none")
    from_a = sets.withColumnRenamed("d", "a").join(pairs.groupBy("a").agg(size.alias("n_rows")), "a")
    both = join_spread(pairs, from_a, ["a"], "n_rows", ["b"]).join(sets.select(F.col("d").alias("b"), F.col("s").alias("t")), "b")
    links = cut(both.mapInPandas(_verify(least), "a long, b long"))
    found = components(links)

    # What is left of large buckets: members of another component than the root's, against all of the bucket.
    of = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    # A root's component goes to its buckets before these are spread over their members.
    of_roots = roots.join(of("root"), "root", "left").select("g", F.coalesce("root_in", "root").alias("root_in"), "n_rows")
    placed = join_spread(large.join(of("d"), "d", "left"), of_roots, ["g"], "n_rows", ["d"])
    placed = cut(placed.select("g", "d", "n", F.coalesce("d_in", "d").alias("component"), (F.coalesce("d_in", "d") != F.col("root_in")).alias("asks")))
    open_ = placed.groupBy("g").agg(F.count_if("asks").alias("n_ask"), size.alias("n_rows")).where("n_ask > 0")
    rest = cut(join_spread(placed, open_, ["g"], "n_rows", ["d"]))
    if not rest.isEmpty():
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        own = lambda n: F.pmod(F.xxhash64("d"), blocks(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        asking = rest.where("asks").select("g", own("n_ask").alias("i"), each("n").alias("j"), "d", "component", F.lit(True).alias("asks"))
        held = rest.select("g", each("n_ask").alias("i"), own("n").alias("j"), "d", "component", F.lit(False).alias("asks"))
        tiles = asking.unionByName(held).select(F.xxhash64("g", "i", "j").alias("tile"), "d", "component", "asks").join(sets, "d")
        more = tiles.repartition("tile").sortWithinPartitions("tile").mapInPandas(_tiles(least), "a long, b long")
        found = components(links.unionByName(more))
    facts = nodes.join(found.withColumnRenamed("node", "d"), "d", "left").select("d", "n_rows", F.coalesce("component", "d").alias("component"))
    return join_spread(prints.select("key", "d"), facts, ["d"], "n_rows", ["key"]).select(F.col("key").alias(key), "component")
