"""Packing documents into sequences: dominance reduction after Martello and Toth, then best fit.

Only the lengths matter for the plan, so that it is made from a histogram of at most `capacity`
counts, whatever the number of documents: all pieces of one length that share a role are planned in
one step. Pieces then find their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from partloom.llm.common import by_text, cut, gapless, shipped

CAPACITY = 2048
#: Entries of each generation of a worker's cache from words to ids.
CACHE_WORDS = 400_000
#: Pieces of one length that are numbered in one task.
ROWS_PER_BUCKET = 1_000_000
#: Characters that Python takes for white space but Unicode does not.
_ODD = tuple("\x1c\x1d\x1e\x1f")
#: Marks that end a word's token; an apostrophe does not always.
_MARKS = frozenset(".,;:!?")

#: Byte-level models write each byte as a printable character: itself if it is one, else from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}

#: (items, bins): each of the bins holds items, (length, times) in order.
Group = tuple[list[tuple[int, int]], int]


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, by a cache of words.

    White space always ends a token, so that a text's ids are those of its words in a row, and so does the place
    between a letter and a mark after it. A word of small Latin letters is one token of the model, to which it goes at once. Texts for which lower-casing or splitting might
    differ from the tokenizer's own go through it whole. The cache has two generations: a full one is kept until the next is full.
    """

    def __init__(self, model: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        probes = ["the", "größe", "niño", "zzyzx"]
        self.by_word = self._pack(["the niño,\n x"])[0] == b"".join(self._pack(["the", "niño", ",", "x"]))
        self.direct = self.by_word and self._pack(probes) == [self._model(w) for w in probes]

    def _pack(self, texts: list[str]) -> list[bytes]:
        one = self.id_bytes
        return [b"".join([one[i] for i in e.ids]) for e in self.encode(texts, add_special_tokens=False)]

    def _model(self, word: str) -> bytes:
        one = self.id_bytes
        return b"".join([one[x.id] for x in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_SIGNS))])

    def _learn(self, new: set[str]) -> None:
        """Put the ids of new words into the cache; `word,` takes those of `word` and of `,`."""
        known, old = self.words, self.old
        marked, todo = [], set()
        for w in new:
            ids = old.get(w)
            if ids is not None:
                known[w] = ids
            elif len(w) > 1 and w[-1] in _MARKS and w[-2].lower().isalpha():
                marked.append(w)
            else:
                todo.add(w)
        for w in marked:
            for x in (w[:-1], w[-1]):
                if x not in known and x not in todo:
                    ids = old.get(x)
                    if ids is None:
                        todo.add(x)
                    else:
                        known[x] = ids
        plain = {w for w in todo if self.direct and w.isalpha() and w == w.lower() and _plain(w)}
        for w in plain:
            known[w] = self._model(w)
        ask = list(todo - plain)
        for k in range(0, len(ask), 10_000):
            known.update(zip(ask[k : k + 10_000], self._pack(ask[k : k + 10_000]), strict=True))
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1]]

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words, self.old = {}, self.words
        known = self.words
        split: list[list[str] | None] = [None if not self.by_word or "<|" in t or any(c in t for c in _ODD) else (t.lower() if _plain(t) else t).split() for t in texts]
        new = {w for words in split if words for w in words if w not in known}
        if new:
            self._learn(new)
        return [self._pack([t])[0] if words is None else b"".join([known[w] for w in words]) for t, words in zip(texts, split, strict=True)]


def _plain(text: str) -> bool:
    """Whether all characters are ASCII or Latin-1, which are lower-cased alike everywhere and never combine."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_IDS: dict[str, Ids] = {}  # a worker's own


def _ids(path: str, model: Broadcast[bytes]) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(model.value)
    return _IDS[path]


def tokenize(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): pieces of at most capacity ids; each document ends with id 0. tokenizer is a file of the driver."""
    model = shipped(df, tokenizer)

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _ids(tokenizer, model)
        for frame in frames:
            at, piece, size, crc = [], [], [], []
            for n, raw in enumerate(ids.batch([t or "" for t in frame["text"]])):
                raw += b"\0\0\0\0"
                for p, k in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[k : k + 4 * capacity]
                    at.append(n)
                    piece.append(p)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            pieces = np.array(piece, np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()[at], "piece": pieces.astype(np.int32), "start": pieces * capacity, "length": np.array(size, np.int64), "ids_crc32": np.array(crc, np.int64)})

    return by_text(df, doc_id, text, work, "piece int, start long, length long, ids_crc32 long")


def _largest_pair(fits: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest sum up to room of two items; an item pairs with its like only if there are two."""
    at = np.searchsorted(fits, room - fits, side="right") - 1
    at -= (at >= 0) & (fits[np.maximum(at, 0)] == fits) & (counts[fits] < 2)
    sums = np.where(at >= 0, fits + fits[np.maximum(at, 0)], 0)
    return int(sums.max(initial=0))


def reduce(counts: np.ndarray, capacity: int) -> tuple[list[Group], np.ndarray]:
    """Sets that some best packing holds, and the counts that remain.

    For an item w with room r = capacity - w, a set that fits beside it is dominated by one item if all its
    members together fit into that item's place. So w is fixed alone if nothing fits; with an item of exactly
    r; with the largest item that fits if no two do; and with it too if at most two fit
    and no pair is larger than it.
    """
    left, fixed = counts.copy(), []

    def fix(w: int, mate: int) -> None:
        n = int(left[w]) // 2 if mate == w else int(min(left[w], left[mate])) if mate else int(left[w])
        fixed.append(([(w, 2)] if mate == w else [(w, 1), (mate, 1)] if mate else [(w, 1)], n))
        left[w] -= 2 * n if mate == w else n
        if mate and mate != w:
            left[mate] -= n

    moved = True
    while moved:
        moved = False
        for w in range(capacity, 0, -1):
            while left[w]:
                others = left.copy()
                others[w] -= 1
                room = capacity - w
                fits = np.flatnonzero(others[: room + 1])
                if not len(fits):
                    fix(w, 0)
                elif fits[-1] == room and (room != w or left[w] > 1):
                    fix(w, room)
                else:
                    low = np.repeat(fits[:3], np.minimum(others[fits[:3]], 3))[:3]
                    if len(low) >= 3 and low.sum() <= room:
                        break
                    best = int(fits[-1])
                    if len(low) >= 2 and low[:2].sum() <= room:
                        if _largest_pair(fits, others, room) > best:
                            break
                    fix(w, best)
                moved = True
    return fixed, left


def best_fit(counts: np.ndarray, capacity: int) -> list[Group]:
    """Best fit by falling length; all bins of equal content move together."""
    open_: list[list[Group]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms that have bins
    for w in range(capacity, 0, -1):
        left = int(counts[w])
        while left:
            k = int(np.searchsorted(rooms, w)) if rooms else 0
            if k < len(rooms):
                room = rooms[k]
                items, bins = open_[room].pop()
                if not open_[room]:
                    rooms.pop(k)
            else:
                room, items, bins = capacity, [], -(-left // (capacity // w))
            each = room // w
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0
            parts = [(items + [(w, each)], full, room - each * w)]
            if rest:
                parts.append((items + [(w, rest)], 1, room - rest * w))
            parts.append((items, bins - full - (1 if rest else 0), room))
            left -= full * each + rest
            for content, n, now in parts:
                if n > 0:
                    if not open_[now]:
                        rooms.insert(bisect_right(rooms, now), now)
                    open_[now].append((content, n))
    return [g for groups in open_ for g in groups if g[0]]


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, first rank, times in a bin, first sequence, offset) sorted by length and rank."""
    fixed, left = reduce(counts, capacity)
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for items, bins in fixed + best_fit(left, capacity):
        at = 0
        for w, times in items:
            rows.append((w, rank[w], times, sequence, at))
            rank[w] += times * bins
            at += w * times
        sequence += bins
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


_RANKS = 1 << 44


def pack(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece; other columns of df are not carried.

    A null or empty text is the one id 0. Very long texts are cut into pieces. Repeated rows and equal
    doc_ids are packed each. A piece of the full length is a sequence of its own. Other pieces of one length are alike to the
    plan and take its places by any order of rows, so that ties need no rule. An empty table gives an empty one.
    """
    spark = df.sparkSession
    pieces = cut(tokenize(df, tokenizer, doc_id, text, capacity).withColumn("row", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    buckets = -(-counts // ROWS_PER_BUCKET)
    counts[capacity] = 0
    table = plan(counts, capacity)
    sequences = int(table[:, 3].max(initial=0) + counts.sum()) + 1  # above all of the plan's
    places = spark.sparkContext.broadcast(table)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    of_length = F.element_at(F.array(*[F.lit(int(n)) for n in buckets]), (F.col("length") + 1).cast("int"))
    bucket = F.pmod(F.xxhash64("row"), F.greatest(of_length, F.lit(1))).cast("int")
    ranked = gapless(pieces.where(F.col("length") < capacity), ["length"], bucket, [F.col("row")], "rank")

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = places.value
        keys = p[:, 0] * _RANKS + p[:, 1]
        for x in frames:
            rank = x.pop("rank").to_numpy()
            length = x["length"].to_numpy()
            row = p[np.searchsorted(keys, length * _RANKS + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield x.assign(sequence_id=row[:, 3] + nth // row[:, 2], offset=row[:, 4] + nth % row[:, 2] * length)

    kind = df.schema[doc_id].dataType
    shape = "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    full = pieces.where(F.col("length") == capacity).select(*names, (F.col("row") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    planned = ranked.select(F.col("doc_id").cast("string").alias("doc_id"), *names[1:], "rank").mapInPandas(work, shape)
    return planned.withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(full)
