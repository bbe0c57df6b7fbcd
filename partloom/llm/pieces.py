"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position it reports the pieces that end there, longest first, by its
output links, and each relaxes the best score up to that position. A character that is no piece
falls back to the pieces of its bytes. The pieces and their scores come from a model file; nothing is trained.

A unigram model's scores are log probabilities, and the best path has the highest sum. A BPE model's are the ranks of its merges,
whose sum means nothing: there the best path has the fewest ids, and of those the lowest sum of ranks, so that it never
has more ids than the model's own merges give.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from partloom.llm.common import by_text, shipped

SPACE = "▁"
#: A unigram model's unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: What an id costs where scores are ranks: more than the ranks of LONG ids sum up to. Longer chunks are counted in whole numbers.
ID_COST, LONG = float(1 << 34), 1 << 18
CACHE_CHUNKS = 400_000


class Codec:
    """Encodes and decodes whole texts with the pieces of one model file.

    Chunks end before white space after a word, and around line ends that are no piece: no piece
    crosses those places, so that the best path of a text is that of its chunks in a row, and chunks
    are kept. The sign for a space, where it stands in a text itself, is encoded by its bytes, so that decoding
    gives back every text.
    """

    def __init__(self, source: str | bytes) -> None:
        """source is a model, or the path of its file."""
        import ahocorasick
        import sentencepiece

        given = source if isinstance(source, bytes) else Path(source).read_bytes()
        model = sentencepiece.SentencePieceProcessor(model_proto=given)
        size = model.get_piece_size()
        self.bytes_: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.score: dict[str, tuple[int, float]] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_.append(b"")
            else:
                self.score[piece] = (i, model.get_score(i))
                self.bytes_.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_id) < 256:
            raise ValueError("the model has no pieces for bytes")
        self.ranked = all(float(s).is_integer() for _, s in self.score.values())
        if self.ranked:
            by_rank = sorted(self.score, key=lambda p: (-self.score[p][1], self.score[p][0]))
            self.score = {p: (self.score[p][0], -ID_COST - n) for n, p in enumerate(by_rank)}
            self.unknown = -len(by_rank)  # besides its bytes' ids
        else:
            self.unknown = min(s for _, s in self.score.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, (i, s) in self.score.items():
            self.automaton.add_word(piece, (len(piece), i, s))
        self.automaton.make_automaton()
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.score)
        line = "" if any("\n" in p for p in self.score) else r"\n"
        plain = rf"{SPACE}*[^{SPACE}{line}]+|{SPACE}+"
        self.chunks = None if crossing else re.compile(f"{line}|{plain}" if line else plain).findall
        self.known: dict[str, bytes] = {}
        self.singles = frozenset(p for p in self.score if len(p) == 1)

    def unknown_score(self, c: str) -> float:
        """Of a character that goes by its bytes."""
        return self.unknown - ID_COST * len(c.encode("utf-8", "surrogatepass")) if self.ranked else self.unknown

    def best(self, text: str, literal: frozenset[int] = frozenset()) -> list[int]:
        """Ids of the best path over a text in which spaces are signs; at the places in `literal` the sign is itself."""
        n, low = len(text), float("-inf")
        if self.ranked and n > LONG:
            return self._best_of_long(text, literal)
        score, came, by = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        if not literal and self.singles.issuperset(text):  # no character goes by its bytes
            for end, (length, i, s) in self.automaton.iter(text):
                value = score[end + 1 - length] + s
                if value > score[end + 1]:
                    score[end + 1], came[end + 1], by[end + 1] = value, end + 1 - length, i
            return self._path(text, came, by)
        single, at = self.score, 0
        ends: Iterable = self.automaton.iter(text)
        for end, (length, i, s) in chain(ends, [(n - 1, (0, -1, low))]):
            for k in range(at, end + 1):
                if text[k] not in single or k in literal:
                    value = score[k] + self.unknown_score(text[k])
                    if value > score[k + 1]:
                        score[k + 1], came[k + 1], by[k + 1] = value, k, -1
            at = max(at, end + 1)
            start = end + 1 - length
            if length and not (literal and not literal.isdisjoint(range(start, end + 1))):
                value = score[start] + s
                if value > score[end + 1]:
                    score[end + 1], came[end + 1], by[end + 1] = value, start, i
        return self._path(text, came, by)

    def _best_of_long(self, text: str, literal: frozenset[int]) -> list[int]:
        """best() with pairs (ids, ranks) instead of their weighted sum."""
        n = len(text)
        split = lambda s: (round(-s // ID_COST), -s % ID_COST)
        far = (n * 8 + 8, 0.0)
        cost, came, by = [(0, 0.0)] + [far] * n, [0] * (n + 1), [-1] * (n + 1)
        at = 0
        for end, (length, i, s) in chain(self.automaton.iter(text), [(n - 1, (0, -1, 0.0))]):
            for k in range(at, end + 1):
                if text[k] not in self.score or k in literal:
                    ids, rank = split(self.unknown_score(text[k]))
                    value = (cost[k][0] + ids, cost[k][1] + rank)
                    if value < cost[k + 1]:
                        cost[k + 1], came[k + 1], by[k + 1] = value, k, -1
            at = max(at, end + 1)
            start = end + 1 - length
            if length and not (literal and not literal.isdisjoint(range(start, end + 1))):
                ids, rank = split(s)
                value = (cost[start][0] + ids, cost[start][1] + rank)
                if value < cost[end + 1]:
                    cost[end + 1], came[end + 1], by[end + 1] = value, start, i
        return self._path(text, came, by)

    def _path(self, text: str, came: list[int], by: list[int]) -> list[int]:
        out: list[int] = []
        n = len(text)
        while n:
            if by[n] >= 0:
                out.append(by[n])
            else:
                out += [self.byte_id[b] for b in reversed(text[came[n] : n].encode("utf-8", "surrogatepass"))]
            n = came[n]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; none for the empty text."""
        if not text:
            return b""
        pack = lambda ids: np.array(ids, "<u4").tobytes()
        signs = SPACE + text.replace(" ", SPACE)
        if SPACE in text:
            return pack(self.best(signs, frozenset(i + 1 for i, c in enumerate(text) if c == SPACE)))
        if self.chunks is None:
            return pack(self.best(signs))
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        out = []
        for chunk in self.chunks(signs):
            ids = known.get(chunk)
            if ids is None:
                ids = known[chunk] = pack(self.best(chunk))
            out.append(ids)
        return b"".join(out)

    def decode_own(self, ids: bytes) -> str:
        """decode() of what encode() gave."""
        return self._text(map(self.bytes_.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: Iterable[int | None]) -> str:
        """The text of ids; one that is null or not in the vocabulary is a replacement character, as are bytes that are no text.

        A space in front goes, which encode() puts there.
        """
        found, size = list(ids), len(self.bytes_)
        if None in found or found and not 0 <= min(found) <= max(found) < size:
            parts: Iterable[bytes] = [self.bytes_[i] if i is not None and 0 <= i < size else b"\xef\xbf\xbd" for i in found]
        else:
            parts = map(self.bytes_.__getitem__, found)
        return self._text(parts)

    def _text(self, parts: Iterable[bytes]) -> str:
        got = b"".join(parts).removeprefix(b" ")
        try:
            return got.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return got.decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}  # a worker's own


def codec(path: str, model: Broadcast[bytes]) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(model.value)
    return _CODECS[path]


def encode(df: DataFrame, model: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with the ids of each text as array<int>; null for a null text, empty for an empty one.

    A very long text is encoded whole. Of paths that are equally good the first found stays, so that repeated rows and ties get equal ids. Other
    columns stay, but for one named as `into`. An empty table gives an empty one.
    """

    held = shipped(df, model)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(model, held)
        return pd.Series([None if t is None else np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in texts], dtype=object)

    return df.drop(into).withColumn(into, ids(df[text]))


def decode(df: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text of each array of ids, however long; null for null, empty for none.

    Null ids, ids that are not in the vocabulary, and bytes that are no text become replacement characters. Repeated rows and ties get equal texts.
    Other columns stay, but for one named as `into`. An empty table gives an empty one.
    """

    held = shipped(df, model)

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        c = codec(model, held)
        return pd.Series([None if r is None else c.decode(None if i is None or i != i else int(i) for i in r) for r in rows], dtype=object)

    return df.drop(into).withColumn(into, text(df[ids]))


def digest(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip), a row for each row of df, without moving the ids: round_trip is whether decoding gives the text.

    A null text has no ids, crc 0 and a null round_trip. Repeated rows get equal results, and ties too; very long texts are encoded whole. An empty
    table gives an empty one. Other columns of df, whatever their names, are not carried.
    """
    held = shipped(df, model)

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model, held)
        for x in frames:
            ids = [c.encode(t or "") for t in x["text"]]
            same = [None if t is None else c.decode_own(i) == t for t, i in zip(x["text"], ids, strict=True)]
            yield pd.DataFrame({"doc_id": x["doc_id"], "n_ids": [len(i) // 4 for i in ids], "ids_crc32": [zlib.crc32(i) for i in ids], "round_trip": pd.array(same, "boolean")})

    return by_text(df, doc_id, text, work, "n_ids long, ids_crc32 long, round_trip boolean")
