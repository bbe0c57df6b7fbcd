"""Language identification: a Viterbi path over per-word scores labels the spans of mixed texts.

A word's script narrows the languages that may claim it; among them trigrams score it. A change of language
between words costs a penalty. The document's language is the one whose spans hold most letters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partloom.llm.common import ROWS_PER_FRAME, WordTable, by_text, crc_fold, cut, join_spread, small

UNKNOWN = "und"
#: First code points of script ranges; a range ends where the next begins. Fixed values of Unicode.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
_STARTS = [s for s, _ in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]+")
#: A language has a script if it holds this share of the language's training words.
SCRIPT_SHARE = 0.01
#: Score of a word for a language that lacks its script, and of a change of language, in nats.
WRONG_SCRIPT, SWITCH = -30.0, 12.0
#: Documents of each language to learn from, about: they are drawn by a hash of the id.
PER_LANGUAGE = 2000
#: Up to so many languages their shares are broadcast to the texts; beyond, texts move to the shares.
BROADCAST_LANGUAGES = 10_000


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def words_of(text: str | None) -> list[str]:
    """Lower-case words of letters alone."""
    found = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for w in ("".join(filter(str.isalpha, x)) for x in found) if w]


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class Model:
    """logp: a row for each trigram and one for unknown ones, a column for each language."""

    langs: list[str]
    grams: dict[str, int]
    logp: np.ndarray
    scripts: dict[str, list[int]]

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word, relative to its best language, and last its number of letters."""
        k, unknown = len(self.langs), len(self.grams)
        out = np.zeros((len(words), k + 1), np.float32)
        out[:, k] = [len(w) for w in words]
        if not words or not k:
            return out
        at = [[self.grams.get(g, unknown) for g in _grams(w)] for w in words]
        lengths = np.fromiter(map(len, at), np.int64, len(at))
        flat = np.fromiter((i for x in at for i in x), np.int64, int(lengths.sum()))
        out[:, :k] = np.add.reduceat(self.logp[flat], np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)
        for i, w in enumerate(words):
            own = self.scripts.get(script_of(w))
            if own is None:
                out[i, :k] = 0  # no language has it: the word tells nothing
            elif len(own) < k:
                wrong = np.ones(k, bool)
                wrong[own] = False
                out[i, :k][wrong] = WRONG_SCRIPT + out[i, own].min()
        out[:, :k] -= out[:, :k].max(axis=1, keepdims=True)
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from a sample of about per_language whole texts of each non-null language.

    What reaches the driver is the trigrams of that sample, so that the model's size is bounded by
    the parameter and the number of languages, of which there may be any. Languages with fewer texts use all. A null text, or one without letters,
    teaches nothing; of a very long one all words count, and repeated rows each. A null key is drawn like any other.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("key"))
    totals = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.least(F.lit(1_000_000), F.ceil(1_000_000 * per_language / F.col("n")))))
    langs = sorted(r[0] for r in totals.select("lang").toLocalIterator())
    if len(langs) <= BROADCAST_LANGUAGES:
        met = rows.join(F.broadcast(totals.drop("n")), "lang")
    else:
        met = join_spread(rows, totals, ["lang"], "n", ["key"])
    sample = met.where(F.pmod(F.xxhash64("key", F.lit("language sample")), F.lit(1_000_000)) < F.col("share"))

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small(frames):
            found: dict[tuple[str, str, str], int] = defaultdict(int)
            for one, x in zip(frame["lang"], frame["text"], strict=True):
                for w in words_of(x):
                    found[one, "s", script_of(w)] += 1
                    for g in _grams(w):
                        found[one, "g", g] += 1
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "kind", "name", "n"])

    counted = sample.select("lang", "text").mapInPandas(count, "lang string, kind string, name string, n long")
    rows = counted.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")).toPandas()
    column = {x: i for i, x in enumerate(langs)}
    g = rows[rows["kind"] == "g"]
    grams = {x: i for i, x in enumerate(sorted(set(g["name"])))}
    counts = np.zeros((len(grams) + 1, len(langs)))
    counts[g["name"].map(grams).to_numpy(int), g["lang"].map(column).to_numpy(int)] = g["n"]
    logp = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(grams) + 1)))
    scripts: dict[str, list[int]] = defaultdict(list)
    s = rows[rows["kind"] == "s"]
    all_words = s.groupby("lang")["n"].sum()
    for r in s.itertuples():
        if r.n >= SCRIPT_SHARE * all_words[r.lang]:
            scripts[r.name].append(column[r.lang])
    return Model(langs, grams, logp.astype(np.float32), dict(scripts))


def _constant(s: np.ndarray) -> int | None:
    """The language of the best path if that never changes, as far as a bound on every span's gain shows it.

    Two spans of other languages at the ends of a text cost one change together, so that each may gain half a change at most.
    """
    best = int(s.sum(axis=0, dtype=np.float64).argmax())
    sums = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.concatenate((np.zeros((1, s.shape[1])), sums[:-1])), axis=0)
    return best if (sums - low).max() <= SWITCH / 2 else None


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best path of each document: most score less `switch` for each change. All documents advance together."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    if not len(order) or not lengths[0]:
        return [np.zeros(0, np.int32) for _ in scores]
    k = scores[0].shape[1]
    active = [int(n) for n in np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")]  # documents longer than t
    first = np.concatenate(([0], np.cumsum(active)))
    by_time = np.empty((first[-1], k), np.float32)
    for rank, i in enumerate(order):
        by_time[first[: lengths[rank]] + rank] = scores[i]
    value = by_time[: active[0]].astype(np.float64)
    came = np.zeros((first[-1], k), np.int32)
    own = np.arange(k, dtype=np.int32)
    final = np.zeros(len(order), np.int32)
    for t in range(1, len(active)):
        m = active[t]
        if m < active[t - 1]:
            final[m : active[t - 1]] = value[m:].argmax(axis=1)
            value = value[:m]
        top = value.argmax(axis=1)
        jump = value[np.arange(m), top] - switch
        stay = value >= jump[:, None]
        came[first[t] : first[t] + m] = np.where(stay, own, top[:, None])
        value = np.where(stay, value, jump[:, None]) + by_time[first[t] : first[t] + m]
    final[: len(value)] = value.argmax(axis=1)
    path = np.empty(first[-1], np.int32)
    now = final
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        path[first[t] : first[t] + m] = now[:m]
        if t:
            now = now.copy()
            now[:m] = came[first[t] : first[t] + m][np.arange(m), now[:m]]
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(scores)
    for rank, i in enumerate(order):
        out[i] = path[first[: lengths[rank]] + rank]
    return out


class Labeller:
    """Paths for batches of texts, with a table of word scores."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.table = WordTable(model.scores)

    def paths(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the language number and the letters of each word."""
        k = len(self.model.langs)
        numbers = self.table.numbers([words_of(t) for t in texts])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        mixed, waiting = [], []
        for n in numbers:
            rows = self.table.store[n]
            letters = rows[:, k]
            if not len(n) or not k:
                out.append((np.zeros(len(n), np.int32), letters))
                continue
            same = _constant(rows[:, :k])
            if same is None:
                waiting.append(len(out))
                mixed.append(rows[:, :k])
            out.append((np.full(len(n), same or 0, np.int32), letters))
        for at, path in zip(waiting, viterbi(mixed), strict=True):
            out[at] = (path, out[at][1])
        return out


def identify(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans), a row for each row of df.

    score is the share of the text's letters in spans of lang_pred; spans are (lang, first word,
    words). A null text, or one without a letter, is `und` with score 0 and no spans, as is
    any if no language was learned. Ties go to the language first by name. Repeated rows get equal results. Of a very long text
    all words are scored. An empty table gives an empty one. Other columns of df, whatever their names, are not carried.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller, langs = Labeller(held.value), held.value.langs
        for frame in frames:
            pred, score, spans = [], [], []
            for path, letters in labeller.paths(list(frame["text"])):
                if not len(path) or not langs:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    spans.append([])
                    continue
                share = np.bincount(path, weights=letters, minlength=len(langs))
                best = int(share.argmax())
                pred.append(langs[best])
                score.append(float(share[best] / share.sum()))
                starts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
                ends = np.append(starts[1:], len(path))
                spans.append([{"lang": langs[path[a]], "first": int(a), "words": int(b - a)} for a, b in zip(starts, ends, strict=True)])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": pred, "score": score, "spans": spans})

    return by_text(df, doc_id, text, work, "lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>")


def keep_pure(df: DataFrame, model: Model, text: str = "text", least_share: float = 0.5) -> DataFrame:
    """The rows of df, unchanged, whose text has a language that holds at least this share of its letters.

    Rows are dropped where they are read, without a join. Null texts and those without a letter go. Each row is judged alone, by all
    words of its text however long, so that repeated rows and ties share a fate; ids and other columns, null or not, play no part. An empty
    table gives an empty one.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, k = Labeller(held.value), len(held.value.langs)
        for batch in (whole.slice(k, ROWS_PER_FRAME) for whole in batches for k in range(0, whole.num_rows, ROWS_PER_FRAME)):
            share = [np.bincount(p, weights=n, minlength=k) if k and len(p) else np.zeros(1) for p, n in labeller.paths(batch.column(text).to_pylist())]
            yield batch.filter(pa.array([bool(s.sum()) and s.max() >= least_share * s.sum() for s in share], pa.bool_()))

    return df.mapInArrow(work, df.schema)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """fit() on the documents that are not held out."""
    return fit(docs.where(crc_fold(F.col("doc_id")) != 1), per_language=per_language)
