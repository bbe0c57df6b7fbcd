"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from partloom.llm.common import WordTable, by_text, crc_fold, cut, small

#: At most so many labelled texts are learned from, those with the least hashes of their ids.
MAX_LABELLED = 20_000
#: The calibration is fitted to scores of texts that neither lexicon nor trees have seen, in so many folds.
FOLDS = 3
#: A term enters the lexicon if toxic texts hold it so much more often than by chance (standard deviations, log odds).
LEAST_Z, WEAK, STRONG = 6.0, 1.5, 3.5
STEMS = (4, 5, 6, 7)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ye du dich dir dein deine deinen deinem deiner ihr euch euer eure tu te toi ton ta tes vous votre vos "
    "tú ti contigo tuyo tuya usted ustedes vosotros vuestro vuestra".split()
)
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]")
NAMES = (
    "words", "strong", "weak", "strong_count", "second_person", "nearness", "near_share",
    "capitals", "capital_words", "shouts", "questions", "marks", "obfuscated", "hidden",
)


def plain(token: str) -> str:
    """A token in lower case without the marks around it."""
    return _EDGE.sub("", token.lower())


def unmask(word: str) -> str:
    """Digits and signs that stand for letters put back, other marks within a word dropped."""
    return re.sub(r"[\W\d_]", "", word.translate(_LEET))


def terms(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def tokens(text: str | None) -> list[str]:
    return (text or "").split()


#: Columns of the table of tokens that no lexicon changes, and those of each lexicon.
_SHARED, _OWN = 8, 3


@dataclass
class Features:
    """Dense features by one or several lexicons of terms and their log odds; per-token figures are made once a worker."""

    lexicons: list[dict[str, float]]
    table: WordTable = field(init=False)

    def __post_init__(self) -> None:
        self.table = WordTable(self._of_tokens)

    def _of_tokens(self, found: list[str]) -> np.ndarray:
        out = np.zeros((len(found), _SHARED + _OWN * len(self.lexicons)), np.float32)
        for i, x in enumerate(found):
            word = plain(x)
            masked = bool(_INNER.search(word)) and any(map(str.isalpha, word))
            clear = unmask(word) if masked else word
            upper = sum(map(str.isupper, x))
            letters = sum(map(str.isalpha, x))
            row = [word in SECOND_PERSON, upper, letters, letters > 1 and upper == letters, x.count("!"), x.count("?"), len(x) - sum(map(str.isalnum, x)), masked]
            asked, hidden = terms(word) if word else [], terms(clear) if masked and clear else []
            for lexicon in self.lexicons:
                odds = max([lexicon.get(t, 0.0) for t in asked], default=0.0)
                shown = max([lexicon.get(t, 0.0) for t in hidden], default=0.0) if hidden else odds
                odds = max(odds, shown)
                row += odds >= STRONG, WEAK <= odds < STRONG, masked and shown >= STRONG
            out[i] = row
        return out

    def batch(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, and in it one of len(NAMES) figures for each lexicon."""
        out = np.zeros((len(texts), len(self.lexicons), len(NAMES)))
        for made, n in zip(out, self.table.numbers([tokens(t) for t in texts]), strict=True):
            if not len(n):
                continue
            rows = self.table.store[n]
            sums = rows.sum(axis=0, dtype=np.float64)
            you = np.flatnonzero(rows[:, 0])
            words, letters = len(n), max(1.0, sums[2])
            for k, row in enumerate(made):
                first = _SHARED + _OWN * k
                n_strong, n_weak, n_hidden = sums[first : first + _OWN]
                nearness = share = 0.0
                if n_strong and len(you):
                    strong = np.flatnonzero(rows[:, first])
                    at = np.searchsorted(you, strong)
                    gap = np.minimum(np.abs(strong - you[np.minimum(at, len(you) - 1)]), np.abs(strong - you[np.maximum(at - 1, 0)]))
                    nearness, share = 1 / (1 + gap.min()), (gap <= 5).mean()
                row[:] = (
                    np.log1p(words), 100 * n_strong / words, 100 * n_weak / words, np.log1p(n_strong), 100 * sums[0] / words, nearness, share,
                    sums[1] / letters, sums[3] / words, sums[4] / words, sums[5] / words, sums[6] / words, sums[7] / words, 100 * n_hidden / words,
                )
        return out


@dataclass
class Trees:
    """Boosted trees of one depth over binned features: split (feature, threshold) by level order, then leaf values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss, with splits at quantiles."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1) if len(x) else np.zeros(x.shape, int)
    value = np.full(len(x), base)
    inner, features, thresholds, leaves = 2**depth - 1, [], [], []
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-value))
        g, h = y - p, p * (1 - p)
        f, t, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(x), int)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(wide)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                at = local * bins + binned[:, k]
                gs = np.bincount(at, g, wide * bins).reshape(wide, bins).cumsum(axis=1)
                hs = np.bincount(at, h, wide * bins).reshape(wide, bins).cumsum(axis=1)
                score = lambda a, b: a * a / (b + ridge)
                gain = (score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:]))[:, : len(c)]
                pick = gain.argmax(axis=1)
                better = gain[np.arange(wide), pick] > best + 1e-9
                best[better] = gain[np.arange(wide), pick][better]
                f[first : first + wide][better] = k
                t[first : first + wide][better] = c[pick[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        value += leaf[at]
        features.append(f)
        thresholds.append(t)
        leaves.append(leaf)
    return Trees(base, np.array(features).reshape(-1, inner), np.array(thresholds).reshape(-1, inner), np.array(leaves).reshape(-1, inner + 1))


def _pool(values: np.ndarray, sums: np.ndarray, rows: np.ndarray) -> list[list[float]]:
    """[from, sum, rows] of rising shares, by pooling adjacent violators of rising values."""
    blocks: list[list[float]] = []
    for v, s, n in zip(values, sums, rows, strict=True):
        blocks.append([v, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, s2, n2 = blocks.pop()
            blocks[-1][1] += s2
            blocks[-1][2] += n2
    return blocks


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (from, share) by pooling adjacent violators.

    Each pooled step's share leans to one half by one row, so that none is certain; where that makes a step lower than the one before, they are pooled again.
    """
    values, at = np.unique(raw, return_inverse=True)
    first = _pool(values, np.bincount(at, y, len(values)), np.bincount(at, minlength=len(values)))
    again = _pool(*(np.array([b[k] for b in first]) + add for k, add in ((0, 0.0), (1, 0.5), (2, 1.0)))) if first else []
    return np.array([b[0] for b in again]), np.array([b[1] / b[2] for b in again])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    steps: np.ndarray
    shares: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The calibrated share, and within a step by up to 0.0001 more for a higher uncalibrated score; it never falls as that rises."""
        raw = self.trees.raw(x)
        if not len(self.steps):
            return 1 / (1 + np.exp(-raw))
        at = np.maximum(np.searchsorted(self.steps, raw, side="right") - 1, 0)
        return np.clip(self.shares[at] + 1e-4 * (1 / (1 + np.exp(-raw)) - 0.5), 0, 1)


def lexicon_of(clean: np.ndarray, bad: np.ndarray, names: np.ndarray, n_clean: float, n_bad: float) -> dict[str, float]:
    """Log odds of the terms that toxic texts hold beyond chance, of the numbers of clean and toxic texts with each."""
    expected = (clean + bad) * n_bad / max(1.0, n_clean + n_bad)
    odds = np.log(((bad + 0.5) / (n_bad + 1)) / ((clean + 0.5) / (n_clean + 1)))
    keep = (bad >= 3) & ((bad - expected) / np.sqrt(np.maximum(expected, 1e-9)) >= LEAST_Z) & (odds >= WEAK)
    return dict(zip(names[keep].tolist(), odds[keep].astype(float).tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from at most max_labelled texts with a non-null label; an id with several labels counts as toxic if one says so.

    Of an id with several texts the first in order counts, so that the bound holds. The lexicon is the terms and stems that toxic texts of the
    sample hold beyond chance. A null or empty text teaches as one without words; of a very long one all words count; labels of ids without a text,
    and null ids, teach nothing; ties of the draw go by the id's hash. The bound is on texts, not on their bytes: what reaches the driver is their features and terms. The calibration is fitted to the output of trees for texts of a fold that neither they nor their lexicon have seen.
    """
    drawn = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity sample"))
    sample = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(drawn).limit(max_labelled)
    )
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity fold")), F.lit(FOLDS)).cast("int")
    texts = cut(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("fold", fold))

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in small(frames):
            found: dict[str, list[int]] = defaultdict(lambda: [0] * (2 * FOLDS))
            for y, k, t in zip(frame["y"], frame["fold"], frame["text"], strict=True):
                own = {plain(x) for x in set(tokens(t))}
                for term in {k for w in own if w for k in terms(w)} | {""}:
                    found[term][2 * k + int(y > 0)] += 1
            yield pd.DataFrame([(k, *v) for k, v in found.items()], columns=["term", *counters])

    counters = [f"{kind}{k}" for k in range(FOLDS) for kind in ("clean", "bad")]
    counted = texts.select("y", "fold", "text").mapInPandas(count, f"term string, {', '.join(f'{c} long' for c in counters)}").groupBy("term").agg(*[F.sum(c).alias(c) for c in counters])
    bad_ones = sum((F.col(f"bad{k}") for k in range(FOLDS)), F.lit(0))
    rows = counted.where((bad_ones >= 3) | (F.col("term") == "")).toPandas()
    figures = rows[counters].to_numpy(float).reshape(len(rows), FOLDS, 2)
    names = rows["term"].to_numpy()

    def lexicon(folds: list[int]) -> dict[str, float]:
        n = figures[:, folds].sum(axis=1)
        total = n[names == ""].sum(axis=0)
        at = names != ""
        return lexicon_of(n[at, 0], n[at, 1], names[at], *total)

    others = [[j for j in range(FOLDS) if j != k] for k in range(FOLDS)]
    lexicons = [*map(lexicon, others), lexicon(list(range(FOLDS)))]

    def dense(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(lexicons)
        for frame in small(frames):
            x = features.batch(list(frame["text"])).reshape(len(frame), -1)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype(str), "fold": frame["fold"], "y": frame["y"] > 0, "x": list(x)})

    got = texts.mapInPandas(dense, "doc_id string, fold int, y boolean, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), FOLDS + 1, len(NAMES))
    y, own = got["y"].to_numpy(float), got["fold"].to_numpy()
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        unseen[own == k] = boost(x[own != k, k], y[own != k]).raw(x[own == k, k])
    return Model(lexicons[-1], boost(x[:, -1], y), *isotonic(unseen, y))


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), a row for each row of df.

    A null text counts as empty and is scored by its features, all zero, as any other; of a very long one all tokens count. Repeated rows
    and ties get equal scores. Without any label the score is one half. An empty table gives an empty one. Other columns of df, whatever
    their names, are not carried.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features([held.value.lexicon])
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": held.value.scores(features.batch(list(frame["text"]))[:, 0])})

    return by_text(df, doc_id, text, work, "score double")


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """fit() on the labels that are not held out."""
    return fit(docs, labels.where(crc_fold(F.col("doc_id")) != 1), max_labelled=max_labelled)
