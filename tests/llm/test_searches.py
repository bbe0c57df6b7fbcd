"""Exact top-k search and hard negatives against all pairs in whole numbers."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partloom.llm import negatives, topk, vectors

COLUMNS = "vec_id long, embedding array<double>, label int, dim int, body int, norm int, tile int, h int"


def ints(v):
    return None if not v or any(x is None or not math.isfinite(256 * x) for x in v) else tuple(math.floor(256 * x) for x in v)


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1)


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, 2, 3, 4, 5) for i, v, g in rows], COLUMNS)


def plain_top(rows, every, k):
    some = {(i, ints(v)) for i, v, _ in rows if i is not None and v is not None and ints(v)}
    out = []
    for i, q in some:
        if i % every == 0:
            met = sorted((-dot(q, p), j) for j, p in some if j != i and len(p) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(met, 1)]
    return sorted(out)


def plain_mine(rows, every):
    some = {(i, g, ints(v)) for i, v, g in rows if i is not None and g is not None and v is not None and ints(v)}
    out = []
    for i, g, q in some:
        if i % every == 0:
            met = sorted((-dot(q, p), j, h) for j, h, p in some if len(p) == len(q) and (j, h, p) != (i, g, q))
            for s, j in [(-s, j) for s, j, h in met if h == g and j != i][:5]:
                fit = [(-t, x) for t, x, h in met if h != g and 30 * s <= -100 * t <= 90 * s][:10]
                out += [(i, j, r, x, s, t) for r, (t, x) in enumerate(fit, 1)]
    return sorted(set(out))  # vectors of one id may be told alike


def random_rows(seed, n, dim, lengths):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.choice([0.02, 0.3, 1.0]) * rng.standard_normal(dim)
        v *= lengths(rng) / np.linalg.norm(v)
        rows.append((i, v.tolist(), int(rng.integers(3))))
    return rows


ODD = [(None, [1.0, 0.5], 1), (7, None, 1), (8, [], 1), (9, [1.0, None], 1), (10, [float("nan"), 1.0], 1), (11, [float("inf"), 1.0], 1), (12, [1e307, 1.0], 1), (0, [1.0, 0.0], None),
       (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [-1.0, 0.25], 1), (2, [1.0, 0.5], 1), (3, [1.0, 0.5], 2), (4, [0.9, 0.4], 1), (5, [0.5, 0.1], 2), (6, [0.0, 0.0], 2), (20, [0.0, 0.0], 1), (1, [3.0], 1),
       (30, [3e8, 1e9], 1), (31, [1e15, 2e15], 2), (32, [-1e300, 1e300], 1), (40, [1e300, 1e300], 1), (2**60, [2e9, 1.0], 2)]


@pytest.mark.parametrize("seed,dim,lengths", [(1, 8, lambda r: 1.0), (2, 6, lambda r: float(np.exp(r.normal()))), (3, 3, lambda r: float(10 ** r.uniform(-3, 6)))])
def test_top_k(spark, monkeypatch, seed, dim, lengths):
    """Many small tiles, buckets and rounds; both ways of pruning."""
    for name, value in (("QUERIES", 8), ("BLOCK", 40), ("SEEDS", 30)):
        monkeypatch.setattr(topk, name, value)
    rows = random_rows(seed, 400, dim, lengths)
    rows += [(1000 + i, rows[5][1], 1) for i in range(60)] + [(5000, rows[5][1], 1)]
    got = sorted(map(tuple, topk.top_k(table(spark, rows), F.col("vec_id") % 20 == 0).collect()))
    assert got == plain_top(rows, 20, 5)


def test_top_k_of_odd_rows(spark):
    got = sorted(map(tuple, topk.top_k(table(spark, ODD), F.col("vec_id") % 10 == 0, 3).collect()))
    assert got == plain_top(ODD, 10, 3) and any(r[3] == 2**63 - 1 for r in got)
    assert topk.top_k(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_coordinates_keep_every_row_that_counts():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = rng.standard_normal((200, 5)) * rng.uniform(0.5, 2, (200, 1))
        x = x[np.argsort(-np.linalg.norm(x, axis=1))]
        q = rng.standard_normal(5) if rng.random() < 0.7 else np.eye(5)[rng.integers(5)] * rng.choice([-1, 1])
        q /= np.linalg.norm(q)
        norm = np.linalg.norm(x, axis=1)
        t = rng.uniform(0.05, 1)
        at = topk.Bucket(x, norm).within(q, t)
        assert set(np.flatnonzero(x @ q / norm >= t)) <= set(at)
    assert len(at) < 200


@pytest.mark.parametrize("steep", [0.0, 2.0])
def test_one_tile_with_either_pruning(steep):
    rng = np.random.default_rng(6)
    x = np.floor(rng.standard_normal((500, 4)) * 100)
    x[:40] = x[40]
    n = vectors.length(x)
    order = np.argsort(-n, kind="stable")
    frame = pd.DataFrame({"vec_id": order, "h": 0, "dim": 4, "body": [x[i].astype("<i2").tobytes() for i in order], "norm": n[order]})
    q = frame.iloc[:60].assign(theta="")
    got = topk.best(q, frame, 5, steep, 32)
    for i in q["vec_id"]:
        best = sorted(((-int(x[i] @ x[j]), j) for j in range(500) if j != i))[:5]
        mine = got[got["query_id"] == i]
        assert list(zip(-mine["score"], mine["vec_id"], strict=True)) == best


def test_bounds_hold_whatever_the_codes(spark):
    rng = np.random.default_rng(7)
    for dim in (1, 5, 8):
        x = np.floor(rng.standard_normal((300, dim)) * rng.choice([3, 200, 1e7]))
        for book in (negatives.learn(x[:50]), negatives.learn(rng.standard_normal((10, dim))), None):
            codes, r = negatives.encode(x, book)
            for q in x[:20]:
                low, high = negatives.bounds(q, float(vectors.length(q[None])[0]), codes, r, vectors.length(x), book)
                s = x @ q
                assert (low <= s).all() and (s <= high).all()
    codes, r = negatives.encode(x, negatives.learn(x))
    assert r.max() < vectors.length(x).max()


@pytest.mark.parametrize("seed,dim", [(1, 8), (2, 5)])
def test_mining(spark, monkeypatch, seed, dim):
    for name, value in (("ANCHORS", 4), ("BLOCK", 50), ("SAMPLE", 64)):
        monkeypatch.setattr(negatives, name, value)
    rows = random_rows(seed, 400, dim, lambda r: float(r.uniform(0.8, 1.2)))
    rows += [(1000 + i, rows[5][1], 1) for i in range(40)] + [(2000 + i, [0.6 * x for x in rows[5][1]], 2) for i in range(40)]
    got = sorted(map(tuple, negatives.mine(table(spark, rows), F.col("vec_id") % 25 == 0, F.col("label")).collect()))
    assert got == plain_mine(rows, 25) and len(got) > 500


def test_mining_odd_rows(spark):
    got = sorted(set(map(tuple, negatives.mine(table(spark, ODD), F.col("vec_id") % 10 == 0, F.col("label")).collect())))
    assert got == plain_mine(ODD, 10) and got
    assert negatives.mine(table(spark, []), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_products_and_first_of():
    rng = random.Random(3)
    for size in (10, 2**27, 2**31, 10**30):
        a = np.array([[float(rng.randint(-size, size)) for _ in range(3)] for _ in range(4)] + [[1.0, 2.0, 3.0]])
        n = vectors.length(a)
        want = [[dot([int(v) for v in x], [int(v) for v in y]) for y in a] for x in a]
        assert vectors.products(a, a, n, n).tolist() == want
    s, d = np.array([5, 9, 5, 5, -(2**63)]), np.array([4, 1, 2, 3, 0])
    assert vectors.first_of(s, d, 3).tolist() == [1, 2, 3] and vectors.first_of(s, d, 9).tolist() == [1, 2, 3, 0, 4]
