"""Substring search by an index, and lookups that read on until there is enough, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from partloom.operators import search as S, substrings
from partloom.operators.lineage import own_folder


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(1)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choices("abAB%_ 1é", k=rng.randint(0, 9)))
    rows = [(i, text(), text()) for i in range(400)] + [(1000 + i, "Hot Number 12", None) for i in range(300)] + [(None, "abc", "abc"), (7, "second of seven", "x")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    return rows, df, substrings.Index(spark, own_folder(spark, "index"), {"t": (df, "id", ["a", "b"])})


def test_index_finds_what_a_scan_finds(words):
    rows, df, index = words
    for q in ("a", "ab", "abb", "abab", "AB1", "%", "_a", "é", "t n", "hot number", "number 12", "umber 1", "nothing here", " ab ", "second of seven"):
        want = sorted((r[0], r[1], r[2]) for r in rows if r[0] is not None and any(c is not None and q.strip().lower() in c.lower() for c in r[1:]))
        assert sorted(map(tuple, index.search("t", q).collect())) == want, q
    assert index.search("t", "ab", ["b"]).count() == sum(r[0] is not None and "ab" in (r[2] or "").lower() for r in rows)
    assert index.search("t", "  ").count() == len(rows)


def test_only_pieces_of_the_query_are_read(spark, words):
    _, _, index = words
    plan = lambda q: substrings.texts_with(spark, index.folder, q, ["t.a"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,num)" in plan("number 12") and "EqualTo(gram,ber)" in plan("number 12") and "StringStartsWith(gram,ab)" in plan("ab")
    assert substrings.cover("number 12") == [0, 3, 6] and substrings.cover("numb") == [0, 1]


def test_a_blank_search_of_the_index_is_an_error(spark, words):
    with pytest.raises(ValueError):
        substrings.find(spark, words[2].folder, " ", ["t.a"])


def plain_accumulated(stages, limit):
    found = {}

    def read(n, rows):
        for i, *ends in sorted(rows):
            for e in ends:
                if e is not None and e not in found:
                    found[e] = n
            if len(found) >= limit:
                return

    for n, rows in enumerate(stages[:-1]):
        if len(found) < limit:
            read(n, rows)
    if len(found) < limit:
        read(len(stages) - 1, sorted(stages[-1])[: 3 * (limit - len(found))])
    return [(e, n, k) for k, (e, n) in enumerate(found.items(), 1)]


@pytest.mark.parametrize("seed", range(4))
def test_accumulation_stops_at_the_limit(spark, seed):
    rng = random.Random(seed)
    end = lambda: rng.choice([None, rng.randrange(30)])
    stages = [[(k * 100 + i, end(), end()) for i in range(n)] for k, n in enumerate(rng.sample(range(0, 25), 3))]
    frames = [spark.createDataFrame(s, "id long, a long, b long") for s in stages]
    for limit in (1, 2, 5, 11, 100):
        got = sorted(map(tuple, S.accumulated(frames, ["a", "b"], "id", limit).collect()), key=lambda r: r[2])
        assert got == plain_accumulated(stages, limit), limit


def test_tiers_need_no_action(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (2, "b", "abc"), (3, None, "abcd")], "id int, n string, deep string")
    hits = lambda q: sorted((r.id, r.tier) for r in S.tiered(df, F.col("n").contains(q), F.col("deep").contains(q), q).collect())
    assert hits("abc") == [(1, 0)] and hits("abcd") == [(3, 1)] and hits("d") == [] and hits("b") == [(1, 0), (2, 0)]
