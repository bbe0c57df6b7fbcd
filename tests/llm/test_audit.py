"""The filter audit against every order applied row by row."""

import re
from itertools import permutations

from partloom.llm import audit


def plain(docs, labels):
    first, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        if q == 1:
            good.add(i)
        if t == 1:
            toxic.add(i)

    def fails(i, text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A"} if len(w) < 100 else set()
        out |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        out |= {"D"} if re.search("[#$%&*|]", text) else set()
        return out | ({"E"} if i is not None and first[text] < i else set())

    rows = [(part or "", fails(i, text), i is not None and i in good, i is not None and i in toxic) for i, text, part in docs]
    out, removed = [], {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[part, f] = removed.get((part, f), 0) + len(hit)
                every = sum(f in r[1] for r in mine)
                out.append((part, "".join(order), step, len(left), len(hit), every - len(hit), sum(r[1] == {f} for r in mine), sum(r[2] for r in hit), sum(r[3] for r in hit)))
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
CLASH = ("n", "good", "state", "digest", "A", "first")


def audited(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for c in CLASH:
        df = df.selectExpr("*", f"7 as {c}")
    made = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(tuple(r[c] for c in COLUMNS) for r in made.collect())


def test_audit_of_odd_rows(spark):
    clean = " ".join(f"word{i}" for i in range(120))
    long = " ".join(f"w{i % 50_000}" for i in range(150_000))
    docs = [(1, clean, "en"), (2, clean, "en"), (2, clean, "en"), (None, clean, "en"), (None, None, None), (3, None, ""), (4, "", "de"), (5, "A B C", "de"), (6, f"{clean} #", "de"),
            (7, "same " * 200, "en"), (8, "SAME " * 200, "en"), (9, long, None), (2**60 + 1, clean.upper(), "en"), (2**60 + 2, clean.upper() + "|", "x")] + [(100 + k, "hot text", "en") for k in range(60)]
    labels = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (None, 1, 1), (5, None, 1), (8, 0, 1), (100, 1, None)]
    got = audited(spark, docs, labels)
    assert got == plain(docs, labels) and len(got) == 4 * 600


def test_no_rows(spark):
    assert audited(spark, [], []) == []


def test_states_are_entered_once_and_filters_are_free(spark, monkeypatch):
    rows = spark.createDataFrame([("p", True, False, True, False, 3), ("p", True, True, False, True, 2), ("p", False, False, False, False, 5)], "part string, X boolean, Y boolean, good boolean, toxic boolean, n long")
    entered, real = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda self, *a: entered.append(1) or real(self, *a))
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost, r.toxic_lost, r.shapley) for r in audit.interactions(rows, "XY").collect()}
    assert got == {("XY", 1): (5, 5, 0, 3, 2, 8), ("XY", 2): (5, 0, 2, 0, 0, 2), ("YX", 1): (8, 2, 0, 0, 2, 2), ("YX", 2): (5, 3, 2, 3, 0, 8)}
    assert len(entered) == 4
