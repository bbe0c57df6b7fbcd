"""Near-duplicates by five-word shingles, and the pipeline's stage, against all pairs."""

import random

import corpus_pipeline
from partloom.llm import jaccard
from test_groups import Union

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, path, rows):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SHAPE).write.parquet(str(path))
    return corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(path)), "").select("doc_id", "text").collect()


def plain_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [None, "", "one", "ONE", "one two"]
    for n in [60] + [3] * 20:  # a group over SMALL, and small ones
        base = [word() for _ in range(200)]
        for _ in range(n):
            c = list(base)
            for _ in range(rng.randint(0, 6)):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    rng.shuffle(texts)
    u = Union()
    sets = [plain_set(t) for t in texts]
    for i, a in enumerate(sets):
        u.find(i)
        for j in range(i):
            if a == sets[j] or a | sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                u.join(i, j)
    return texts, u


def test_stage_finds_near_copies_at_four_fifths(spark, tmp_path):
    texts, u = corpus()
    assert {r.doc_id for r in stage(spark, tmp_path / "docs", enumerate(texts))} == {u.find(i) for i in range(len(texts))}


def test_components_of_shingle_sets(spark):
    texts, u = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    component = {r.k: r.component for r in jaccard.near_duplicates(df, "k").collect()}
    first = {}
    for k in range(len(texts)):
        first.setdefault(component[k], k)
    assert {k: first[component[k]] for k in component} == {k: u.find(k) for k in component}
    assert jaccard.near_duplicates(df.where("false"), "k").count() == 0


def test_stage_keeps_one_row_of_repeated_rows_and_null_ids(spark, tmp_path):
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    a, b, c, d = ([word() for _ in range(120)] for _ in range(4))
    near = [*a[:60], word(), *a[61:]]
    text = " ".join
    rows = [(1, text(a)), (1, text(a)), (1, text(a)), (None, text(near)), (None, text(b)), (None, text(c)), (None, text(c)), (2, text(d)), (3, text(d)), (2, text(d))]
    got = stage(spark, tmp_path / "docs", rows)
    assert sorted(map(tuple, got), key=repr) == sorted([(1, text(a)), (None, text(b)), (None, text(c)), (2, text(d))], key=repr)
    assert stage(spark, tmp_path / "none", []) == []
