"""Near-duplicates, line dedup, components and the pipeline against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from pyspark.sql import functions as F

from partloom.llm import common, embeddings, linededup, simhash
from partloom.llm import components as components_module
from partloom.llm.components import components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("per_task", [10**6, 0])
def test_components(spark, monkeypatch, per_task):
    """With one exchange a step, and with minima that are combined first."""
    monkeypatch.setattr(components_module, "ROWS_PER_TASK", per_task)
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    u = Union()
    for a, b in pairs:
        u.join(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: u.find(x) for x in {y for p in pairs if p[0] != p[1] for y in p}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_are_those_of_the_contract():
    rng = random.Random(2)
    for t in [None, "", "a", "A b", "É é\x0bÀ\x1c b c d", *(" ".join(rng.choices(["Ab", "c", "ß", "日"], k=rng.randint(1, 40))) for _ in range(30))]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_near_duplicates(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [[word() for _ in range(150)] for _ in range(25)]
    texts = [None, "", "one", "ONE"]
    for b in base:
        for _ in range(rng.randint(1, 12)):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    rng.shuffle(texts)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "one", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    fp = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    u = Union()
    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 3:
                u.join(i, j)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (2**64 - 1), r.component_id) == (fp[r.doc_id], u.find(r.doc_id))
        else:
            assert r.component_id == u.find(texts.index("one"))
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_hot_buckets_are_split(spark, monkeypatch):
    """Many fingerprints around one centre and in one block, with buckets of a few rows."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 40)
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    block = {(centre & 0xFFFF) | rng.getrandbits(48) << 16 for _ in range(150)}
    fps = sorted(near | block)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    u, want = Union(), Union()
    for a, b in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        u.join(a, b)
    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                want.join(a, b)
    assert {f: u.find(f) for f in signed} == {f: want.find(f) for f in signed}


def plain_links(rows, least):
    seen = {}
    for v, e, label in rows:
        x = None if e is None or any(c is None for c in e) else np.array(e, float)
        if v is not None and label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            seen[v] = (label, x / np.linalg.norm(x))
    n, u = defaultdict(int), Union()
    for a in seen:
        for b in seen:
            if a != b and seen[a][0] == seen[b][0] and len(seen[a][1]) == len(seen[b][1]) and seen[a][1] @ seen[b][1] >= least:
                n[a] += 1
                u.join(a, b)
    return n, u


def vectors(seed, groups, each, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(each):
            out.append(((centre + rng.normal(0, 0.12, dim)).astype(np.float32).tolist(), g % 3))
    return out


def test_embeddings(spark, monkeypatch):
    made = vectors(5, 12, 14)
    rows = [(i, e, label) for i, (e, label) in enumerate(made)]
    rows += [(500 + i, made[0][0], made[0][1]) for i in range(5)] + [rows[3], rows[3]]
    rows += [(600, None, 1), (601, [0.0] * 24, 1), (602, [float("nan")] * 24, 1), (603, made[0][0], None), (None, made[0][0], made[0][1]), (604, [None] * 24, 1), (605, [], 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1), (608, [float("inf")] * 24, 1)]
    n, u = plain_links(rows, 0.93)
    assert sum(n.values()) > 300
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    for block, bucket in ((embeddings.BLOCK, embeddings.BUCKET), (20, 8)):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        monkeypatch.setattr(embeddings, "BUCKET", bucket)
        got = embeddings.near_duplicates(df).collect()
        assert len(got) == len(rows)
        found = sum(r.n_links for r in {r.vec_id: r for r in got}.values())
        assert 0.99 * sum(n.values()) <= found <= sum(n.values())
        for r in got:
            if r.vec_id is None:
                assert (r.n_links, r.component_id, r.kept) == (0, None, False)
            else:
                assert r.n_links <= n[r.vec_id] and r.kept == (r.component_id == r.vec_id)
        same = np.mean([r.component_id == u.find(r.vec_id) for r in got if r.vec_id is not None])
        assert same >= 0.98
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_embedding_recall_and_counts_on_planted_vectors(spark, monkeypatch):
    """64 dimensions around the threshold, in buckets of 16: all links but few, none false, and counts that agree with the components."""
    monkeypatch.setattr(embeddings, "BUCKET", 16)
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([(c + rng.normal(0, 0.27, (15, 64))) for c in centres] + [rng.normal(size=(600, 64))]).astype(np.float32)
    label = np.arange(len(x)) // 15 % 2
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (y @ y.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df).orderBy("vec_id").toPandas()
    n = got["n_links"].to_numpy()
    assert (n <= link.sum(axis=1)).all() and n.sum() >= 0.999 * link.sum() > 1000
    assert ((n > 0) == (got.groupby("component_id")["vec_id"].transform("size") > 1).to_numpy()).all()


def test_hot_keys_are_dealt_to_several_tasks(spark):
    rows = spark.createDataFrame([(1 if i < 90 else i, i) for i in range(100)] + [(None, 7)], "k int, v int")
    facts = rows.where("k IS NOT NULL").groupBy("k").count().withColumn("fact", F.col("k") * 10)
    got = common.join_spread(rows, facts, ["k"], "count", ["v"], "left", per_task=20)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(k, v, k and 10 * k) for k, v in map(tuple, rows.collect())], key=repr)
    assert got.columns == ["k", "v", "fact"]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(0, 0.25, (200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor, q, scale = embeddings.encode(x, 1)
    body = [a.tobytes() + b.tobytes() + c.tobytes() + d.tobytes() for a, b, c, d in zip(code, factor, scale, q[:, ::2] << 4 | q[:, 1::2], strict=True)]
    c = embeddings._Codes(body, 64, 1)
    i, j = np.arange(200), np.arange(200, 400)
    true = (x[i] * x[j]).sum(axis=1)
    estimate = np.einsum("nd,nd->n", c.b[i], c.y[j]) / c.factor[i]
    assert abs((estimate - true).mean()) < 0.02
    assert c.hopeful(i, j, 0.93)[true >= 0.93].all() and c.table(i, j, 0.93).diagonal()[true >= 0.93].all()


def plain_lines(docs, least=linededup.MIN_WORDS):
    """Lines of runs of `least` words or more that occur earlier, by comparing all pairs of starts."""
    seqs = sorted((i, [(p, x.strip(" \t\n\x0b\x0c\r"), len(x.split())) for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]) for i, t in docs)
    at, gone = defaultdict(list), defaultdict(set)
    for d, (_, s) in enumerate(seqs):
        for k, (_, line, _) in enumerate(s):
            at[line].append((d, k))
    for places in at.values():
        for b in range(len(places)):
            for a in range(b):
                (d1, k1), (d2, k2) = places[a], places[b]
                s1, s2 = seqs[d1][1], seqs[d2][1]
                n = words = 0
                while k1 + n < len(s1) and k2 + n < len(s2) and s1[k1 + n][1] == s2[k2 + n][1]:
                    words, n = words + s2[k2 + n][2], n + 1
                if words >= least:
                    gone[seqs[d2][0]].update(range(s2[k2][0], s2[k2 + n - 1][0] + 1))
    return gone


def test_suffix_array_is_in_order_with_its_first_places(spark):
    """Names of suffixes rise with their lines, equal ones share a name, and neighbours meet in the intervals of their common lines."""
    rng = random.Random(31)
    docs = [(i, "\n".join(f"line {c} of many" for c in rng.choices("abc", k=rng.randint(1, 12)))) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    suffixes, array, depth = linededup.suffix_array(df, "doc_id", "text", 12)
    text = dict(docs)
    assert depth == 4  # three lines of four words hold twelve, after the first
    rank = {}
    for r in suffixes.collect():
        rank.setdefault(r["rank"], set()).add((tuple(text[r.doc_id].split("\n")[r.lines[0] :]), r.doc_id, r.k))
    line = {tuple(text[r.doc_id].split("\n")[r.lines[0]] for r in [r])[0]: r.ids[0] for r in suffixes.collect()}
    order = [min([line[x] for x in s[0][:4]] for s in rank[k]) for k in sorted(rank)]
    assert order == sorted(order) and all(len({s[0][:4] for s in members}) == 1 for members in rank.values())
    for r in array.collect():
        assert (r["first"].doc_id, r["first"].k) == min(s[1:] for s in rank[r["rank"]]) and r.n == len(rank[r["rank"]])


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_intervals_across_ranges(parts):
    """Ranges that are swept apart give the intervals of one sweep."""
    import pandas as pd

    rng = random.Random(parts)
    ids = sorted({tuple(rng.choices((1, 2), k=rng.randint(2, 6))) for _ in range(60)})
    frame = pd.DataFrame({"rank": range(len(ids)), "ids": [np.array(x) for x in ids], "least": 2, "n": 1, "doc_id": "d", "th": 0, "k": 0})
    cuts = sorted(rng.sample(range(1, len(ids)), parts - 1))
    ranges = [frame.iloc[a:b].assign(part=p) for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ids)]))]
    ends = [dict(zip(e.columns, e.iloc[0])) for x in ranges for e in linededup._ends(6)(iter([x]))]
    carried = linededup._carried(ends, 6)
    got = {(r, m): i for x in ranges for e in linededup._intervals(carried)(iter([x.iloc[:2], x.iloc[2:]])) for r, m, i in zip(e["rank"], e["m"], e["interval"])}
    assert got == {(i, m): next(j for j, y in enumerate(ids) if y[:m] == x[:m]) for i, x in enumerate(ids) for m in range(2, len(x) + 1)}


def test_line_dedup(spark):
    rng = random.Random(8)
    pool = [" ".join(f"l{k}w{i}" for i in range(rng.choice([1, 4, 12, 20, 30, 55]))) for k in range(30)]
    docs = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 5))] + [f"own {i}"]
        k = rng.randrange(20)
        lines[rng.randint(0, len(lines)) :] = pool[k : k + rng.randint(1, 9)]
        docs.append((i, "\n".join(rng.choice([x, x + " ", "\n" + x]) for x in lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[0][1]), (104, "\n".join(f"one{i}" for i in range(60))), (105, "\n".join(f"one{i}" for i in range(60)))]
    rows = [(i, t, "x") for i, t in docs] + [(5, docs[5][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, dk string")
    want = plain_lines(docs)
    got = linededup.dedup_lines(df).collect()
    assert len(got) == len(rows) and got[0].dk == "x"
    text = dict(docs)
    for r in got:
        t = text[r.doc_id]
        if t is None:
            assert r.text is None and r.n_deleted == 0
            continue
        assert r.text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(r.doc_id, ())), r.doc_id
        assert r.n_deleted == len(want.get(r.doc_id, ()))
    assert sum(map(len, want.values())) > 50 and next(r for r in got if r.doc_id == 105).text == ""
    assert linededup.dedup_lines(df.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage keeps what it should of a small corpus with planted cases."""
    rng = random.Random(11)
    stem = lambda: "".join(rng.choices(["th", "er", "in", "an", "re", "on", "st"], k=3))
    text = lambda n: "\n".join(" ".join([*(stem() for _ in range(12)), "the", "of", "and"]) for _ in range(n))
    clean = [text(rng.randint(4, 9)) for _ in range(40)]
    passage = text(5)
    near = clean[0].split(" ")
    docs = [*clean, clean[1], "buy now", "## " * 60, f"{passage}\n{text(3)}", f"{text(4)}\n{passage}", "7 8 9 " * 30]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    frame, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in frame.select("doc_id").distinct().collect()}
        if name != "packing":
            assert tuple(frame.columns) == corpus_pipeline.COLUMNS
    assert near and kept["quality"] == set(range(41)) | {43, 44}
    assert kept["language"] == kept["quality"] and kept["line_dedup"] == kept["quality"] - {40}
    after = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()}
    assert passage in after[43] and after[44] == docs[44][: -len(passage) - 1] and all(after[i] == clean[i] for i in range(40))
    assert kept["near_duplicates"] == kept["line_dedup"] == kept["packing"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} == kept["packing"]
