"""Quality rules, sharding and URL filters against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from partloom.llm import quality, sharding, urls

WORDS = "the of and Fürst a|b x# go.\tnow".split(" ")


def plain_quality(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    hit = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    n = len(w)
    base = n < 20 or 100 * len(hit) > 30 * n
    stops = sum(x.lower() in quality.STOP_WORDS for x in w)
    chars, symbols, dup = sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines))
    ok = not base and 2 <= chars / n <= 16 and symbols / n <= 0.25 and stops / n >= 0.03 and dup / max(1, len(lines)) <= 0.5
    return (n, chars, symbols, dup, len(hit), base, ok)


def measured(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = quality.quality(df).select("doc_id", *[f"quality.{n}" for n in names]).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in got]


def test_quality_edges(spark):
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    texts = [None, "", " \n\t\x0b", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x y " * 40, long, "l one\nl one\n\nl two", "the und le " * 9 + "end"]
    assert measured(spark, texts) == [plain_quality(t) for t in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*WORDS, "\n", " ", "é", "&"]), max_size=60).map(" ".join), min_size=1, max_size=8))
def test_quality_matches(spark, texts):
    assert measured(spark, texts) == [plain_quality(t) for t in texts]


def test_quality_keeps_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1, 2)], "text string, n_words int, quality int")
    row = quality.quality(df).first()
    assert row.n_words == 1 and row.quality.n_words == 1
    assert quality.quality(df.where("false")).count() == 0


def plain_place(key, leaves):
    def draw(options):
        u = lambda name: (int(md5(f"{key}|{name}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        return min(options, key=lambda o: (-math.log(u(o[0])) / o[2], o[1]))[1] if len(options) > 1 else options[0][1]

    tree = defaultdict(lambda: defaultdict(list))
    for x in leaves:
        tree[x.region][x.rack].append(x)
    weigh = lambda xs: sum(x.weight for x in xs)
    r = draw([(str(r), r, sum(map(weigh, racks.values()))) for r, racks in tree.items()])
    k = draw([(f"{r}/{k}", k, weigh(v)) for k, v in tree[r].items()])
    return draw([(f"{r}/{k}/{x.shard}", x.shard, x.weight) for x in tree[r][k]])


def test_sharding(spark):
    df = spark.createDataFrame([(i, "é" * (i % 5) or None) for i in range(600)] + [(None, ""), (7, "again"), (7, "again")], "doc_id long, text string")
    leaves, grown = sharding.topology(40), sharding.topology(41)
    rows = sharding.shard(df.withColumn("shard", F.lit("clash")).withColumn("_at", F.lit(1)), leaves, grown, buckets=16).collect()
    assert len(rows) == 603 and "_at" in rows[0]
    slots = defaultdict(list)
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == plain_place(key, leaves) and r.grown_shard == plain_place(key, grown)
        assert r.grown_shard in (r.shard, 40)
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(df.where("false"), leaves).count() == 0


def test_more_weight_moves_rows_only_towards_its_subtree(spark):
    leaves = sharding.topology(12, base=12, regions=3, racks=2)
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in leaves]
    at = {x.shard: (x.region, x.rack) for x in leaves}
    df = spark.range(2000).withColumn("k", F.col("id").cast("string"))
    moved = df.select(sharding.place(F.col("k"), leaves).alias("a"), sharding.place(F.col("k"), heavy).alias("b")).where("a <> b").collect()
    assert moved and all(at[r.b][0] == at[5][0] for r in moved)
    with pytest.raises(ValueError):
        sharding.place(F.lit("x"), [sharding.Leaf(0, 0, 0, 0.0)])


def test_every_growth_takes_rows_only_into_the_new_shard(spark):
    df = spark.range(1500).withColumn("k", F.col("id").cast("string"))
    for n in (40, 41, 42, 45):
        a, b = sharding.place(F.col("k"), sharding.topology(n)), sharding.place(F.col("k"), sharding.topology(n + 1))
        assert {r.b for r in df.select(a.alias("a"), b.alias("b")).where("a <> b").collect()} == {n}


LINK = '<a href="https://{}/x">'


def plain_scores(pages, rules=urls.RULES, damping=0.85, rounds=40):
    def parse(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")

    fit = {}
    for i, u, _ in pages:
        host, path = parse(u)
        hits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        fit[i] = (host, path, max(hits, key=lambda r: len(r.name), default=None))
    edges = Counter()
    for i, _, h in pages:
        for dst in {x.lower() for x in re.findall(r'href="(?:https?:)?//([^/"?#\s>]+)', h or "")}:
            if fit[i][0] and dst != fit[i][0]:
                edges[fit[i][0], dst] += 1
    score = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        links = Counter({(a, b) if kind == "trust" else (b, a): n for (a, b), n in edges.items()})
        out = Counter()
        for (a, _), n in links.items():
            out[a] += n
        seeds = Counter(h for h, _, r in fit.values() if r and r.verdict == verdict)
        total = sum(seeds.values()) or 1
        s = {h: (1 - damping) * n / total for h, n in seeds.items()}
        for _ in range(rounds):
            nxt = Counter({h: (1 - damping) * n / total for h, n in seeds.items()})
            for (a, b), n in links.items():
                nxt[b] += damping * s.get(a, 0) * n / out[a]
            s = nxt
        score[kind] = s
    verdict = {}
    for i, (host, path, r) in fit.items():
        t, d = score["trust"].get(host, 0), score["distrust"].get(host, 0)
        verdict[i] = (host, path, r and r.name, r.verdict if r else "block" if d > 0.5 * (t + d) else "allow")
    return verdict


def test_urls(spark):
    pages = [
        (1, "http://a.example.org/en/2", LINK.format("good.net") * 2), (2, "http://A.example.org/en/1x?q#f", ""), (3, "http://b.example.org/es/", None),
        (4, "https://shop.com/de/1", LINK.format("bad.net")), (5, "https://bad.net/1", LINK.format("shop.com") + LINK.format("farm.net")), (6, "https://farm.net", LINK.format("bad.net")),
        (7, "https://good.net/a?b", LINK.format("c.com")), (8, "https://c.com/fr/", ""), (9, "no scheme", "x"), (10, None, LINK.format("bad.net")),
        (11, "x://y://org/", ""), (12, "http://org", ""), (13, "http://morg/", ""), (14, "https://alone.net/de/", ""), (14, "https://alone.net/de/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("trust", F.lit(3)).withColumn("host", F.lit("clash"))
    rows = urls.judge(df).collect()
    want = plain_scores(pages)
    assert len(rows) == len(pages) and rows[0].trust == 3
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == want
    assert want[5][3] == want[6][3] == "block" and want[7][3] == "allow" and want[14][3] == "allow"
    assert urls.judge(df.where("false")).count() == 0


def test_native_operators_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
