"""Null ids and texts, ids beyond doubles, texts of a megabyte, repeated rows, clashing columns and empty tables, for every operator and stage."""

import re

import pytest

import corpus_pipeline
from partloom.llm import embeddings, jaccard, langid, linededup, packing, pieces, quality, sharding, simhash, toxicity, urls
from partloom.llm.queries import PIECES, WORD_BPE, tokenizer_path

BIG = 2**60 + 1
LONG = "\n".join(" ".join(f"word{i * 16 + j}" for j in range(16)) for i in range(9000))
ROWS = [(BIG, "the first of many words", "en"), (None, "the first of many words", None), (BIG + 2, None, "en"), (4, "", "de"), (5, LONG, "en"), (6, "der zweite und die dritte", "de"), (6, "der zweite und die dritte", "de"), (None, None, None)]
CLASH = "__bucket long, __at int, __start int, _n int, _salt int, _fit string, _id long, _th long, rep int, g int, row int, d int, key string, component int"


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 1_000_000
    made = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for c in CLASH.split(", "):
        name, kind = c.split()
        made = made.selectExpr("*", f"cast(7 as {kind}) as {name}")
    return made


def ids(rows, name="doc_id"):
    return sorted((r[name] for r in rows), key=repr)


WANT = sorted((r[0] for r in ROWS), key=repr)


def test_models_and_texts(spark, docs):
    model = langid.fit(docs)
    for df in (docs, docs.where("false")):
        n, want = (len(ROWS), WANT) if df is docs else (0, [])
        got = langid.identify(df, model).collect()
        assert len(got) == n and ids(got) == want
        scored = toxicity.score(df, toxicity.fit(docs, spark.createDataFrame([(5, 1), (4, 0)], "doc_id long, toxic int"))).collect()
        assert ids(scored) == want and all(0 <= r.score <= 1 for r in scored)
        assert ids(pieces.digest(df, tokenizer_path(PIECES)).collect()) == want
        back = pieces.decode(pieces.encode(df, tokenizer_path(PIECES)), tokenizer_path(PIECES)).collect()
        assert sorted((r.decoded or "" for r in back), key=len) == sorted((r[1] or "" for r in ROWS), key=len)[: n or 0]
    kept = langid.keep_pure(docs, model).collect()
    assert ids(kept) == sorted([BIG, None, 5, 6, 6], key=repr) and kept[0]["_salt"] == 7


def test_packing_and_sharding(spark, docs):
    packed = packing.pack(docs, tokenizer_path(WORD_BPE)).collect()
    assert sorted({r.doc_id for r in packed}, key=repr) == sorted(set(WANT), key=repr)
    assert sum(r.piece == 0 for r in packed) == len(ROWS) and max(r.piece for r in packed) > 60
    offsets = {}
    for r in packed:
        offsets.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in offsets.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    shards = sharding.shard(docs, sharding.topology(40), sharding.topology(41)).collect()
    assert ids(shards) == WANT and {r["__bucket"] for r in shards} == {7} and {r["_n"] for r in shards} == {7}
    assert max(r.size for r in shards) == len(LONG.encode()) + 16


def test_groups(spark, docs):
    found = simhash.near_duplicates(docs).collect()
    assert ids(found) == WANT
    of = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert of[BIG] == BIG and of[4] == of[BIG + 2] == 4
    out = linededup.dedup_lines(docs.unionByName(docs.where("doc_id = 5").selectExpr("cast(99 as bigint) as doc_id", "* except (doc_id)"))).collect()
    assert len(out) == len(ROWS) + 1 and out[0]["_id"] == 7
    text = {r.doc_id: r.text for r in out if r.doc_id in (5, 99)}
    assert text[5] == LONG and text[99] == ""
    keyed = docs.selectExpr("* except (key)", "monotonically_increasing_id() as key")
    comps = {r.key: r.component for r in jaccard.near_duplicates(keyed, "key").collect()}
    assert len(comps) == len(ROWS) and len(set(comps.values())) == 4


def test_native_operators_keep_columns_and_run_no_python(spark, docs):
    judged = quality.quality(docs)
    assert ids(judged.collect()) == WANT
    pages = spark.createDataFrame([(1, "http://A.org/x", '<a href="http://B.com/">' * 2 + '<a href="http://b.com/">', 3), (2, None, None, 3), (3, "http://b.com/q", "x" * 1_000_000, 3)], "page_id long, url string, html string, _fit int")
    rows = urls.judge(pages)
    assert [r["_fit"] for r in rows.collect()] == [3, 3, 3]
    links = urls.host_links(pages.selectExpr("*", "case page_id when 1 then 'a.org' else 'b.com' end as host"), "host", "html").collect()
    assert [(r.src, r.dst, r.n) for r in links] == [("a.org", "b.com", 1)]
    for df in (judged, rows):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_embeddings_of_one_id_and_large_ids(spark):
    rows = [(BIG, [1.0, 0.0], 1), (BIG + 1, [0.99, 0.05], 1), (7, [1.0, 0.01], 1), (7, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (8, None, 1), (9, [1.0, 0.0], None)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    n = {(r.vec_id, r.n_links) for r in got}
    assert {(BIG, 2), (BIG + 1, 2), (7, 2), (7, 0), (8, 0), (9, 0), (None, 0)} == n
    assert {r.vec_id: r.component_id for r in got}[BIG] == 7


def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path):
    text = "\n".join(" ".join(f"{w}{k}{j}" for j, w in enumerate(["the", "of", "and", "a", "to", "in", "is", "it"])) + " the of and" for k in range(6))
    rows = [(1, text, "en"), (1, text, "en"), (None, text, "en"), (None, None, None), (3, "", "en"), (4, LONG, "en"), (5, text.replace("the00", "the99"), None)]
    for name, some in (("rows", rows), ("none", [])):
        frame = spark.createDataFrame([(i, t, g, None, None) for i, t, g in some], "doc_id long, text string, lang string, source string, n_chars long")
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        # A null id comes first among equal lines, so that the rows of 1 lose all, and of 5 the first line is left.
        assert sorted({r.doc_id for r in out}, key=repr) == ([5, None] if some else [])
