"""One key that holds most rows, keys that do not stay, and sessions and folders that are left as they were."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partloom.llm import common, embeddings, jaccard, langid, linededup, queries, sharding, simhash
from test_near_copies import SHAPE


@pytest.fixture
def few_rows(monkeypatch):
    """Keys of over 10 rows count as hot."""
    monkeypatch.setattr(common, "ROWS_PER_TASK", 10)


def test_rows_alike_are_numbered_without_gaps(spark, few_rows):
    rows = [(i % 5, f"text {i}") for i in range(50)] + [(7, "hot")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard(df, sharding.topology(3), buckets=16).collect()
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len(got) == 350


def test_only_the_hot_bucket_is_cut(spark, few_rows):
    df = spark.createDataFrame([(1, i // 10) for i in range(90)] + [(1, 99)] * 400, "g int, b int")
    got = common.gapless(df, ["g"], F.col("b"), [F.col("b")], "at").collect()
    assert sorted(r["at"] for r in got) == list(range(490)) and all((r["at"] >= 90) == (r["b"] == 99) for r in got)


def test_line_dedup_of_a_repeated_row(spark, few_rows):
    run = "\n".join(" ".join(f"w{i}{j}" for j in range(9)) for i in range(8))
    rows = [(1, run)] * 200 + [(2, "intro\n" + run)] * 3 + [(None, run), (3, None), (3, None)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_deleted, r.text))
    assert by == {None: {(0, run)}, 1: {(8, "")}, 2: {(8, "intro")}, 3: {(0, None)}}


def test_simhash_bucket_that_is_split(spark, few_rows, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 8)
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in prints]
    got = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    near = [x for (x,) in signed if any(x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= 3 for (y,) in signed)]
    assert {r.node for r in got} == set(near)


def test_embeddings_copies_and_far_scales(spark, few_rows):
    v, w = [1.0, 2.0, 2.0], [1.0, 2.0, 2.1]
    rows = [(5, v, 1)] * 100 + [(6, v, 1), (7, [x * 1e200 for x in w], 1), (8, [x * 1e-200 for x in w], 1), (9, [5e-324, 0.0, 0.0], 1), (10, [1e308, 0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {5: (3, 5), 6: (3, 5), 7: (3, 5), 8: (3, 5), 9: (1, 9), 10: (1, 9)}


def test_near_copies_of_one_root(spark, few_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(6)
    base = [f"word{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(80)] + [(100 + i, " ".join(base)) for i in range(40)] + [(500, "another text of a few words")]
    got = {r.key: r.component for r in jaccard.near_duplicates(spark.createDataFrame(rows, "key long, text string"), "key").collect()}
    assert len({c for k, c in got.items() if k < 500}) == 1 and len(set(got.values())) == 2


@pytest.mark.parametrize("broadcast", [10_000, 10])
def test_any_number_of_languages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(langid, "BROADCAST_LANGUAGES", broadcast)
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    docs = spark.createDataFrame([(i, f"{name(i)}xyz {name(i)}uvw", f"lang{i:04d}") for i in range(1500)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.langs) == 1500
    got = langid.identify(docs.where("doc_id < 40"), model).collect()
    assert [r.lang_pred for r in got] == [f"lang{r.doc_id:04d}" for r in got]


def documents(spark, path):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for j in range(3):
            rows.append((1000 - len(rows), " ".join(words[:-1] + [f"e{j}"]), "en", "s", 1))
    for k in range(6):  # six files
        spark.createDataFrame(rows[k::6], SHAPE).coalesce(1).write.mode("append").parquet(path)
    return {r[0] for r in rows[2::3]}


@pytest.fixture
def turning(spark, monkeypatch):
    """The parallelism changes between the scans, as where executors come and go."""
    real = jaccard.cut

    def cut(df):
        out = real(df)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
        return out

    monkeypatch.setattr(jaccard, "cut", cut)
    yield
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_stage_keeps_the_same_rows_however_scans_are_cut(spark, tmp_path, turning):
    want = documents(spark, str(tmp_path / "docs"))
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_keys_that_do_not_stay_are_an_error(spark, tmp_path, turning):
    documents(spark, str(tmp_path / "docs"))
    keyed = spark.read.parquet(str(tmp_path / "docs")).withColumn("key", F.monotonically_increasing_id())
    with pytest.raises(Exception, match="another row"):
        jaccard.near_duplicates(keyed, "key").count()


def test_sessions_and_folders_are_left_as_they_were(spark, tmp_path):
    documents(spark, str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(9)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(900, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    shared = Path(common.shared_folder(spark).removeprefix("file:"))
    before, there = dict(spark.conf.getAll), {p.name for p in shared.iterdir()}
    for name in ("op9_embeddings", "op12_topk", "op13_audit"):
        queries.queries()[name](spark, str(tmp_path)).count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() >= 0 and dict(spark.conf.getAll) == before
    left = {p for p in shared.iterdir() if p.name not in there and p.name.startswith(("pipeline-", "audit-"))}
    assert [q.name for p in left for q in p.iterdir()] == ["packing"]
