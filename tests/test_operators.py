"""Small cases of the table operators."""

import random
import re

from pyspark.sql import functions as F

from partloom.operators import dml as K, nested as N, relations as R, search as S
from partloom.operators.counts import ValueCounts
from partloom.operators.lineage import own_folder
from partloom.operators.publish import Store
from partloom.functions import lines as L2
from partloom.plans import commands as L
from partloom.sources import csv as C, pages as G
from partloom.streaming import ledger


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_resolution_takes_the_first_route(spark):
    units = spark.createDataFrame([(1, "A", "Y"), (2, None, "Z")], "id long, n string, yt string")
    parts = spark.createDataFrame([(9, "Y")], "id long, yt string")
    staged = spark.createDataFrame([(1, "A"), (2, "Y"), (3, "Z"), (4, "?"), (5, "")], "pos int, k string")
    got = R.resolve(staged, F.col("k"), [("unit", units, "n", "id"), ("part", parts, "yt", "id"), ("yt", units, "yt", "id")])
    assert rows(got.select("pos", "route", "target_id")) == [(1, "unit", 1), (2, "part", 9), (3, "yt", 2), (4, "none", None), (5, "none", None)]


def test_fill_down_stops_at_runs(spark):
    df = spark.createDataFrame([(1, "m", "a", "x"), (2, "m", "a", ""), (3, "m", "b", ""), (4, "m", "a", ""), (5, "m", "a", "y")], "pos int, make string, model string, year string")
    assert [r.year for r in R.fill_down(df, ["make", "model"], ["year"], "pos").orderBy("pos").collect()] == ["x", "x", "", "", "y"]


def test_prefix_semi_joins(spark):
    df = spark.createDataFrame([(1, "AB"), (1, "ABC"), (2, "A"), (3, "ABCDE")], "u int, n string")
    assert rows(R.with_prefix_of(df, df, ["u"], "n")) == [(1, "AB")]
    assert rows(R.with_prefix_anywhere(df, df, "n").select("n")) == [("A",), ("AB",), ("ABC",)]


def test_repoint_collapses_and_keeps_last_payload(spark):
    links = spark.createDataFrame([(1, 10, 5, "a"), (2, 11, 5, ""), (3, 12, 5, "b"), (4, 10, 6, "")], "id int, app int, unit int, pos string")
    mapping = spark.createDataFrame([(11, 10), (12, 10)], "loser int, survivor int")
    assert rows(K.repoint(links, mapping, "app", ["unit"], ["pos"])) == [(10, 5, 1, "b"), (10, 6, 4, None)]


def test_chase_follows_chains_and_leaves_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "z")], "old string, new string")
    assert rows(K.chase(df)) == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "x"), ("y", "y")]


def test_insert_only_and_fill_blanks(spark):
    target = spark.createDataFrame([(1, 1, "P1", "Original Name", None), (2, 2, "P2", "", 9.5)], "id long, seed_id long, number string, name string, price double")
    seed = spark.createDataFrame([(1, 1, "P1", "New", 1.0), (2, 2, "P2", "Two", 1.0), (3, None, "P3", "Three", 1.0), (4, 4, "P1", "Taken", 1.0), (5, 5, "P5", "Five", 1.0), (6, 6, "P5", "Twice", 1.0)], target.schema)
    assert rows(K.insert_only(target, seed, ["number"]).select("seed_id", "number")) == [(5, "P5")]
    old = spark.createDataFrame([(5, None, "P9", "", None), (7, None, "P8", "", None), (1, 1, "P1", "", None)], target.schema)
    assert rows(K.backfilled(old, seed).select("id", "seed_id")) == [(1, 1), (5, 5), (7, None)]
    assert rows(K.fill_blanks(target, seed, ["name", "price"], ["price"]).select("id", "name", "price")) == [(1, "Original Name", None), (2, "Two", 9.5)]
    assert rows(K.overwrite(target, seed, ["price"]).select("id", "price", "changed")) == [(1, 1.0, 1), (2, 1.0, 1)]


def test_upsert_last_row_wins(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    batch = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 3)], "k string, v int, pos int")
    assert rows(K.upsert(target, batch, ["k"], "pos", ["v"])) == [("a", 1, "kept"), ("b", 4, "updated"), ("c", 5, "created")]


def test_substitute_pairs(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 3, 3), (4, 1, None)], "id int, a int, b int")
    assert rows(R.unordered_pairs(df, "a", "b", "id")) == [(1, 2, 1, 2, 2)]


def test_pages(spark):
    df = spark.range(7).withColumn("k", F.lit(1))
    assert [r.page for r in R.pages_of(df, ["k"], [F.col("id")], 2, 3).orderBy("id").collect()] == [1, 1, 2, 2, 2, 3, 3]
    assert [r.id for r in S.page(df, 99, 5, [F.col("id")]).collect()] == [5, 6] and [r.id for r in S.page(df, -1, 5, [F.col("id")]).collect()] == [0, 1, 2, 3, 4]


def test_tiers(spark):
    df = spark.createDataFrame([(1, "abc", ""), (2, "x", "abc"), (3, "", "")], "id int, a string, b string")
    hits = lambda q: rows(S.tiered(df, F.col("a").contains(q), F.col("b").contains(q), q).select("id", "tier"))
    assert hits("abc") == [(1, 0)] and hits("x") == [(2, 0)]
    deep = df.where("id > 1")
    assert rows(S.tiered(deep, F.col("a").contains("abc"), F.col("b").contains("abc"), "abc").select("id", "tier")) == [(2, 1)]
    assert rows(S.tiered(deep, F.col("a").contains("ab"), F.col("b").contains("ab"), "ab").select("id")) == []


def test_csv_upload(spark, tmp_path):
    path = tmp_path / "parts.csv"
    path.write_text('﻿Part #,J & N,Colour,desc\n P1 ,,red,"a, b"\n', encoding="utf-8")
    df = C.split_fields(C.read_upload(spark, str(path), C.PART_ALIASES), ["part_number", "j_and_n", "notes"], [])
    assert df.first().asDict() == {"part_number": "P1", "j_and_n": "", "notes": "a, b", "specifications": {"colour": "red"}}
    C.write_findings(spark.createDataFrame([("x" * 900,)], "v string"), str(tmp_path / "out"))
    assert len(spark.read.csv(str(tmp_path / "out"), header=True).first().v) == 500


def test_rows_from_lists(spark):
    df = spark.createDataFrame([(1, "a | b |a"), (2, "")], "id int, y string")
    assert rows(N.split_rows(df, "y")) == [(1, "a"), (1, "b"), (2, "")]
    assert rows(N.submodels(spark.createDataFrame([("3.0GSM-A,B,C",), ("x",)], "m string"), "m")) == [("3.0GSM-A",), ("3.0GSM-B",), ("3.0GSM-C",), ("x",)]


def test_ledger_stream(spark, tmp_path):
    shape = "old_part long, old_qty long, new_part long, new_qty long"
    data = [(None, None, 1, 5), (1, 5, 1, 3), (1, 3, 2, 4), (2, 4, None, None), (None, None, 3, 2), (3, 2, None, 2)]
    spark.createDataFrame(data, shape).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    ledger.fold(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    moved = spark.read.parquet(str(tmp_path / "out")).groupBy("part_id").agg(F.sum("delta").alias("d"))
    assert rows(moved) == [(1, 0), (2, 0), (3, 2)]  # clearing the part of line 3 gives nothing back


def test_ledger_versions_count_a_batch_once(spark):
    shape = "old_part long, old_qty long, new_part long, new_qty long"
    batch = lambda *r: spark.createDataFrame(r, shape)
    store = Store(spark, own_folder(spark, "ledger"))
    for n in range(5):
        for _ in range(2):  # each comes twice
            ledger.apply_batch(store, batch((None, None, 1, 5), (None, None, 2 + n, 1)), n, every=3)
    assert store.names() == ["base-000000002", "delta-000000003", "delta-000000004"] and ledger.through(store.names()) == 4
    assert rows(ledger.movements(store)) == [(1, 25), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)]
    store.keep("batch-5", "base-000000005", batch((None, None, 9, 9)).select(F.lit(9).cast("long").alias("part_id"), F.lit(9).cast("long").alias("delta")), {})
    ledger.apply_batch(store, batch((None, None, 1, 5)), 5, every=3)  # killed after it was written: what is there is published
    assert rows(ledger.movements(store)) == [(9, 9)]


def test_prefixes_of_one_head_need_no_pairs(spark):
    """All values begin alike, over many ranges."""
    rng = random.Random(3)
    values = ["AAA" + "".join(rng.choices("ab", k=rng.randint(0, 7))) for _ in range(500)] + ["AAA", "AAB", "é", "éé", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, n string").repartition(4)
    some = df.where("id % 3 = 0")
    for asked, others in ((df, df), (df, some), (some, df), (df, df.where("false"))):
        held = [r.n for r in others.collect() if r.n is not None]
        want = sorted((r.id, r.n) for r in asked.collect() if r.n is not None and any(h != r.n and h.startswith(r.n) for h in held))
        got = R.with_prefix_anywhere(asked, others, "n")
        assert sorted(map(tuple, got.collect())) == want
    assert not re.search("(?i)cartesian|nestedloop", got._jdf.queryExecution().executedPlan().toString())


def test_pages_of_a_stored_order(spark):
    df = spark.createDataFrame([(i, i * 7 % 100) for i in range(503)], "id int, k int").repartition(7)
    order = [F.col("k"), F.col("id")]
    index = S.PageIndex(df, order, own_folder(spark, "pages"))
    want = [r.id for r in df.orderBy(*order).collect()]
    for n, first in ((1, 0), (3, 40), (26, 500), (99, 500), (-1, 0)):
        assert [r.id for r in index.page(n, 20).collect()] == want[first : first + 20]
    assert "PartitionFilters" in index.page(3, 20)._jdf.queryExecution().executedPlan().toString()
    assert S.PageIndex(df.where("false"), order, own_folder(spark, "pages")).page(1, 20).count() == 0


def test_stored_counts_follow_changes(spark):
    shape = "make string, model string"
    df = spark.createDataFrame([("a", "x"), ("a", ""), (None, "x"), ("b", "y")], shape)
    counts = ValueCounts(Store(spark, own_folder(spark, "counts")), ["make", "model"])
    counts.build(df)
    assert counts.total().first().n == 4 and rows(counts.dropdown("make")) == [("a",), ("b",)]
    for _ in range(2):  # a change that comes twice counts once
        counts.merge("one", inserted=spark.createDataFrame([("c", "x")], shape), deleted=spark.createDataFrame([("b", "y")], shape))
    assert rows(counts.current()) == [("*", "", 4), ("make", "a", 2), ("make", "c", 1), ("model", "x", 3)]


def test_makers_by_joined_words(spark):
    df = spark.createDataFrame([(1, " alfa  ROMEO. "), (2, "wai"), (3, None), (4, "."), (5, "WAI")], "id int, m string")
    words = L.acronyms(df, "m", ["O'X"])
    assert rows(words) == [("O'X", "O'X"), ("WAI", "WAI")]
    assert rows(L.with_maker_names(df, "m", words)) == [(1, "Alfa Romeo"), (2, "WAI"), (3, ""), (4, ""), (5, "WAI")]


def test_prefixes_of_scopes_need_no_list_of_prefixes(spark):
    df = spark.createDataFrame([(1, "1", "A" * 400), (1, "1", "A" * 399), (11, "", "A"), (11, "", ""), (1, "1:A", "B"), (1, "1", ""), (None, "1", "A"), (2, "x", None)], "u int, s string, n string")
    found = R.with_prefix_of(df, df, ["u", "s"], "n")
    assert rows(found) == [(1, "1", ""), (1, "1", "A" * 399), (11, "", "")]
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_prefixes_count_equal_values_if_asked_to(spark):
    asked, held = (spark.createDataFrame([(x,) for x in v], "value string").repartitionByRange(3, "value") for v in (["a", "ab", "b", "c", None], ["ab", "b", "ca", None]))
    assert rows(R.prefixes_of(asked, held)) == [("a",), ("c",)]
    assert rows(R.prefixes_of(asked, held, proper=False)) == [("a",), ("ab",), ("b",), ("c",)]


def test_rows_without_a_key_are_dealt_by_their_values(spark):
    items = spark.createDataFrame([(i, None, i % 3, "d") for i in range(300)] + [(900, 7, 1, "x"), (901, 8, 1, "")], "id long, part long, bom long, d string")
    mapping = spark.createDataFrame([(7, 8)], "loser long, survivor long")
    assert rows(K.repoint(items, mapping, "part", ["bom"], ["d"])) == sorted([(8, 1, 900, "x"), *[(None, b, b, "d") for b in range(3)]], key=repr)
    moved = R.moved(items, mapping, "part", ["bom"], [F.col("id")])
    assert moved.count() == 301 and moved.where("part = 8").first()["id"] == 901
    found = R.looked_up(items, spark.createDataFrame([(7, "n")], "part int, name string").hint("merge"), "part")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = found.where("part IS NULL").withColumn("at", F.spark_partition_id()).groupBy("at").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(dealt) > 1 and found.where("name = 'n'").count() == 1


def test_makers_names_are_spelled_where_the_rows_lie(spark, monkeypatch):
    df = spark.createDataFrame([(1, "FORD"), (2, None), (3, "a b"), (4, "FORD"), (5, "FORD")], "id int, m string")
    words = spark.createDataFrame([("FORD", "Ford Co")], "word string, form string")
    want = [(1, "Ford Co"), (2, ""), (3, "A B"), (4, "Ford Co"), (5, "Ford Co")]
    few = L.with_maker_names(df, "m", words)
    assert rows(few) == want and "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(L, "NAMES", 1)
    monkeypatch.setattr(L, "OFTEN", 2)
    assert rows(L.with_maker_names(df, "m", words)) == want


def test_identifiers_need_no_list_of_ids(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "b", "c"), (3, "c", None), (None, "d", ""), (4, "e", "x")], "id long, p string, q string")
    found = R.unambiguous(df, "id", ["p", "q"])
    assert rows(found) == [("a", 1), ("b", 2), ("e", 4), ("x", 4)]
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_items_at_ends_of_moves_are_settled_by_move(spark):
    parts = spark.createDataFrame([(1, "Y", "A"), (2, "Y", "B"), (3, "Y", "C"), (4, "", "A"), (5, "Z", "A"), (6, "Z", "A")], "id long, yt_number string, oem string")
    for c in ("part_number", "part_name", "manufacturer_number", "j_and_n", "category", "voltage"):
        parts = parts.withColumn(c, F.lit("x"))
    parts = parts.withColumn("cost_price", F.lit(1)).withColumn("price", F.lit(1))
    items = spark.createDataFrame([(10, 1, 2, 5), (11, 1, 1, 5), (12, 1, 3, 5), (13, 2, 3, 1), (14, 2, 2, 1), (15, 3, None, 1), (16, 3, None, 1), (17, 4, 4, 1), (18, 4, 4, 1), (19, 5, 6, 2)], "id long, bom_id long, part_id long, unit_qty int")
    boms = spark.createDataFrame([(b,) for b in range(1, 7)], "id long")
    left, kept, got = L.cleanup_parts(parts, boms, items, {}, {}, [("B", "C"), ("A", "B")])
    assert rows(left.select("id")) == [(1,), (4,), (5,)] and rows(kept) == [(b,) for b in range(1, 6)]
    assert rows(got.select("id", "bom_id", "part_id")) == [(11, 1, 1), (14, 2, 1), (15, 3, None), (17, 4, 4), (19, 5, 5)]


def test_texts_that_cannot_be_wrapped_are_not_taken_apart(spark):
    texts = ["a \nb\t\u2028\n c\r\n", "", " ", "a\n\n", "no 7 end\nx", "1999-\n 2001", "1999\n-2001 ", "5- \n 6\n7", "x \u0085\ny", "b\u00a0 \nc"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    folded = L2.rejoin(F.concat("text", F.lit("\n1999\nz")))
    got = df.select(L2.rejoin(F.col("text")).alias("a"), folded.alias("b")).collect()
    assert all(r["b"] == r["a"] + "\n1999\nz" for r in got[:5] + got[8:]) and [r["a"] for r in got[5:8]] == ["1999-2001", "1999-2001 ", "5-6\n7"]
    assert df.select(L2.rejoin(F.col("text"))).columns[0].startswith("CASE WHEN")


def test_texts_without_headings_are_one_section(spark):
    df = spark.createDataFrame([("a\nb\n",), ("",), ("x\nAPPLICATION \ny",), ("MY APPLICATION\nz",)], "text string")
    got = [[tuple(s) for s in r[0]] for r in df.select(G.sections(F.col("text"))).collect()]
    assert got == [[("", "a\nb\n")], [("", "")], [("", "x"), ("APPLICATION", "y")], [("", "MY APPLICATION\nz")]]
    assert df.select(G.sections(F.col("text"))).columns[0].startswith("CASE WHEN")
