"""Steps of batch commands on small tables, against plain Python."""

import itertools
import random

import pytest

from partloom.operators import dml as K, relations as R
from partloom.operators.lineage import own_folder
from partloom.operators.publish import Store, run_tables
from partloom.plans import commands as L
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_fill(table):
    """The reading loop of a staged file: blanks inherit from above within the same group."""
    group, held, out = None, ["", ""], []
    for pos, make, model, year, mfr in sorted(table):
        if (make, model) != group:
            group, held = (make, model), ["", ""]
        held = [year or held[0], mfr or held[1]]
        out.append((pos, make, model, *held))
    return out


def test_fill_down_carries_over_ranges(spark):
    """Runs of any length, over more ranges than one; a make between two rows of another ends their run."""
    rng = random.Random(3)
    table, make, model = [], "a", "x"
    for pos in range(400):
        if rng.random() < 0.15:
            make, model = rng.choice("ab"), rng.choice("xy")
        table.append((pos, make, model, rng.choice(["", "", "", str(pos)]), rng.choice(["", "", "", "", "m" + str(pos)])))
    df = spark.createDataFrame(table, "pos int, make string, model string, year string, mfr string")
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    for adaptive in ("true", "false"):  # one range, and as many as there are partitions
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        assert sorted(map(tuple, R.fill_down(df, ["make", "model"], ["year", "mfr"], "pos").collect())) == plain_fill(table)
    spark.conf.set("spark.sql.adaptive.enabled", keep)
    assert R.fill_down(df.where("false"), ["make", "model"], ["year", "mfr"], "pos").count() == 0


def test_moved_rows_yield_to_those_that_are_there(spark):
    links = [(1, 10, "a"), (2, 10, "a"), (3, 11, "a"), (4, 11, "b"), (5, 12, "b"), (6, 12, None), (7, 11, None), (8, 20, "b")]
    df = spark.createDataFrame(links, "id int, unit int, app string")
    mapping = spark.createDataFrame([(11, 10), (12, 10)], "loser int, survivor int")
    got = R.moved(df, mapping, "unit", ["app"], [F.col("id")])
    assert rows(got.select("id", "unit", "app")) == [(1, 10, "a"), (2, 10, "a"), (4, 10, "b"), (6, 10, None), (8, 20, "b")]


def test_boms_of_a_unit_are_merged_into_the_fullest(spark):
    boms = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, None), (5, 6)], "id long, unit_id long")
    items = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 2, 8), (4, 3, 8), (5, 3, 9), (6, 4, 7)], "id long, bom_id long, part_id long")
    unique = lambda df: df.withColumn("_unique", F.col("part_id"))
    left, after = L.merge_unit_boms(boms, items, unique, [F.col("n").desc(), F.col("id").desc()])
    assert rows(left.select("id")) == [(3,), (4,), (5,)]
    assert rows(after.select("id", "bom_id")) == [(2, 3), (4, 3), (5, 3), (6, 4)]


def test_a_sync_stops_at_its_budget_and_goes_on(spark):
    shape = "id long, seed_id long, number string, name string"
    target = spark.createDataFrame([(1, None, "P1", ""), (9, None, "P9", "own")], shape)
    seed = spark.createDataFrame([(1, 1, "P1", "One"), (2, 2, "P2", "Two"), (3, 3, "P9", "Taken"), (4, None, "P4", "None")], shape)
    one = L.SyncTable(target, seed, ("number",), ("name",))
    tables = {"a": one, "b": one, "c": one}
    clock = itertools.count().__next__
    store = Store(spark, own_folder(spark, "catalog"))
    report = L.sync_catalog(store, "run", tables, 2, clock=clock)
    assert [(r.table_name, r.state) for r in report] == [("a", "done"), ("b", "left"), ("c", "left")]
    assert (report[0].inserted, report[0].conflicts, report[0].updated, report[0].skipped) == (1, 1, 1, 0)
    assert store.version() == 0 and store.tables() == {} and set(store.progress("run")) == {"a"}
    report = L.sync_catalog(store, "run", tables, 100, clock=clock)
    assert [r.state for r in report] == ["done before", "done", "done"] and store.version() == 1
    got = store.tables()
    assert rows(got["a"].select("id", "seed_id", "number", "name", "change")) == [(1, 1, "P1", "One", "fill"), (10, 2, "P2", "Two", "insert"), (9, None, "P9", "own", "kept")]
    assert sorted(got) == ["a", "b", "c"] and rows(got["b"]) == rows(got["a"])


def test_a_killed_run_goes_on_and_readers_see_whole_versions(spark):
    store = Store(spark, own_folder(spark, "catalog"))
    frame = lambda v: spark.createDataFrame([(v,)], "v int")
    made = []

    def make(name, v, fails=False):
        def run():
            made.append(name)
            if fails:
                raise KeyboardInterrupt  # as by a kill between two tables
            return frame(v), {"n": v}

        return run

    run_tables(store, "first", {"a": make("a", 1), "b": make("b", 1)})
    with pytest.raises(KeyboardInterrupt):
        run_tables(store, "second", {"a": make("a", 2), "b": make("b", 2, fails=True), "c": make("c", 2)})
    seen = lambda: {n: df.first().v for n, df in store.tables().items()}
    assert seen() == {"a": 1, "b": 1} and store.version() == 1
    made.clear()
    again = Store(spark, store.folder)  # another process
    told = run_tables(again, "second", {"a": make("a", 3), "b": make("b", 2), "c": make("c", 2)})
    assert made == ["b", "c"] and told == {"a": ("done before", {"n": 2}), "b": ("done", {"n": 2}), "c": ("done", {"n": 2})}
    assert seen() == {"a": 2, "b": 2, "c": 2} and {n: df.first().v for n, df in store.tables(1).items()} == {"a": 1, "b": 1}
    again._write(f"{store.folder}/versions/3.json", "{}")
    with pytest.raises(FileExistsError):  # the number was taken meanwhile
        again._write(f"{store.folder}/versions/3.json", "{}")


def test_new_rows_get_the_next_ids(spark):
    known = spark.createDataFrame([(7,), (3,)], "id long")
    df = spark.createDataFrame([(None, i) for i in range(50)] + [(4, 99)], "id long, pos int").repartition(5)
    got = rows(K.with_ids(df, known, [F.col("pos")]))
    assert got == sorted([(8 + i, i) for i in range(50)] + [(4, 99)], key=repr)
    assert rows(K.with_ids(df.where("pos = 3"), known.where("false"), [F.col("pos")])) == [(1, 3)]


def test_catalog_references_by_kind(spark):
    staged = spark.createDataFrame([(1, " A ", "", "", "C1", ""), (2, "B", "Bee", "Cat", "", ""), (3, "A", "Late", "", "", "")], "pos long, number string, part_name string, category string, code string, maker string")
    known = spark.createDataFrame([(5, "B", "", "kept", "")], "id long, number string, part_name string, category string, maker string")
    refs = [(1, "A", "B", "Superseded_By", "M", ""), (2, "A", "Z", "superseded_by", "M", "n"), (3, "B", "A", "superseded_from", "", ""), (4, "A", "A", "", "", "x"), (5, "A", "A", "interchange", "", "y"), (6, "Q", "A", "substitute", "", ""), (7, "B", "S", "substitute", "M", "n"), (8, "A", "Z", "superseded_by", "M", "again")]
    got = L.import_master(staged, spark.createDataFrame(refs, "pos long, number string, ref_number string, ref_type string, maker string, notes string"), known)
    assert rows(got["part"].select("number", "id", "part_name", "category", "change")) == [("A", 6, "A", "C1", "created"), ("B", 5, "Bee", "kept", "updated")]
    assert rows(got["superseding"].select("number", "part_id", "other", "other_id")) == [("B", 5, "A", 6), ("B", 5, "A", 6)]
    tell = lambda kind: rows(got[kind].select("number", "other", "ref_number", "notes"))
    assert tell("superseding") == [("B", "A", "A", ""), ("B", "A", "JN:A", "M")]
    assert tell("interchange") == [("A", None, "A", "x")] and tell("substitute") == [("B", None, "S", "M | n")]
    assert rows(got["note"].select("number", "notes")) == [("A", "Superseded by: Z (M)")]


def test_fields_are_replaced_only_where_they_differ(spark):
    shape = "category string, name string, place int"
    ours = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "x", 1)], shape)
    theirs = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("b", "y", 2), ("d", "x", 1)], shape)
    assert rows(L.replace_fields(ours, theirs, "category", ["name", "place"])) == [("a", "x", 1), ("b", "x", 1), ("b", "y", 2), ("c", "x", 1)]
