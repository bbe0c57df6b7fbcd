"""Steps whose work must grow no faster than their input: what their plans move and keep, and rows against plain Python."""

import pytest

from partloom.operators import substrings
from partloom.operators.lineage import own_folder
from partloom.plans import commands as L


def plan(df):
    """The plan of a frame, without what was written before."""
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_audit_counts_rows_before_they_move_and_joins_nothing(spark):
    """Each row by itself, however often it comes; a key of nulls meets nothing; several spellings of a maker are told once."""
    schema = "unit long, maker string, number string"
    expected = spark.createDataFrame([(1, "FORD", "x")] * 3 + [(1, "WAI", "y"), (None, "WAI", "z")], schema)
    stored = spark.createDataFrame([(1, "ford", "x"), (1, "Ford ", "x"), (1, "Ford", "x"), (2, "WAI", "y"), (None, "wai", "z")], schema)
    got = L.audit_interchanges(expected, stored)
    told = rows(got.select("unit", "field", "status", "stored"))
    want = [(1, "FORD:x", "MATCH", "FORD: x")] * 3 + [(1, "WAI:y", "MISSING_IN_DB", ""), (None, "WAI:z", "MISSING_IN_DB", ""), (2, "WAI:y", "EXTRA_IN_DB", "WAI: y"), (None, "wai:z", "EXTRA_IN_DB", "wai: z")]
    assert told == sorted([*want, (1, "ford:x", "FLAG", "Ford | ford")], key=repr)
    assert "Join" not in plan(got)


def test_audited_items_are_written_nowhere(spark):
    items = "unit long, number string, text string, jn string, {} long"
    expected = spark.createDataFrame([(1, "a", "t", "", 1), (2, "b", "t", "J", 2), (2, "B", "t", "K", 3)], items.format("pos"))
    stored = spark.createDataFrame([(2, "b", "s", "k", 1), (3, "c", "s", "5- 6", 2)], items.format("id"))
    got = L.audit_items(expected, stored)
    assert rows(got.select("unit", "field", "status", "expected", "stored")) == [(1, "A", "MISSING_IN_DB", "t", ""), (2, "B", "MATCH", "t", "s"), (3, "C", "EXTRA_IN_DB", "", "s"), (3, "c", "FLAG", "", "5- 6")]
    assert plan(got).count("FullOuter") == 1


def test_an_index_holds_texts_and_no_rows(spark):
    """Rows with a text do not make the index larger; a character 0, ends of texts and texts longer than a batch are found as by a scan."""
    table = [(i, t) for i in range(300) for t in ("a\0b", "Xé", "y" * 200 + "z")] + [(None, "xé"), (9, None), (9, "")]
    df = spark.createDataFrame(table, "id long, t string")
    index = substrings.Index(spark, own_folder(spark, "index"), {"t": (df, "id", ["t"])})
    parquet = spark.read.parquet
    assert parquet(f"{index.folder}/grams").count() == 3 + 2 + 201
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        parquet(f"{index.folder}/rows")
    for q in ("\0b", "x", "é", "xé", "yyyz", "b", "zz"):
        assert rows(index.search("t", q)) == sorted(((i, t) for i, t in table if i is not None and t and q in t.lower()), key=repr), q


def test_imported_applications_read_filled_rows_once(spark):
    """Years and options in the order in which they come first, from one reading of the rows."""
    schema = "pos int, make string, model string, engine string, part_number string, mfr string, year string, options string"
    staged = [(1, "90-91", "AC; Automatic"), (2, "", "4WD;Automatic"), (3, "88-89", "AC;Automatic"), (4, "90-91", "Automatic"), (5, "88-89", "")]
    filled = spark.createDataFrame([(pos, "M", "D", "", "U1", "", year, options) for pos, year, options in staged], schema)
    got = L.import_applications(filled, spark.createDataFrame([(7, "U1")], "id long, unit_number string"))
    told = [("Automatic", "1990-1991 | 1988-1989", "Automatic | AC | 4WD", 7), ("", "1988-1989", "", 7)]
    assert rows(got.select("transmission", "year", "options", "unit_id")) == sorted(told, key=repr)
    assert plan(got).count("Join") <= 1  # the units only


def test_cross_references_move_once_for_all_steps(spark):
    """Cuts, annotations and names meet within a unit and stem: the beginning of a number that no cut takes."""
    x = [
        (1, 5, "12 (12V", "B"), (2, 5, "12", "B"), (3, 5, "34(x", "B"), (4, 5, "34 Pg. 7", "B"), (5, 5, " Pg. 7", "B"), (6, 5, "56", "b"), (7, 5, "56 (new)", "B"),
        (8, None, "56 (new)", "B"), (9, None, "56", "B"), (10, 5, "78", "V"), (11, 5, "78", "F"), (12, None, "78", "V"), (13, None, "78", "F"), (14, 5, None, "F"), (15, 5, "9 (x) Pg. 3", None), (16, 5, "(1) (2", "B"),
    ]
    got = L.cleanup_xrefs(spark.createDataFrame(x, "id long, unit_id long, cross_ref_number string, interchange_type string"), {"B": "Bosch"}, [("F", "V")])
    told = {r.id: (r.cross_ref_number, r.interchange_type) for r in got.collect()}
    want = {2: ("12", "Bosch"), 3: ("34", "Bosch"), 7: ("56 (new)", "Bosch"), 8: ("56 (new)", "Bosch"), 9: ("56", "Bosch"), 11: ("78", "F"), 12: ("78", "V"), 13: ("78", "F"), 14: (None, "F"), 15: ("9 (x)", None), 16: ("(1) (2", "Bosch")}
    assert told == want
    moves = plan(got.select("*"))
    assert moves.count("Exchange") == 1 and "Join" not in moves


def test_missing_items_are_told_where_links_lie(spark):
    """BOMs of one unit, of several, of none, and with more parts than a list holds, against all pairs; what links make does not move."""
    boms, links = [(1, 5), (1, 5), (2, 5), (2, 6), (3, None), (4, 6), (None, 6)], [(5, p) for p in range(4)] + [(5, 0), (6, 9), (6, 1), (6, None), (None, 2)]
    links += [(6, p) for p in range(2000, 2010)]
    items = [(1, 0), (1, 0), (2, 9), (4, None), (None, 1), *[(4, p) for p in range(1000, 2005)]]
    frame = lambda data, names: spark.createDataFrame(data, ", ".join(f"{n} long" for n in names))
    got = L.missing_bom_items(frame(boms, ("bom_id", "unit_id")), frame(links, ("unit_id", "part_id")), frame(items, ("bom_id", "part_id")))
    want = {(b, p) for b, u in boms for v, p in links if u is not None and u == v and (b is None or p is None or (b, p) not in items)}
    assert rows(got) == sorted(want, key=repr)
