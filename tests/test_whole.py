"""Queries over all their rows, held against SQL of their own where the registered SQL takes only a part."""

import re
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from partloom.operators import nested as N, relations as R
from partloom.plans import commands, domain, q_relations, registry

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def by_sql(sql, sf=SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return sorted(con.execute(domain.oracle(sql)).fetchall(), key=repr)


WHOLE_C14 = "SELECT s.id FROM cross_references s WHERE EXISTS (SELECT 1 FROM cross_references l WHERE l.unit_id = s.unit_id AND starts_with(l.cross_ref_number, s.cross_ref_number) AND length(l.cross_ref_number) > length(s.cross_ref_number))"


@needs_tables
def test_c14_takes_numbers_of_any_length(spark):
    assert rows(registry.queries()["C14"](spark, SF)) == by_sql(WHOLE_C14)


def test_scoped_prefixes_join_by_equality(spark):
    df = spark.createDataFrame([(1, "ABCDE"), (1, "ABCDEF"), (1, "ABCDE"), (2, "ABCD"), (3, ""), (3, "x"), (4, ""), (5, None), (None, "A"), (None, "AB"), (6, "Ab"), (6, "ABC")], "u int, n string")
    found = R.with_prefix_of(df, df, ["u"], "n")
    assert found.columns == ["u", "n"] and rows(found) == [(1, "ABCDE"), (1, "ABCDE"), (3, "")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan


WHOLE_D05 = f"SELECT i.id, cast(coalesce(sum(cast({q_relations._LINE} AS decimal(12,2))), 0) AS decimal(14,2)) AS subtotal FROM invoices i LEFT JOIN invoice_items l ON l.invoice_id = i.id GROUP BY i.id"


@needs_tables
def test_d05_sums_every_line(spark):
    assert rows(registry.queries()["D05"](spark, SF)) == by_sql(WHOLE_D05)


def test_subtotals_of_small_lines_and_of_none(spark):
    invoices = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    lines = [(1, 1, Decimal("10.00"), Decimal("0.00")), (1, 50, Decimal("2.00"), Decimal("10.00")), (2, 40, Decimal("0.50"), Decimal("0.00"))]
    got = q_relations.subtotals(invoices, spark.createDataFrame(lines, "invoice_id long, quantity int, unit_price decimal(10,2), discount_pct decimal(5,2)"))
    assert rows(got) == [(1, Decimal("100.00")), (2, Decimal("20.00")), (3, Decimal("0.00"))]


def plain_cleanup(table, siblings):
    """The command row by row: first pass in the order of ids, then the orphan pass."""
    code = re.compile(r"[A-Z0-9][A-Z0-9-]*")
    fragment = lambda n: n is not None and n.endswith("-") and n != "-"

    def suffix_of(label):
        text = (label or "").strip()
        head, _, rest = text.partition(" ")
        if rest and code.fullmatch(head) and len(head) <= 8:
            return head, rest.strip()
        return (text, "") if code.fullmatch(text) and len(text) <= 6 else ("", text)

    def reasons(n, label):
        parts = [p for p in n.rstrip("-").split("-") if p]
        glued = any(len(p) == 1 and p.isalpha() for p in parts[2:-1])
        return re.search(r"\s", n) or len(n) > 40 or (label or "").endswith("-") or glued

    def stems(state):
        whole = [(o, n.lower()) for o, n, _ in state.values() if n is not None and not n.endswith("-")]
        return {(o, n[:k]) for o, n in whole for k in range(len(n) + 1)}, {n[:k] for _, n in whole for k in range(len(n) + 1)}

    state = {i: (o, n, t) for i, o, n, t in table}
    own, _ = stems(state)
    have, taken, out, after = {(o, n) for o, n, _ in state.values()}, set(), {}, dict(state)
    for i, (o, n, t) in sorted(state.items()):
        if not fragment(n):
            continue
        suffix, maker = suffix_of(t)
        key = (o, n + suffix, maker or t)
        if (o, n + suffix) in have or key in taken if suffix else (o, n[:-1].lower()) in own:
            out[i] = ("delete", n, t)
            del after[i]
        elif suffix:
            taken.add(key)
            out[i], after[i] = ("merge", *key[1:]), key
        else:
            out[i] = ("manual", n, t)
    own, any_ = stems(after)
    twins = Counter((o, t) for o, n, t in after.values() if fragment(n))
    for i, (o, n, t) in after.items():
        if fragment(n) and ((o, n[:-1].lower()) in own or n[:-1].lower() in any_ or reasons(n, t) or siblings and twins[o, t] > 1):
            out[i] = ("orphan", n, t)
    return sorted(((i, *x) for i, x in out.items()), key=repr)


FRAGMENTS = [
    (1, 1, "F78Z-10346-", "AA"), (2, 1, "F78Z-10346-AA", "FORD"), (3, 2, "F78Z-10346-", "AARM Ford"), (4, 2, "F78Z-10346-", "AARM Ford"),
    (5, 3, "AB12-", "Bosch"), (6, 3, "AB12-77", "x"), (7, 4, "AB1-", "Bosch"), (8, 4, "AB12-", "Lucas parts"), (9, 5, "ZZ9-", "Delco Remy"), (10, 5, "-", "Delco Remy"),
    (11, 6, "QQ 1-", "Delco Remy"), (12, 7, "QQ-1-", "Delco-"), (13, 8, "YY-1-", "Twin Co"), (14, 8, "YY-2-", "Twin Co"), (15, 9, "W-31-X-33-52-", "Glued Co"),
    (16, 10, "KK-", "B- Maker"), (17, 11, "KK-B-9", "z"), (18, 12, "MM-", "B- Maker"), (19, 13, "nn-", "Lower Co"), (20, 13, "NN7", "y"), (21, 14, "PP-", None), (22, 15, None, "x"), (23, 16, "ZZ8-", "AA"), (24, 16, "ZZ8-", "BB"),
    (25, 17, "VV-A", "Other Co"), (26, 17, "VV-A-", "Other Co"), (27, 18, "L" * 50 + "-", "Long Co"), (28, 19, "C1-", "AA"), (29, 19, "C1-A-", "Zed Co"),
]


@pytest.mark.parametrize("siblings", [True, False])
def test_fragments_are_merged_and_cleaned_up(spark, siblings):
    df = spark.createDataFrame(FRAGMENTS, "id long, owner long, n string, t string")
    got = rows(commands.cleanup_fragments(df, "owner", "n", "t", siblings))
    assert got == plain_cleanup(FRAGMENTS, siblings)
    action = {i: a for i, a, _, _ in got}
    assert [action[i] for i in (1, 3, 4, 5, 7, 9, 21)] == ["delete", "merge", "delete", "delete", "orphan", "manual", "manual"]
    assert action[13] == ("orphan" if siblings else "manual") and 10 not in action and 22 not in action


@needs_tables
def test_l16_is_the_whole_command(spark):
    table = by_sql("SELECT id, unit_id, cross_ref_number, interchange_type FROM cross_references")
    got = rows(registry.queries()["L16"](spark, SF))
    assert got == plain_cleanup(table, True)


def test_further_numbers_of_odd_and_even_parts(spark):
    df = spark.createDataFrame([(1, "A, B,C"), (2, "A, K0"), (3, "A"), (4, None), (5, "")], "id long, n string")
    have = spark.createDataFrame([(2, "K0"), (3, "B")], "id long, other string")
    assert rows(N.further_numbers(df, "n", have)) == [(1, "A", "B"), (1, "A", "C")]
