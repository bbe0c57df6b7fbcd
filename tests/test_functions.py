"""Edge cases of the column functions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from partloom.functions import lines as L, money as M, text as T, years as Y


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[1] for r in df.select("i", column(F.col("c"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "rule, cases",
    [
        (T.normalize_space, {" a \t b\n": "a b", None: "", "": ""}),
        (T.title_case, {"ALFA-romeo": "Alfa-Romeo", "o'neil": "O'Neil"}),
        (lambda c: T.maker_name(c, {"WAI": "WAI"}), {" alfa  ROMEO. ": "Alfa Romeo", "wai": "WAI", None: "", ".": ""}),
        (T.drop_open_paren, {"400-12003 (12V": "400-12003", "a (b)": "a (b)"}),
        (T.drop_page_reference, {"8201154A (Aftermarket) Pg. 36748": "8201154A (Aftermarket)", "x pg. 1 ": "x"}),
        (T.is_page_reference, {"Pg. 17810": True, "x Pg. 1": False}),
        (T.repair_hyphen, {"F- 150": "F-150", "x - ": "x - "}),
        (T.tidy_model, {"All Models  1986.": "All Models 1986"}),
        (lambda c: F.concat_ws("/", T.artifact_reasons(c, F.lit("BOSCH-"))), {"B-X31-60-B-X33-52-": "broken_label/concatenated_parts", "1 2": "spaces_in_number/broken_label"}),
        (T.first_item_dots, {"a | b": "a....", "a,b": "a....", "a": "a", "": ""}),
        (Y.expand_range, {"68-72": "1968-1972", "00-02": "2000-2002", "99-01": "1999-2001", "2001": "2001", "": ""}),
        (Y.expand_audit, {"68-72": "2068-1972", "00-02": "2000-2002"}),
        (Y.expand_import, {"81-91": "1981-1991", "00-01 | 30": "2000-2001 | 2030", "2001": "2001"}),
        (Y.fix_direction, {"1964-1962": "1962-1964", "1960-1962": "1960-1962"}),
        (L.rejoin, {"Model 2000-\n2002 x": "Model 2000-2002 x", "Model 2000\n-2002": "Model 2000-2002", "130-\n05002\n7": "130-05002\n7", "a\nb": "a\nb"}),
    ],
)
def test_text_rules(spark, rule, cases):
    assert values(spark, list(cases), rule) == list(cases.values())


def test_search_is_literal(spark):
    df = spark.createDataFrame([("50%",), ("505",), ("a_b",), ("axb",)], "c string")
    assert [r.c for r in df.where(T.contains_text(F.col("c"), "0%")).collect()] == ["50%"]
    assert [r.c for r in df.where(T.contains_text(F.col("c"), "A_B")).collect()] == ["a_b"]


def test_year_filter(spark):
    df = spark.createDataFrame([("2001",), ("1999-2002",), ("1985",), ("",)], "year string")
    hits = lambda raw: {r.year for r in df.where(Y.year_filter(F.col("year"), raw)).collect()}
    assert hits("01-03") == {"2001", "1999-2002"} and hits("85") == {"1985"} and hits("99") == {"1999-2002"}
    assert Y.year_filter(F.col("year"), "  ") is None


def test_money(spark):
    row = spark.sql("SELECT cast(10.5 AS decimal(10,2)) AS p, 3 AS q, cast(0 AS decimal(5,2)) AS d, cast(2.345 AS decimal(10,3)) AS x, cast(2.355 AS decimal(10,3)) AS y, cast(null AS decimal(10,2)) AS n")
    got = row.select(
        M.line_total(F.col("q"), F.col("p"), F.col("d")).alias("t"), M.round_even(F.col("x")).alias("x"), M.round_even(F.col("y")).alias("y"),
        M.margin_pct(F.col("n"), F.col("p")).alias("m"), M.margin_pct(F.lit(0).cast("decimal(10,2)"), F.col("p")).alias("z"),
        M.sell_price(F.col("p"), F.lit(100)).alias("s"), M.unit_price(F.lit(0).cast("decimal(10,2)"), F.col("p")).alias("u"),
    ).first()
    assert (got.t, got.x, got.y, got.m, got.z, got.s, got.u) == (Decimal("31.50"), Decimal("2.34"), Decimal("2.36"), None, None, Decimal("1050.00"), Decimal("10.50"))


def test_interchange_pairs(spark):
    df = spark.createDataFrame([(1, "A: 1, 2 | 3 | B:4 |"), (2, "5"), (3, "")], "id int, t string")
    assert sorted(map(tuple, L.interchange_pairs(df, "id", "t").collect())) == [(1, "A", "1"), (1, "A", "2"), (1, "A", "3"), (1, "B", "4")]
