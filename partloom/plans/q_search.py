"""Scans, filters, sorts, pages and set operations (groups A, B, F and G)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from partloom.functions import text as T, years as Y
from partloom.operators import dml as K, search as S
from partloom.operators.counts import ValueCounts
from partloom.operators.lineage import cut_lineage, own_folder
from partloom.operators.publish import Store
from partloom.operators.substrings import Index
from partloom.plans.domain import frame
from partloom.plans.registry import query, table
from partloom.sources import csv as C


@query("A01", "SELECT id, part_number, part_name FROM parts")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("id", "part_number", "part_name")


@query("A02", "SELECT id, cross_ref_number FROM cross_references WHERE interchange_type = 'FORD'")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return S.where_equal(frame(spark, sf, "cross_references"), interchange_type="FORD").select("id", "cross_ref_number")


@query("A03", "SELECT coalesce(trim(part_number), '') AS part_number, coalesce(trim(part_name), '') AS part_name, coalesce(trim(oem), '') AS oem, coalesce(trim(notes), '') AS notes FROM parts")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    raw = frame(spark, sf, "parts").select(F.col("part_number").alias(" Part # "), F.col("part_name").alias("Name"), F.col("oem").alias("Manufacture"), F.col("notes").alias("DESC"))
    return C.normalized(raw, C.PART_ALIASES)


#: Uploads of parts and of units with headers as people write them, and what each column is.
_UPLOADS = {
    "parts": (C.PART_ALIASES, {"Item #": ("id", "part_number"), " MFR  No. ": ("manufacturer_number", "manufacturer_number"), "YT #": ("yt_number", "yt_number"), "J&N No": ("j_and_n", "j_and_n"), "NAME": ("part_name", "part_name"),
                               "Manufacture": ("oem", "oem"), "Unit Type": ("category", "category"), "Desc": ("notes", "notes"), "Voltage": ("voltage", "voltage")}),
    "units": (C.UNIT_ALIASES, {"Unit No.": ("id", "unit_number"), "yt no": ("yt_number", "yt_number"), "MFR": ("manufacturer", "manufacturer"), "desc": ("unit_type", "description"), "Family": ("family", "family")}),
}


@query("A04", " UNION ALL ".join(f"SELECT '{t}' AS upload, id, '{name}' AS name, trim(coalesce(cast({c} AS string), '')) AS value FROM {t}" for t, (_, columns) in _UPLOADS.items() for c, name in columns.values()))
def a04(spark: SparkSession, sf: str) -> DataFrame:
    """Whole uploads from file to columns: written as CSV with such headers, and read again by the aliases."""
    folder, out = own_folder(spark, "uploads"), None
    for kind, (aliases, columns) in _UPLOADS.items():
        key = {name: c for c, name in columns.values()}
        sheet = frame(spark, sf, kind).select(*[F.col(c).cast("string").alias(h) for h, (c, _) in columns.items()])
        sheet.write.csv(f"{folder}/{kind}", header=True, escape='"')
        got = C.read_upload(spark, f"{folder}/{kind}", aliases)
        id_ = next(n for n, c in key.items() if c == "id")
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in got.columns])).alias("x")
        rows = got.select(F.lit(kind).alias("upload"), F.col(id_).cast("long").alias("id"), each).select("upload", "id", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("A05", "SELECT name, min(pos) AS pos FROM (SELECT * FROM (VALUES ('part_number', 0), ('part_name', 1), ('voltage', 2)) AS t(name, pos) UNION ALL SELECT CASE WHEN p_size = 7 THEN 'voltage' ELSE 'size_' || cast(p_size AS string) END, 3 + p_size FROM part) GROUP BY name")
def a05(spark: SparkSession, sf: str) -> DataFrame:
    fields = table(spark, sf, "part").select(F.when(F.col("p_size") == 7, "voltage").otherwise(F.concat(F.lit("size_"), F.col("p_size"))).alias("field_name"), F.col("p_size").alias("ordering"))
    return C.template(["part_number", "part_name", "voltage"], fields).select("name", "pos")


@query("A06", "SELECT make, model, year, part_number FROM staging_applications")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "staging_applications").select("make", "model", "year", "part_number")


@query("A07", "SELECT t.id AS target_id, s.id AS seed_row FROM target_parts t JOIN seed_parts s ON t.seed_id = s.seed_id")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    t, s = frame(spark, sf, "target_parts"), frame(spark, sf, "seed_parts")
    return t.select(F.col("id").alias("target_id"), "seed_id").join(s.select(F.col("id").alias("seed_row"), "seed_id"), "seed_id").select("target_id", "seed_row")


#: Columns that are asked for, of which the last two are none of the table's.
_PROBED = ("id", "part_number", "part_name", "yt_number", "cost_price", "price", "vendor_id", "notes", "colour", "seed_id")


@query("A08", " UNION ALL ".join([f"SELECT '{c}' AS name, true AS present, count({c}) AS n_filled FROM parts" for c in _PROBED[:-2]] + [f"SELECT '{c}', false, 0" for c in _PROBED[-2:]]))
def a08(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows have a value, of a column that a table may lack."""
    df = frame(spark, sf, "parts")
    counts = [F.struct(F.lit(c).alias("name"), F.lit(C.has_column(df, c)).alias("present"), (F.count(c) if C.has_column(df, c) else F.lit(0).cast("long")).alias("n_filled")) for c in _PROBED]
    return df.agg(F.array(*counts).alias("x")).select(F.inline("x"))


@query("A09", "SELECT 'region' AS table_name, 'r_regionkey,r_name' AS columns, count(*) AS n_rows FROM region UNION ALL SELECT 'part', 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice', count(*) FROM part")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    return C.inspect({t: table(spark, sf, t) for t in ("region", "part")})


@query("A10", "SELECT (SELECT max(id) FROM parts WHERE id % 2 = 0) + row_number() OVER (ORDER BY their_number) AS id, their_number FROM (SELECT DISTINCT their_number FROM staging_interchange WHERE their_number NOT IN (SELECT 'T' || cast(id AS string) FROM parts WHERE id % 2 = 0))")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    have = frame(spark, sf, "parts").where("id % 2 = 0").select("id", F.concat(F.lit("T"), F.col("id")).alias("their_number"))
    new = C.append_new(have, frame(spark, sf, "staging_interchange").select("their_number"), ["their_number"])
    return K.with_ids(cut_lineage(new.withColumn("id", F.lit(None).cast("long"))), have, [F.col("their_number")]).select("id", "their_number")


@query("A11", "SELECT cast(doc_id AS string) AS doc_id, substr(text, 1, 500) AS text FROM documents")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return C.clipped(table(spark, sf, "documents").select("doc_id", "text"))


@query("A12", "SELECT id, coalesce(seed_id, id) AS seed_id, part_number FROM seed_parts")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "seed_parts").select("id", F.coalesce("seed_id", "id").alias("seed_id"), "part_number")


@query("A13", "SELECT id AS value, part_name AS label FROM parts WHERE is_active ORDER BY part_name, id LIMIT 200")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").where("is_active").orderBy("part_name", "id").limit(200).select(F.col("id").alias("value"), F.col("part_name").alias("label"))


@query("A15", "SELECT id, date FROM (SELECT id, date, customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY date DESC, id DESC) AS n FROM invoices WHERE customer_id IS NOT NULL) WHERE n <= 3")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    rows = frame(spark, sf, "invoices").where("customer_id IS NOT NULL")
    return S.top(rows, ["customer_id"], [F.col("date").desc(), F.col("id").desc()], 3).select("id", "date")


@query("B01", "SELECT id FROM units WHERE family = 'DD' AND manufacturer = 'Hitachi'")
def b01(spark: SparkSession, sf: str) -> DataFrame:
    return S.where_equal(frame(spark, sf, "units"), family="DD", manufacturer="Hitachi", unit_type="").select("id")


@query("B02", "SELECT id FROM parts WHERE contains(lower(part_name), 'green') OR contains(lower(oem), 'green') OR contains(lower(notes), 'green') UNION ALL SELECT -id FROM parts WHERE contains(lower(notes), '%') UNION ALL SELECT id + 1000000000 FROM parts WHERE contains(lower(part_name), 'all wid') OR contains(lower(oem), 'all wid')")
def b02(spark: SparkSession, sf: str) -> DataFrame:
    """By an index of trigrams; a query's wildcards are characters like others."""
    index = Index(spark, own_folder(spark, "index"), {"parts": (frame(spark, sf, "parts"), "id", ["part_name", "oem", "notes"])})
    literal = index.search("parts", "%", ["notes"]).select((-F.col("id")).alias("id"))
    within = index.search("parts", "all wid", ["part_name", "oem"]).select((F.col("id") + 1_000_000_000).alias("id"))
    return index.search("parts", " Green ").select("id").unionByName(literal).unionByName(within)


@query("B03", "SELECT id FROM cross_references WHERE starts_with(lower(cross_ref_number), 'x1') AND ends_with(cross_ref_number, '-')")
def b03(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("cross_ref_number")
    return frame(spark, sf, "cross_references").where(F.lower(n).startswith("x1") & n.endswith("-")).select("id")


@query("B04", "SELECT id FROM parts WHERE part_number IS NULL OR part_number <> ''")
def b04(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").where(~F.coalesce(F.col("part_number") == "", F.lit(False))).select("id")


@query("B05", "SELECT id FROM units WHERE family IN ('DD', 'PMGR') AND id IN (SELECT customer_id FROM invoices WHERE status = 'PAID')")
def b05(spark: SparkSession, sf: str) -> DataFrame:
    paid = frame(spark, sf, "invoices").where("status = 'PAID'").select(F.col("customer_id").alias("id"))
    return frame(spark, sf, "units").where(F.col("family").isin("DD", "PMGR")).join(paid, "id", "left_semi").select("id")


@query("B06", "SELECT id, stock_quantity, reorder_qty FROM parts WHERE stock_quantity <= reorder_qty AND is_active")
def b06(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").where((F.col("stock_quantity") <= F.col("reorder_qty")) & F.col("is_active")).select("id", "stock_quantity", "reorder_qty")


@query("B07", "SELECT id FROM invoices WHERE date >= date '1995-01-01' AND date <= date '1995-06-30'")
def b07(spark: SparkSession, sf: str) -> DataFrame:
    return S.between_dates(frame(spark, sf, "invoices"), "date", "1995-01-01", "1995-06-30").select("id")


@query("B08", "SELECT id, part_number IS NULL AS missing, coalesce(part_number = '', false) AS blank FROM parts WHERE part_number IS NULL OR part_number = ''")
def b08(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("part_number")
    return frame(spark, sf, "parts").where(n.isNull() | (n == "")).select("id", n.isNull().alias("missing"), F.coalesce(n == "", F.lit(False)).alias("blank"))


@query("B09", "SELECT id FROM applications WHERE regexp_matches(year, '^[0-9]{2}-[0-9]{2}') AND regexp_matches(name, '(?i)RED|blue')")
def b09(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").where(F.col("year").rlike("^[0-9]{2}-[0-9]{2}") & F.col("name").rlike("(?i)RED|blue")).select("id")


@query("B10", "SELECT id, 'range' AS search FROM applications WHERE contains(year, '1999') OR contains(year, '2000') OR contains(year, '2001') UNION ALL SELECT id, 'short' FROM applications WHERE contains(year, '1985') UNION ALL SELECT id, 'long' FROM applications WHERE contains(year, '1990-1990')")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    a, year = frame(spark, sf, "applications"), F.col("year")
    hits = [a.where(Y.year_filter(year, raw)).select("id", F.lit(name).alias("search")) for raw, name in (("01-99", "range"), ("85", "short"), ("1990-1990", "long"))]
    return hits[0].unionByName(hits[1]).unionByName(hits[2])


@query("B11", "SELECT event_id FROM events WHERE contains(lower(json_extract_string(props, '$.k')), '7')")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(T.contains_text(F.get_json_object("props", "$.k"), "7")).select("event_id")


@query("B12", "SELECT id FROM units WHERE is_active")
def b12(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "units").where("is_active").select("id")


@query("B13", "SELECT id FROM units WHERE unit_type = ''")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    wanted = "__blank__"
    return frame(spark, sf, "units").where(F.col("unit_type") == ("" if wanted == "__blank__" else wanted)).select("id")


@query("B14", "SELECT id, pos FROM parts JOIN (VALUES (42, 0), (7, 1), (19, 2), (3, 3)) AS w(wid, pos) ON id = wid")
def b14(spark: SparkSession, sf: str) -> DataFrame:
    return S.by_ids(frame(spark, sf, "parts"), "42,7, x ,19,7,,3,-1").select("id", "pos")


@query("B15", "SELECT id, coalesce(nullif(part_number, ''), nullif(yt_number, ''), 'Part #' || cast(id AS string)) AS label FROM parts")
def b15(spark: SparkSession, sf: str) -> DataFrame:
    label = F.coalesce(T.first_non_blank(F.col("part_number"), F.col("yt_number")), F.concat(F.lit("Part #"), F.col("id")))
    return frame(spark, sf, "parts").select("id", label.alias("label"))


@query("B16", "SELECT 'unit' AS tab, id FROM units WHERE contains(lower(manufacturer), 'ma') AND contains(lower(family), 'd') UNION ALL SELECT 'application', id FROM applications WHERE contains(lower(make), 'brand#1') AND contains(lower(model), '3') UNION ALL SELECT 'part', id FROM parts WHERE contains(lower(category), 'steel') AND contains(lower(oem), '3')")
def b16(spark: SparkSession, sf: str) -> DataFrame:
    def tab(name: str, **fields: str) -> DataFrame:
        df = frame(spark, sf, name + "s")
        for c, q in fields.items():
            df = S.search(df, q, [c])
        return df.select(F.lit(name).alias("tab"), "id")

    return tab("unit", manufacturer="ma", family="d").unionByName(tab("application", make="Brand#1", model="3")).unionByName(tab("part", category="STEEL", oem="3"))


@query("B17", "SELECT p.id, coalesce(nullif(part_number, ''), nullif(yt_number, ''), nullif(j_and_n, '')) IS NOT NULL AS valid, v.id AS vendor FROM parts p LEFT JOIN vendors v ON lower(v.name) = lower('SUPPLIER#' || lpad(cast(p.vendor_id AS string), 9, '0'))")
def b17(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, "parts").withColumn("key", F.lower(F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("vendor_id").cast("string"), 9, "0"))))
    v = frame(spark, sf, "vendors").select(F.lower("name").alias("key"), F.col("id").alias("vendor"))
    valid = T.first_non_blank(F.col("part_number"), F.col("yt_number"), F.col("j_and_n")).isNotNull()
    return p.join(v, "key", "left").select("id", valid.alias("valid"), "vendor")


@query("B18", "SELECT u.id, CASE count(b.id) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS route, CASE WHEN count(b.id) = 1 THEN min(b.id) END AS bom_id FROM units u LEFT JOIN boms b ON b.unit_id = u.id GROUP BY u.id")
def b18(spark: SparkSession, sf: str) -> DataFrame:
    n = frame(spark, sf, "boms").groupBy(F.col("unit_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    count = F.coalesce("n", F.lit(0))
    return frame(spark, sf, "units").select("id").join(n, "id", "left").select("id", F.when(count == 0, "none").when(count == 1, "one").otherwise("many").alias("route"), F.when(count == 1, F.col("only")).alias("bom_id"))


@query("B19", "SELECT id, description FROM bom_items WHERE bom_id IN (3, 7) AND id IN (SELECT id FROM bom_items WHERE unit_qty > 20)")
def b19(spark: SparkSession, sf: str) -> DataFrame:
    items = frame(spark, sf, "bom_items").where("bom_id IN (3, 7)")
    wanted = frame(spark, sf, "bom_items").where("unit_qty > 20").select("id")
    return items.join(wanted, "id", "left_semi").orderBy("bom_id", "id").select("id", "description")


@query("F01", "SELECT id, row_number() OVER (ORDER BY nullif(yt_number, '') NULLS LAST, nullif(part_number, '') NULLS LAST, id) AS place FROM parts ORDER BY place LIMIT 100")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    first = frame(spark, sf, "parts").orderBy(*S.blanks_last("yt_number", "part_number"), "id").limit(100)
    return numbered(first.select("id"), "place", [])


def numbered(df: DataFrame, name: str, order: list) -> DataFrame:
    """A short ordered result with its places; only for results of a fixed limit."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.orderBy(*(order or [F.monotonically_increasing_id()])))
    return df.withColumn(name, at)


@query("F02", "SELECT id, CASE WHEN contains(lower(part_name), 'red') THEN 0 ELSE 1 END AS tier FROM parts WHERE contains(lower(part_name), 'red') OR contains(lower(notes), 'steel') ORDER BY tier, nullif(yt_number, '') NULLS LAST, id LIMIT 50")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    direct, deep = T.contains_text(F.col("part_name"), "red"), T.contains_text(F.col("notes"), "steel")
    return frame(spark, sf, "parts").where(direct | deep).withColumn("tier", S.tier(direct)).orderBy("tier", *S.blanks_last("yt_number"), "id").limit(50).select("id", "tier")


@query("F03", "SELECT id FROM units ORDER BY CASE WHEN starts_with(lower(manufacturer), 'j&n') THEN 0 ELSE 1 END, manufacturer, id LIMIT 40")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.when(F.lower("manufacturer").startswith("j&n"), 0).otherwise(1)
    return frame(spark, sf, "units").orderBy(brand, "manufacturer", "id").limit(40).select("id")


_ORDERS = {"urgent": ["stock_quantity", "part_name", "id"], "part": ["part_name", "id"], "supplier": ["vendor_id", "part_name", "id"]}


@query("F04", "SELECT * FROM (SELECT id, 'urgent' AS sort FROM parts ORDER BY stock_quantity, part_name, id LIMIT 20) UNION ALL SELECT * FROM (SELECT id, 'supplier' FROM parts ORDER BY vendor_id, part_name, id LIMIT 20) UNION ALL SELECT * FROM (SELECT id, 'unknown' FROM parts ORDER BY id LIMIT 20)")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, "parts")
    lists = [p.orderBy(*_ORDERS.get(s, ["id"])).limit(20).select("id", F.lit(s).alias("sort")) for s in ("urgent", "supplier", "unknown")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


@query("F05", "SELECT i.id FROM bom_items i LEFT JOIN parts p ON i.part_id = p.id ORDER BY lower(coalesce(nullif(i.description, ''), p.part_name)) NULLS LAST, i.id LIMIT 60")
def f05(spark: SparkSession, sf: str) -> DataFrame:
    i, p = frame(spark, sf, "bom_items"), frame(spark, sf, "parts").select(F.col("id").alias("part_id"), "part_name")
    shown = F.lower(F.coalesce(T.nullif_blank(F.col("description")), F.col("part_name")))
    return i.join(p, "part_id", "left").orderBy(shown.asc_nulls_last(), "id").limit(60).select("id")


@query("F06", "SELECT id, 'third' AS page FROM (SELECT id FROM parts ORDER BY part_name, id LIMIT 25 OFFSET 50) UNION ALL SELECT id, 'past' FROM (SELECT id, row_number() OVER (ORDER BY part_name, id) AS n, count(*) OVER () AS c FROM parts) WHERE n > ((c + 24) // 25 - 1) * 25 UNION ALL SELECT * FROM (SELECT id, 'bad' FROM parts ORDER BY part_name, id LIMIT 25) UNION ALL SELECT id, 'middle' FROM (SELECT id, row_number() OVER (ORDER BY part_name, id) - 1 AS n, count(*) OVER () AS c FROM parts) WHERE n // 25 = (c // 50)")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a stored order: the third, one far past the end, one for a bad number, and one in the middle."""
    p = frame(spark, sf, "parts")
    index = S.PageIndex(p.select("id", "part_name"), [F.col("part_name"), F.col("id")], own_folder(spark, "pages"))
    middle = (index.bounds[-1][1] + 1) // 50 + 1 if index.bounds else 1
    wanted = {"third": 3, "past": 10**9, "bad": -4, "middle": middle}
    pages = [index.page(n, 25).select("id", F.lit(name).alias("page")) for name, n in wanted.items()]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


@query("F07", "SELECT count(*) AS total FROM applications WHERE is_active")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").where("is_active").agg(F.count(F.lit(1)).alias("total"))


_CHANGED = "(SELECT make, model, engine FROM applications WHERE is_active AND id % 7 <> 0 UNION ALL SELECT 'New ' || make, model, '' FROM applications WHERE id % 5 = 0)"


@query("F07b", f"SELECT '*' AS name, '' AS value, count(*) AS n FROM {_CHANGED} UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', {c}, count(*) FROM {_CHANGED} WHERE {c} <> '' GROUP BY {c}" for c in ("make", "model", "engine")))
def f07b(spark: SparkSession, sf: str) -> DataFrame:
    """The stored total and dropdown values after some rows were deleted and others inserted; the last change comes twice."""
    rows = frame(spark, sf, "applications").select("id", "make", "model", "engine", "is_active")
    counts = ValueCounts(Store(spark, own_folder(spark, "counts")), ["make", "model", "engine"])
    counts.build(rows.where("is_active"))
    counts.merge("deleted", deleted=rows.where("is_active AND id % 7 = 0"))
    for _ in range(2):
        counts.merge("inserted", inserted=rows.where("id % 5 = 0").withColumns({"make": F.concat(F.lit("New "), "make"), "engine": F.lit("")}))
    return counts.current()


@query("F08", "SELECT id FROM units WHERE is_active ORDER BY manufacturer, id LIMIT 200")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "units").where("is_active").orderBy("manufacturer", "id").limit(200).select("id")


@query("F09", "SELECT id, CASE WHEN status IN ('PAID', 'CANCELLED') THEN '' WHEN date + 30 < date '1996-07-01' THEN 'overdue' WHEN date + 30 BETWEEN date '1996-07-01' AND date '1996-07-08' THEN 'due-soon' ELSE '' END AS highlight FROM invoices")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    due, as_of = F.date_add("date", 30), F.lit("1996-07-01").cast("date")
    mark = F.when(F.col("status").isin("PAID", "CANCELLED"), "").when(due < as_of, "overdue").when(due <= F.date_add(as_of, 7), "due-soon").otherwise("")
    return frame(spark, sf, "invoices").select("id", mark.alias("highlight"))


@query("G01", "SELECT DISTINCT manufacturer FROM units WHERE is_active AND manufacturer <> ''")
def g01(spark: SparkSession, sf: str) -> DataFrame:
    return S.dropdown(frame(spark, sf, "units"), "manufacturer")


@query("G02", "SELECT DISTINCT model FROM applications WHERE is_active AND make = 'Brand#12' AND model <> '' AND contains(lower(model), '1')")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    return S.dropdown(S.where_equal(frame(spark, sf, "applications"), make="Brand#12"), "model", "1")


@query("G03", "SELECT yt_number FROM parts INTERSECT SELECT yt_number FROM units")
def g03(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("yt_number").intersect(frame(spark, sf, "units").select("yt_number"))


@query("G04", "SELECT yt_number FROM parts EXCEPT SELECT yt_number FROM units WHERE is_active")
def g04(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").select("yt_number").subtract(frame(spark, sf, "units").where("is_active").select("yt_number"))


@query("G05", "SELECT part_id AS id FROM bom_items WHERE part_id IS NOT NULL UNION SELECT application_id FROM application_units")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    a = frame(spark, sf, "bom_items").where("part_id IS NOT NULL").select(F.col("part_id").alias("id"))
    return a.union(frame(spark, sf, "application_units").select("application_id")).distinct()


_HITS = [
    ("part", "parts", "part_number", "part_name"), ("part_yt", "parts", "yt_number", "part_name"), ("part_jn", "parts", "j_and_n", "part_name"),
    ("unit", "units", "unit_number", "manufacturer"), ("unit_yt", "units", "yt_number", "manufacturer"), ("application", "applications", "unit_number", "name"),
    ("xref", "cross_references", "cross_ref_number", "interchange_type"), ("substitute", "substitutes", "substitute_number", "substitute_number"),
]
#: Hits of each kind that a global search shows.
PER_KIND = 40


@query("G06", " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS kind, id, {n} AS number, {t} AS title FROM {v} WHERE contains(lower({n}), '12') ORDER BY {n}, id LIMIT {PER_KIND})" for k, v, n, t in _HITS))
def g06(spark: SparkSession, sf: str) -> DataFrame:
    tables = {view: (frame(spark, sf, view), "id", [n for _, v, n, _ in _HITS if v == view]) for _, view, _, _ in _HITS}
    index = Index(spark, own_folder(spark, "index"), tables)
    out = None
    for kind, view, number, title in _HITS:
        hits = index.search(view, "12", [number]).select(F.lit(kind).alias("kind"), "id", F.col(number).alias("number"), F.col(title).alias("title"))
        hits = hits.orderBy("number", "id").limit(PER_KIND)
        out = hits if out is None else out.unionByName(hits)
    return out.dropDuplicates(["kind", "id"])


#: Lookups of a number: what is matched, and the most ids: one that the first stage fills, one that only the last does, and more than there are.
_LOOKUPS = [("reference", "10", 7), ("reference", "10", 60), ("reference", "10", 100_000), ("reference", "x12", 40), ("substitute", "s5", 7), ("substitute", "5", 60), ("substitute", "5", 100_000)]


def _lookup_sql(kind: str, q: str, most: int) -> str:
    """Rows in the order in which they are read; an id counts where it comes first."""
    if kind == "reference":
        table, other, starts = "cross_references", "cross_ref_unit_id", [f"starts_with(lower({c}), '{q}')" for c in ("cross_ref_number", "interchange_type")]
        holds = " OR ".join(f"(contains(lower({c}), '{q}') AND NOT starts_with(lower({c}), '{q}'))" for c in ("cross_ref_number", "interchange_type"))
    else:
        table, other, starts = "substitutes", "substitute_unit_id", [f"starts_with(lower(substitute_number), '{q}')"]
        holds = f"contains(lower(substitute_number), '{q}') AND NOT starts_with(lower(substitute_number), '{q}')"
    last = len(starts)
    early = " UNION ALL ".join(f"SELECT {n} AS stage, id AS place, unit_id, {other} AS other FROM {table} WHERE {w}" for n, w in enumerate(starts))
    ids = lambda rows: f"SELECT stage, place, 0 AS e, unit_id AS id FROM {rows} WHERE unit_id IS NOT NULL UNION ALL SELECT stage, place, 1, other FROM {rows} WHERE other IS NOT NULL"
    return f"""SELECT '{kind}' AS kind, '{q}' AS q, {most} AS most, id, stage, cast(row_number() OVER (ORDER BY stage, place, e) AS int) AS rank FROM (
  WITH early AS ({early}), had AS (SELECT count(DISTINCT id) AS n FROM ({ids("early")})),
  late AS (SELECT {last} AS stage, id AS place, unit_id, {other} AS other FROM {table} WHERE {holds} QUALIFY row_number() OVER (ORDER BY id) <= 3 * greatest(0, {most} - (SELECT n FROM had))),
  every_row AS (SELECT * FROM early UNION ALL SELECT * FROM late),
  firsts AS (SELECT id, min(struct_pack(stage := stage, place := place, e := e)) AS f FROM ({ids("every_row")}) GROUP BY id),
  counted AS (SELECT f.stage AS stage, f.place AS place, f.e AS e, id, sum(count(*)) OVER (ORDER BY f.stage, f.place) - count(*) AS before FROM firsts GROUP BY f.stage, f.place, f.e, id)
  SELECT * FROM (SELECT stage, place, e, id, min(row_number) OVER (PARTITION BY stage, place) AS begins FROM (SELECT *, row_number() OVER (ORDER BY stage, place, e) AS row_number FROM counted)) WHERE begins <= {most})"""


def _lookup(spark: SparkSession, sf: str, kind: str, q: str, most: int) -> DataFrame:
    """(id, stage, rank): rows that begin with a number, then those whose maker does, then those that hold it, until there are enough units."""
    within = lambda c: c.contains(q) & ~c.startswith(q)
    if kind == "reference":
        x, number, maker = frame(spark, sf, "cross_references"), F.lower("cross_ref_number"), F.lower("interchange_type")
        return S.accumulated([x.where(number.startswith(q)), x.where(maker.startswith(q)), x.where(within(number) | within(maker))], ["unit_id", "cross_ref_unit_id"], "id", most)
    s, number = frame(spark, sf, "substitutes"), F.lower("substitute_number")
    return S.accumulated([s.where(number.startswith(q)), s.where(within(number))], ["unit_id", "substitute_unit_id"], "id", most)


@query("G07", " UNION ALL ".join(f"SELECT * FROM ({_lookup_sql(*x)})" for x in _LOOKUPS))
def g07(spark: SparkSession, sf: str) -> DataFrame:
    """Units that a number leads to, with limits that are met early, late and never."""
    found = [_lookup(spark, sf, kind, q, most).select(F.lit(kind).alias("kind"), F.lit(q).alias("q"), F.lit(most).alias("most"), "id", "stage", "rank") for kind, q, most in _LOOKUPS]
    return functools.reduce(DataFrame.unionByName, found)


#: A direct search, one that finds something only in related tables or texts, and one too short for that.
_TIERED = ("mf11", "x117", "z7", "tomato", "u1")
_SORTED = "ORDER BY tier, nullif(yt_number, '') NULLS LAST, nullif(part_number, '') NULLS LAST, id"


def _tiered_sql(q: str) -> str:
    has = lambda *cols: "(" + " OR ".join(f"coalesce(contains(lower({c}), '{q}'), false)" for c in cols) + ")"
    direct, texts = has("manufacturer_number", "yt_number", "j_and_n", "oem"), has("part_number", "part_name", "notes", "voltage")
    units = f"(SELECT id FROM units WHERE {has('unit_number')})"
    related = f"""SELECT part_id FROM part_owners WHERE unit_id IN {units} UNION ALL SELECT part_id FROM part_units WHERE unit_id IN {units}
      UNION ALL SELECT unnest([part_id, interchange_part_id]) FROM part_interchanges WHERE {has("interchange_number")} UNION ALL SELECT part_id FROM part_supersedings WHERE {has("old_part_number")}"""
    deep = f"({texts} OR id IN (SELECT part_id FROM ({related}) WHERE part_id IS NOT NULL))" if len(q) >= 3 else "false"
    return f"""SELECT '{q}' AS q, id, tier, cast(row_number() OVER ({_SORTED}) AS int) AS rank FROM (SELECT *, CASE WHEN {direct} THEN 0 ELSE 1 END AS tier FROM parts
      WHERE is_active AND ({direct} OR ({deep} AND NOT EXISTS (SELECT 1 FROM parts WHERE is_active AND {direct})))) {_SORTED} LIMIT 50"""


@query("F02b", " UNION ALL ".join(f"SELECT * FROM ({_tiered_sql(q)})" for q in _TIERED))
def f02b(spark: SparkSession, sf: str) -> DataFrame:
    """First pages of the part list's search: numbers of the part itself, and only where none has it, its texts, units, interchanges and earlier numbers."""
    p = frame(spark, sf, "parts").where("is_active")
    tables = {n: frame(spark, sf, n) for n in ("units", "part_owners", "part_units", "part_interchanges", "part_supersedings")}
    out = None
    for q in _TIERED:
        has = lambda *cols: T.any_of([F.coalesce(T.contains_text(F.col(c), q), F.lit(False)) for c in cols])  # noqa: B023, E731  used at once
        units = tables["units"].where(has("unit_number")).select(F.col("id").alias("unit_id"))
        ends = F.explode(F.array("part_id", "interchange_part_id")).alias("id")
        related = [tables[n].join(units, "unit_id", "left_semi").select(F.col("part_id").alias("id")) for n in ("part_owners", "part_units")]
        related += [tables["part_interchanges"].where(has("interchange_number")).select(ends), tables["part_supersedings"].where(has("old_part_number")).select(F.col("part_id").alias("id"))]
        ids = related[0]
        for more in related[1:]:
            ids = ids.unionByName(more)
        known = p.join(ids.where("id IS NOT NULL").distinct().withColumn("_related", F.lit(True)), "id", "left")
        deep = has("part_number", "part_name", "notes", "voltage") | F.col("_related")
        order = [F.col("tier"), *S.blanks_last("yt_number", "part_number"), F.col("id")]
        page = S.tiered(known, has("manufacturer_number", "yt_number", "j_and_n", "oem"), deep, q).orderBy(*order).limit(50)
        page = page.select(F.lit(q).alias("q"), "id", "tier", F.row_number().over(Window.orderBy(*order)).alias("rank"))
        out = page if out is None else out.unionByName(page)
    return out


#: A search that a unit's yt number meets, one that meets a maker and what leads to units, one that only leads to them, and one too short for that.
_UNIT_SEARCHES = ("yt12", "ford", "hitachi", "x117", "s5")
#: Fixed value: the most units that related numbers lead to.
MOST_RELATED = 10_000
_UNIT_SORTED = "ORDER BY tier, nullif(yt_number, '') NULLS LAST, nullif(unit_number, '') NULLS LAST, id"


def _units_sql(q: str) -> str:
    has = lambda *cols: "(" + " OR ".join(f"coalesce(contains(lower({c}), '{q}'), false)" for c in cols) + ")"
    direct = has("unit_number", "yt_number", "manufacturer")
    related = " UNION ALL ".join(f"SELECT id FROM ({_lookup_sql(kind, q, MOST_RELATED)})" for kind in ("reference", "substitute"))
    deep = f"({has('family', 'unit_type')} OR id IN ({related}))" if len(q) >= 3 else "false"
    return f"""SELECT '{q}' AS q, id, tier, cast(row_number() OVER ({_UNIT_SORTED}) AS int) AS rank FROM (SELECT *, CASE WHEN {direct} THEN 0 ELSE 1 END AS tier FROM units
      WHERE is_active AND ({direct} OR ({deep} AND NOT EXISTS (SELECT 1 FROM units WHERE is_active AND {has("yt_number")}))) {_UNIT_SORTED} LIMIT 50)"""


@query("F02c", " UNION ALL ".join(f"SELECT * FROM ({_units_sql(q)})" for q in _UNIT_SEARCHES))
def f02c(spark: SparkSession, sf: str) -> DataFrame:
    """First pages of the unit list's search: numbers and makers of the unit, and where no yt number has it, its other texts and what references and substitutes lead to."""
    u = frame(spark, sf, "units").where("is_active")
    pages = []
    for q in _UNIT_SEARCHES:
        has = lambda *cols: T.any_of([F.coalesce(T.contains_text(F.col(c), q), F.lit(False)) for c in cols])  # noqa: B023, E731  used at once
        known, deep = u, has("family", "unit_type")
        if len(q) >= 3:
            ids = functools.reduce(DataFrame.unionByName, [_lookup(spark, sf, kind, q, MOST_RELATED).select("id") for kind in ("reference", "substitute")])
            known = u.join(ids.distinct().withColumn("_related", F.lit(True)), "id", "left")
            deep = deep | F.coalesce("_related", F.lit(False))
        order = [F.col("tier"), *S.blanks_last("yt_number", "unit_number"), F.col("id")]
        page = S.tiered(known, has("unit_number", "yt_number", "manufacturer"), deep, q, probe=has("yt_number")).orderBy(*order).limit(50)
        pages.append(page.select(F.lit(q).alias("q"), "id", "tier", F.row_number().over(Window.orderBy(*order)).alias("rank")))
    return functools.reduce(DataFrame.unionByName, pages)
