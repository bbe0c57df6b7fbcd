"""Joins, aggregates and window-shaped logic (groups C, D and E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from partloom.functions import money as M, text as T
from partloom.operators import relations as R, search as S
from partloom.operators.lineage import own_folder
from partloom.operators.substrings import Index
from partloom.plans.domain import frame
from partloom.plans.registry import query


@query("C01", "SELECT i.id, i.invoice_number, b.name FROM invoices i LEFT JOIN bill_to b ON i.customer_id = b.id")
def c01(spark: SparkSession, sf: str) -> DataFrame:
    b = frame(spark, sf, "bill_to").select(F.col("id").alias("customer_id"), "name")
    return frame(spark, sf, "invoices").select("id", "invoice_number", "customer_id").join(b, "customer_id", "left").drop("customer_id")


@query("C02", "SELECT id FROM boms WHERE id IN (SELECT bom_id FROM bom_items WHERE contains(lower(description), 'item 12'))")
def c02(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.search(frame(spark, sf, "bom_items"), "item 12", ["description"]).select(F.col("bom_id").alias("id"))
    return frame(spark, sf, "boms").join(hits, "id", "left_semi").select("id")


@query("C03", "SELECT id FROM applications a WHERE contains(lower(a.name), 'red') OR a.id IN (SELECT application_id FROM application_units au JOIN units u ON au.unit_id = u.id WHERE contains(lower(u.unit_number), 'u2'))")
def c03(spark: SparkSession, sf: str) -> DataFrame:
    units = S.search(frame(spark, sf, "units"), "u2", ["unit_number"]).select(F.col("id").alias("unit_id"))
    linked = frame(spark, sf, "application_units").join(units, "unit_id", "left_semi").select(F.col("application_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    own = T.contains_text(F.col("name"), "red")
    return frame(spark, sf, "applications").join(linked, "id", "left").where(own | F.col("linked")).select("id")


@query("C04", "SELECT id FROM applications WHERE id NOT IN (SELECT application_id FROM application_units WHERE unit_id = 3)")
def c04(spark: SparkSession, sf: str) -> DataFrame:
    linked = frame(spark, sf, "application_units").where("unit_id = 3").select(F.col("application_id").alias("id"))
    return frame(spark, sf, "applications").join(linked, "id", "left_anti").select("id")


@query("C05", "SELECT b.id FROM boms b WHERE NOT EXISTS (SELECT 1 FROM bom_items i WHERE i.bom_id = b.id AND i.part_id IS NOT NULL AND i.unit_qty > 25) AND EXISTS (SELECT 1 FROM boms o JOIN bom_items i ON i.bom_id = o.id WHERE o.unit_id = b.unit_id AND o.id <> b.id AND i.part_id IS NOT NULL AND i.unit_qty > 25)")
def c05(spark: SparkSession, sf: str) -> DataFrame:
    """Shells: without a real item, while another BOM of the unit has one. A shell's unit has a real BOM only if it is another one."""
    real = frame(spark, sf, "bom_items").where("part_id IS NOT NULL AND unit_qty > 25").select(F.col("bom_id").alias("id"))
    boms = frame(spark, sf, "boms").select("id", "unit_id")
    units = boms.join(real, "id", "left_semi").select("unit_id")
    return boms.join(real, "id", "left_anti").join(units, "unit_id", "left_semi").select("id")


@query("C06", "SELECT s.id FROM seed_parts s WHERE s.seed_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM target_parts t WHERE t.seed_id = s.seed_id)")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "seed_parts").where("seed_id IS NOT NULL").join(frame(spark, sf, "target_parts").select("seed_id"), "seed_id", "left_anti").select("id")


@query("C07", "SELECT t.id, coalesce((SELECT max(s.oem) FROM seed_parts s WHERE s.seed_id = t.seed_id), t.oem) AS oem FROM target_parts t")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    s = frame(spark, sf, "seed_parts").groupBy("seed_id").agg(F.max("oem").alias("new"))
    return frame(spark, sf, "target_parts").select("id", "seed_id", "oem").join(s, "seed_id", "left").select("id", F.coalesce("new", "oem").alias("oem"))


@query("C08", "SELECT s.id AS shell, min(r.id) AS real FROM units s JOIN units r ON s.yt_number = r.yt_number AND s.id <> r.id WHERE s.yt_number <> '' AND s.unit_number IS NULL AND r.unit_number IS NOT NULL AND r.manufacturer <> 'J&N' GROUP BY s.id")
def c08(spark: SparkSession, sf: str) -> DataFrame:
    u = frame(spark, sf, "units").where("yt_number <> ''")
    shells = u.where("unit_number IS NULL").select(F.col("id").alias("shell"), "yt_number")
    real = u.where("unit_number IS NOT NULL AND manufacturer <> 'J&N'").groupBy("yt_number").agg(F.min("id").alias("real"))
    return shells.join(real, "yt_number").select("shell", "real")


@query("C09", "SELECT s.pos, u.id AS unit_id FROM staging_applications s LEFT JOIN units u ON s.part_number = u.unit_number")
def c09(spark: SparkSession, sf: str) -> DataFrame:
    u = frame(spark, sf, "units").where("unit_number IS NOT NULL").select(F.col("unit_number").alias("part_number"), F.col("id").alias("unit_id"))
    return frame(spark, sf, "staging_applications").select("pos", "part_number").join(u, "part_number", "left").select("pos", "unit_id")


def routed(spark: SparkSession, sf: str) -> DataFrame:
    units, parts = frame(spark, sf, "units"), frame(spark, sf, "parts")
    targets = [("unit_number", units, "unit_number", "id"), ("part_yt", parts, "yt_number", "id"), ("unit_yt", units, "yt_number", "id")]
    return R.resolve(frame(spark, sf, "staging_interchange"), F.col("our_number"), targets)


ROUTED_SQL = """
SELECT s.*, CASE WHEN u.id IS NOT NULL THEN 'unit_number' WHEN p.id IS NOT NULL THEN 'part_yt' WHEN y.id IS NOT NULL THEN 'unit_yt' ELSE 'none' END AS route, coalesce(u.id, p.id, y.id) AS target_id
FROM staging_interchange s
LEFT JOIN (SELECT unit_number AS k, min(id) AS id FROM units WHERE unit_number <> '' GROUP BY 1) u ON u.k = nullif(s.our_number, '')
LEFT JOIN (SELECT yt_number AS k, min(id) AS id FROM parts WHERE yt_number <> '' GROUP BY 1) p ON p.k = nullif(s.our_number, '')
LEFT JOIN (SELECT yt_number AS k, min(id) AS id FROM units WHERE yt_number <> '' GROUP BY 1) y ON y.k = nullif(s.our_number, '')"""


@query("C10", f"SELECT pos, route, target_id FROM ({ROUTED_SQL})")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return routed(spark, sf).select("pos", "route", "target_id")


@query("C11", """SELECT p.id, c.name AS category FROM parts p LEFT JOIN (SELECT yt_number AS k, min(unit_type) AS t FROM units WHERE yt_number <> '' AND unit_type <> '' GROUP BY 1) a ON a.k = nullif(p.yt_number, '')
LEFT JOIN (SELECT unit_number AS k, min(unit_type) AS t FROM units WHERE unit_number <> '' AND unit_type <> '' GROUP BY 1) b ON b.k = 'U' || cast(p.id AS string)
JOIN (SELECT DISTINCT unit_type AS name FROM units WHERE unit_type <> '' AND unit_type <> 'MACHINERY' UNION SELECT 'Steel') c ON c.name = coalesce(a.t, b.t, CASE WHEN contains(lower(p.category), 'steel') THEN 'Steel' END)""")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    """Category by yt number, then by part number, then by keyword, kept only if it is a known one."""
    units = frame(spark, sf, "units").where("unit_type <> ''")
    by = lambda c, k: units.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(F.col(c).alias(k)).agg(F.min("unit_type").alias(f"t_{k}"))
    p = frame(spark, sf, "parts").select("id", "category", T.nullif_blank(F.col("yt_number")).alias("yt"), F.concat(F.lit("U"), F.col("id")).alias("pn"))
    found = p.join(by("yt_number", "yt"), "yt", "left").join(by("unit_number", "pn"), "pn", "left")
    best = F.coalesce("t_yt", "t_pn", F.when(T.contains_text(F.col("category"), "steel"), "Steel"))
    known = units.where("unit_type <> 'MACHINERY'").select(F.col("unit_type").alias("category")).distinct().union(spark.createDataFrame([("Steel",)], "category string"))
    return found.select("id", best.alias("category")).join(known, "category", "left_semi")


@query("C12", "SELECT identifier, min(id) AS id FROM (SELECT id, unnest([part_number, manufacturer_number, yt_number, j_and_n, oem]) AS identifier FROM parts) WHERE identifier <> '' GROUP BY identifier HAVING count(DISTINCT id) = 1")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    return R.unambiguous(frame(spark, sf, "parts"), "id", ["part_number", "manufacturer_number", "yt_number", "j_and_n", "oem"])


@query("C13", "SELECT x.id, p.id AS part FROM (SELECT id, regexp_replace('MF:' || cast(unit_id AS string), '^[A-Z]+:', '') AS n FROM cross_references WHERE interchange_type = 'WAI') x JOIN (SELECT manufacturer_number AS n, min(id) AS id FROM parts GROUP BY 1) p ON p.n = 'MF' || x.n")
def c13(spark: SparkSession, sf: str) -> DataFrame:
    x = frame(spark, sf, "cross_references").where("interchange_type = 'WAI'")
    bare = F.regexp_replace(F.concat(F.lit("MF:"), F.col("unit_id")), "^[A-Z]+:", "")
    p = frame(spark, sf, "parts").groupBy(F.col("manufacturer_number").alias("n")).agg(F.min("id").alias("part"))
    return x.select("id", F.concat(F.lit("MF"), bare).alias("n")).join(p, "n").select("id", "part")


@query("C14", "SELECT s.id FROM cross_references s WHERE EXISTS (SELECT 1 FROM cross_references l WHERE l.unit_id = s.unit_id AND starts_with(l.cross_ref_number, s.cross_ref_number) AND length(l.cross_ref_number) > length(s.cross_ref_number))")
def c14(spark: SparkSession, sf: str) -> DataFrame:
    x = frame(spark, sf, "cross_references").select("id", "unit_id", "cross_ref_number")
    return R.with_prefix_of(x, x, ["unit_id"], "cross_ref_number").select("id")


@query("C15", "SELECT DISTINCT s.substitute_number FROM substitutes s WHERE EXISTS (SELECT 1 FROM substitutes l WHERE starts_with(l.substitute_number, s.substitute_number) AND length(l.substitute_number) > length(s.substitute_number))")
def c15(spark: SparkSession, sf: str) -> DataFrame:
    s = frame(spark, sf, "substitutes").select("substitute_number")
    return R.with_prefix_anywhere(s.distinct(), s, "substitute_number")


@query("C16", "SELECT DISTINCT node, other FROM (SELECT unit_id AS node, substitute_unit_id AS other FROM substitutes WHERE substitute_unit_id IS NOT NULL UNION ALL SELECT substitute_unit_id, unit_id FROM substitutes WHERE substitute_unit_id IS NOT NULL) WHERE node <> other")
def c16(spark: SparkSession, sf: str) -> DataFrame:
    return R.both_ends(frame(spark, sf, "substitutes").where("substitute_unit_id IS NOT NULL"), "unit_id", "substitute_unit_id", []).where("node <> other").distinct()


@query("C17", "SELECT a.id AS original, y.i AS copy, au.unit_id FROM applications a JOIN (VALUES (0), (1)) AS y(i) ON true JOIN application_units au ON au.application_id = a.id WHERE contains(a.year, ' | ')")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    """The links of an application that is split by years go to each of its copies."""
    copies = frame(spark, sf, "applications").where(F.col("year").contains(" | ")).select(F.col("id").alias("original"), F.posexplode(F.split("year", r" \| ")).alias("copy", "segment"))
    links = frame(spark, sf, "application_units").select(F.col("application_id").alias("original"), "unit_id")
    return copies.join(links, "original").select("original", "copy", "unit_id")


#: What a related-number search looks at, by table: its own columns, and columns of the part or unit that it points to.
_RELATED = {
    "part_interchanges": (("interchange_number", "source_name", "notes"), "interchange_part_id"),
    "part_supersedings": (("old_part_number", "notes"), "old_part_id"),
    "part_substitutes": (("substitute_number", "notes"), "substitute_part_id"),
    "bom_items": (("oem_number", "j_and_n", "yt_number", "description", "notes", "bin_number"), None),
}
_NUMBERS = {"parts": ("part_number", "yt_number"), "units": ("unit_number", "yt_number")}
_HAS = lambda cols: " OR ".join(f"contains(lower({c}), '117')" for c in cols)
_IDS = {t: f"(SELECT id FROM {t} WHERE {_HAS(cols)})" for t, cols in _NUMBERS.items()}
_PATHS = [f"SELECT part_id FROM {t} WHERE {_HAS(cols)}" + (f" OR {far} IN {_IDS['parts']}" if far else "") for t, (cols, far) in _RELATED.items()]
_PATHS += [f"SELECT part_id FROM {t} WHERE unit_id IN {_IDS['units']}" for t in ("part_owners", "part_units")]


@query("C18", f"SELECT id FROM parts WHERE id IN (SELECT part_id FROM ({' UNION ALL '.join(_PATHS)}) WHERE part_id IS NOT NULL)")
def c18(spark: SparkSession, sf: str) -> DataFrame:
    """Parts related to a number by any of 23 paths: each table's own texts, and numbers of the parts and units that it points to."""
    q = "117"
    searched = _NUMBERS | {t: cols for t, (cols, _) in _RELATED.items()}
    index = Index(spark, own_folder(spark, "index"), {t: (frame(spark, sf, t), "id", cols) for t, cols in searched.items()})
    hits = {t: index.search(t, q).select("id") for t in _NUMBERS}
    paths = []
    for t, (cols, far) in _RELATED.items():
        rows = frame(spark, sf, t)
        paths.append(index.search(t, q, cols).select("part_id"))
        if far:
            paths.append(rows.join(hits["parts"].withColumnRenamed("id", far), far, "left_semi").select("part_id"))
    for t in ("part_owners", "part_units"):
        paths.append(frame(spark, sf, t).join(hits["units"].withColumnRenamed("id", "unit_id"), "unit_id", "left_semi").select("part_id"))
    return R.with_any(frame(spark, sf, "parts").select("id"), "id", paths)


@query("C19", "SELECT b.id, count(i.id) AS n_items, coalesce(string_agg(cast(i.id AS string), ',' ORDER BY i.id), '') AS items FROM boms b LEFT JOIN bom_items i ON i.bom_id = b.id GROUP BY b.id")
def c19(spark: SparkSession, sf: str) -> DataFrame:
    items = frame(spark, sf, "bom_items").groupBy(F.col("bom_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.col("id"))).alias("ids"))
    return frame(spark, sf, "boms").select("id").join(items, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"))


@query("D01", "SELECT count(*) AS n FROM invoices WHERE status = 'SENT'")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "invoices").where("status = 'SENT'").agg(F.count(F.lit(1)).alias("n"))


@query("D02", "SELECT category, count(*) AS n FROM parts GROUP BY category")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "parts").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("D03", "SELECT make, model, engine, year, count(*) AS n, min(id) AS kept FROM applications GROUP BY ALL HAVING count(*) > 1".replace("GROUP BY ALL", "GROUP BY make, model, engine, year"))
def d03(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").groupBy("make", "model", "engine", "year").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("kept")).where("n > 1")


@query("D04", "SELECT b.id, count(i.id) AS n FROM boms b LEFT JOIN bom_items i ON i.bom_id = b.id AND i.unit_qty > 30 GROUP BY b.id HAVING count(i.id) = 0")
def d04(spark: SparkSession, sf: str) -> DataFrame:
    items = frame(spark, sf, "bom_items").where("unit_qty > 30").select(F.col("bom_id").alias("id"))
    return frame(spark, sf, "boms").select("id").join(items, "id", "left_anti").withColumn("n", F.lit(0).cast("long"))


#: A line's total in whole millionths, rounded half to even to cents without leaving integers.
_UNITS = "(quantity::bigint * cast(unit_price * 100 AS bigint) * (10000 - cast(discount_pct * 100 AS bigint)))"
_LINE = f"(({_UNITS} // 10000 + CASE WHEN {_UNITS} % 10000 > 5000 OR ({_UNITS} % 10000 = 5000 AND ({_UNITS} // 10000) % 2 = 1) THEN 1 ELSE 0 END)::decimal(18,0) * 0.01::decimal(3,2))"


def subtotals(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, subtotal) of every invoice: the totals of all its lines, 0 without any."""
    sums = lines.groupBy(F.col("invoice_id").alias("id")).agg(F.sum(M.line_total(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))).alias("s"))
    return invoices.select("id").join(sums, "id", "left").select("id", F.coalesce("s", F.lit(0)).cast("decimal(14,2)").alias("subtotal"))


@query("D05", f"SELECT i.id, cast(coalesce(sum(cast({_LINE} AS decimal(12,2))), 0) AS decimal(14,2)) AS subtotal FROM invoices i LEFT JOIN invoice_items l ON l.invoice_id = i.id GROUP BY i.id")
def d05(spark: SparkSession, sf: str) -> DataFrame:
    return subtotals(frame(spark, sf, "invoices"), frame(spark, sf, "invoice_items"))


@query("D06", "SELECT coalesce(max(ordering), 0) AS last FROM contacts WHERE vendor_id = -1 UNION ALL SELECT coalesce(max(ordering), 0) FROM contacts")
def d06(spark: SparkSession, sf: str) -> DataFrame:
    c = frame(spark, sf, "contacts")
    last = F.coalesce(F.max("ordering"), F.lit(0)).alias("last")
    return c.where("vendor_id = -1").agg(last).union(c.agg(last))


@query("D07", "SELECT cross_ref_number, interchange_type, min(id) AS id FROM cross_references GROUP BY cross_ref_number, interchange_type")
def d07(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cross_references").groupBy("cross_ref_number", "interchange_type").agg(F.min("id").alias("id"))


@query("D08", "SELECT count(DISTINCT make) AS makes, count(DISTINCT part_number) AS numbers, count(*) AS n FROM staging_applications")
def d08(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "staging_applications").agg(F.count_distinct("make").alias("makes"), F.count_distinct("part_number").alias("numbers"), F.count(F.lit(1)).alias("n"))


@query("D09", "SELECT our_number, count(*) AS n FROM staging_interchange GROUP BY our_number ORDER BY n DESC, our_number LIMIT 15")
def d09(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "staging_interchange").groupBy("our_number").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "our_number").limit(15)


@query("D10b", """WITH named AS (SELECT coalesce(nullif(i.customer_name, ''), b.name, '—') AS bill_to, i.id, i.total FROM invoices i LEFT JOIN bill_to b ON b.id = i.customer_id)
SELECT bill_to, 'group' AS level, NULL::bigint AS member, count(*) AS n, cast(sum(total) AS decimal(18,2)) AS total FROM named GROUP BY bill_to
UNION ALL SELECT 'TOTAL', 'total', NULL, count(*), cast(sum(total) AS decimal(18,2)) FROM named UNION ALL SELECT bill_to, 'member', id, 1, cast(total AS decimal(18,2)) FROM named""")
def d10b(spark: SparkSession, sf: str) -> DataFrame:
    """The summary by the stored name, else the customer's: a row for each group, each of its invoices, and the grand total, from one aggregate over all levels."""
    b = frame(spark, sf, "bill_to").select(F.col("id").alias("customer_id"), "name")
    named = frame(spark, sf, "invoices").join(b, "customer_id", "left").select(F.coalesce(T.nullif_blank(F.col("customer_name")), "name", F.lit("—")).alias("bill_to"), "id", "total")
    levels = named.rollup("bill_to", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("total").cast("decimal(18,2)").alias("total"), F.grouping_id().alias("_level"))
    level = F.when(F.col("_level") == 0, "member").when(F.col("_level") == 1, "group").otherwise("total")
    name = F.when(F.col("_level") == 3, "TOTAL").otherwise(F.col("bill_to"))
    return levels.select(name.alias("bill_to"), level.alias("level"), F.col("id").cast("long").alias("member"), "n", "total")


@query("D11", "SELECT size, count(*) AS groups FROM (SELECT bom_id, count(*) AS size FROM bom_items GROUP BY bom_id) GROUP BY size")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "bom_items").groupBy("bom_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


@query("D12", "SELECT make, model, string_agg(mfr, ' | ' ORDER BY p) AS mfr FROM (SELECT make, model, mfr, min(pos) AS p FROM staging_applications WHERE mfr <> '' GROUP BY 1, 2, 3) GROUP BY make, model")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    return R.ordered_concat(frame(spark, sf, "staging_applications"), ["make", "model"], "mfr", "pos", " | ")


@query("D13", "SELECT make, model, arg_min(options, pos) AS options, arg_min(part_number, pos) AS part_number FROM staging_applications GROUP BY make, model")
def d13(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "staging_applications").groupBy("make", "model").agg(F.min_by("options", "pos").alias("options"), F.min_by("part_number", "pos").alias("part_number"))


@query("D14", "SELECT 'no_number' AS field, sum((unit_number IS NULL)::bigint)::bigint AS n FROM units UNION ALL SELECT 'no_yt', sum((yt_number = '')::bigint)::bigint FROM units UNION ALL SELECT 'no_type', sum((unit_type = '')::bigint)::bigint FROM units")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    """All counts in one pass."""
    tests = {"no_number": F.col("unit_number").isNull(), "no_yt": F.col("yt_number") == "", "no_type": F.col("unit_type") == ""}
    one = frame(spark, sf, "units").agg(*[F.coalesce(F.sum(t.cast("long")), F.lit(0)).alias(n) for n, t in tests.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("n")) for n in tests])).alias("x")).select("x.field", "x.n")


@query("D15", "SELECT interchange_type AS category, CASE WHEN notes = '' THEN 'MISSING' WHEN starts_with(notes, 'R') THEN 'MISMATCH' ELSE 'MATCH' END AS status, count(*) AS n FROM cross_references GROUP BY 1, 2")
def d15(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("notes") == "", "MISSING").when(F.col("notes").startswith("R"), "MISMATCH").otherwise("MATCH")
    return frame(spark, sf, "cross_references").groupBy(F.col("interchange_type").alias("category"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("D16", "SELECT yt_number, count(*) AS n, count(DISTINCT nullif(oem, '')) AS brands, CASE count(DISTINCT nullif(oem, '')) WHEN 1 THEN 'merge' ELSE 'skip' END AS action FROM parts WHERE yt_number <> '' GROUP BY yt_number HAVING count(*) > 1")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    g = frame(spark, sf, "parts").where("yt_number <> ''").groupBy("yt_number").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(T.nullif_blank(F.col("oem"))).alias("brands"))
    return g.where("n > 1").withColumn("action", F.when(F.col("brands") == 1, "merge").otherwise("skip"))


@query("D17", "SELECT manufacturer_number, min(nullif(oem, '')) AS oem FROM parts WHERE oem <> '' GROUP BY manufacturer_number HAVING count(DISTINCT oem) = 1")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    g = frame(spark, sf, "parts").where("oem <> ''").groupBy("manufacturer_number").agg(F.count_distinct("oem").alias("n"), F.min("oem").alias("oem"))
    return g.where("n = 1").drop("n")


@query("D18", "SELECT p.id, p.stock_quantity, sum(greatest(l.quantity - 20, 0))::bigint AS wanted FROM parts p JOIN invoice_items l ON l.part_id = p.id GROUP BY p.id, p.stock_quantity HAVING sum(greatest(l.quantity - 20, 0)) > p.stock_quantity")
def d18(spark: SparkSession, sf: str) -> DataFrame:
    wanted = frame(spark, sf, "invoice_items").groupBy(F.col("part_id").alias("id")).agg(F.sum(F.greatest(F.col("quantity") - 20, F.lit(0))).alias("wanted"))
    return frame(spark, sf, "parts").select("id", "stock_quantity").join(wanted, "id").where("wanted > stock_quantity")


def _kept(sql_order: str, view: str, key: str) -> str:
    return f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {key} ORDER BY {sql_order}) AS n FROM {view}) WHERE n = 1"


@query("E01", _kept("length(notes) DESC, id", "cross_references", "unit_id, cross_ref_number"))
def e01(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_of(frame(spark, sf, "cross_references"), ["unit_id", "cross_ref_number"], [F.length("notes").desc(), F.col("id")]).select("id")


@query("E02", _kept("((coalesce(trim(part_number), '') <> '')::int + (coalesce(trim(oem), '') <> '')::int + (coalesce(trim(notes), '') <> '')::int + (coalesce(trim(voltage), '') <> '')::int + (cost_price IS NOT NULL)::int + (price IS NOT NULL)::int) DESC, id", "parts", "yt_number") + " AND id IN (SELECT id FROM parts WHERE yt_number <> '')")
def e02(spark: SparkSession, sf: str) -> DataFrame:
    score = R.completeness(["part_number", "oem", "notes", "voltage"], ["cost_price", "price"])
    return R.first_of(frame(spark, sf, "parts").where("yt_number <> ''").withColumn("score", score), ["yt_number"], [F.col("score").desc(), F.col("id")]).select("id")


_SIZED = "(SELECT b.id, b.unit_id, count(i.id) AS n FROM boms b LEFT JOIN bom_items i ON i.bom_id = b.id WHERE b.unit_id IS NOT NULL GROUP BY 1, 2)"


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    n = frame(spark, sf, "bom_items").groupBy(F.col("bom_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return frame(spark, sf, "boms").where("unit_id IS NOT NULL").select("id", "unit_id").join(n, "id", "left").fillna(0, ["n"])


@query("E03", _kept("n DESC, id", _SIZED, "unit_id"))
def e03(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_of(_sized(spark, sf), ["unit_id"], [F.col("n").desc(), F.col("id")]).select("id")


@query("E04", _kept("n DESC, id DESC", _SIZED, "unit_id"))
def e04(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_of(_sized(spark, sf), ["unit_id"], [F.col("n").desc(), F.col("id").desc()]).select("id")


@query("E05", "SELECT min(id) AS id FROM applications GROUP BY make, model, engine, year")
def e05(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "applications").groupBy("make", "model", "engine", "year").agg(F.min("id").alias("id")).select("id")


@query("E06", "SELECT application_id AS id, unit_number FROM (SELECT au.application_id, u.unit_number, row_number() OVER (PARTITION BY au.application_id ORDER BY u.unit_number NULLS LAST, u.id) AS n FROM application_units au JOIN units u ON u.id = au.unit_id WHERE u.unit_number IS NOT NULL) WHERE n = 1")
def e06(spark: SparkSession, sf: str) -> DataFrame:
    u = frame(spark, sf, "units").where("unit_number IS NOT NULL").select(F.col("id").alias("unit_id"), "unit_number")
    links = frame(spark, sf, "application_units").join(u, "unit_id")
    return links.groupBy(F.col("application_id").alias("id")).agg(F.min("unit_number").alias("unit_number"))


@query("E07", "SELECT vendor_id, id AS contact FROM (SELECT vendor_id, id, row_number() OVER (PARTITION BY vendor_id ORDER BY is_primary DESC, ordering, id) AS n FROM contacts) WHERE n = 1")
def e07(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_of(frame(spark, sf, "contacts"), ["vendor_id"], [F.col("is_primary").desc(), F.col("ordering"), F.col("id")]).select("vendor_id", F.col("id").alias("contact"))


FILLED_SQL = """
SELECT * REPLACE (coalesce(last_value(nullif(year, '') IGNORE NULLS) OVER w, '') AS year, coalesce(last_value(nullif(mfr, '') IGNORE NULLS) OVER w, '') AS mfr) FROM (
  SELECT *, sum(new) OVER (ORDER BY pos) AS run FROM (SELECT *, CASE WHEN make = lag(make) OVER (ORDER BY pos) AND model = lag(model) OVER (ORDER BY pos) AND engine = lag(engine) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS new FROM staging_applications))
WINDOW w AS (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return R.fill_down(frame(spark, sf, "staging_applications"), ["make", "model", "engine"], ["year", "mfr"], "pos")


@query("E08", f"SELECT pos, year, mfr FROM ({FILLED_SQL})")
def e08(spark: SparkSession, sf: str) -> DataFrame:
    """Runs are found in the order of the file."""
    return filled(spark, sf).select("pos", "year", "mfr")


@query("E09", "SELECT their_number, manufacturer, min(pos) AS pos FROM staging_interchange GROUP BY 1, 2")
def e09(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "staging_interchange").groupBy("their_number", "manufacturer").agg(F.min("pos").alias("pos"))


@query("E10", f"""SELECT id, page, cast(sum(total) OVER (PARTITION BY invoice_id, page) AS decimal(14,2)) AS page_total FROM (
  SELECT id, invoice_id, cast({_LINE} AS decimal(12,2)) AS total, CASE WHEN n <= 2 THEN 1 ELSE cast(2 + floor((n - 3) / 3) AS int) END AS page
  FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line_number, id) AS n FROM invoice_items))""")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of 2 and then 3 lines, since the test invoices are short."""
    lines = frame(spark, sf, "invoice_items").withColumn("total", M.line_total(F.col("quantity"), F.col("unit_price"), F.col("discount_pct")))
    paged = R.pages_of(lines, ["invoice_id"], [F.col("line_number"), F.col("id")], 2, 3)
    return paged.select("id", "page", F.sum("total").over(Window.partitionBy("invoice_id", "page")).cast("decimal(14,2)").alias("page_total"))


def page_links(number: Column, last: Column, around: int = 2) -> Column:
    """Page numbers to show about the current one, null for a gap."""
    near = F.sequence(F.greatest(F.lit(1), number - around), F.least(last, number + around))
    shown = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1), last), near)))
    return F.flatten(F.transform(shown, lambda p, i: F.when((i > 0) & (p > F.get(shown, i - 1) + 1), F.array(F.lit(None).cast("int"), p)).otherwise(F.array(p))))


_SHOWN = "list_sort(list_distinct(list_concat([1, last], range(greatest(1, number - 2), least(last, number + 2) + 1))))"


@query("E11", f"""WITH n AS (SELECT cast((count(*) + 6) // 7 AS int) AS last FROM parts), s AS (SELECT number, {_SHOWN} AS s FROM (SELECT last, cast(unnest(range(1, last + 1)) AS int) AS number FROM n)),
f AS (SELECT number, flatten(list_transform(s, lambda p, i: CASE WHEN i > 1 AND p > s[i - 1] + 1 THEN [NULL, p] ELSE [p] END)) AS pages FROM s)
SELECT number, cast(generate_subscripts(pages, 1) - 1 AS int) AS place, cast(unnest(pages) AS int) AS page FROM f""")
def e11(spark: SparkSession, sf: str) -> DataFrame:
    """The links under every page of the parts, seven to a page."""
    n = frame(spark, sf, "parts").agg(F.ceil(F.count(F.lit(1)) / 7).cast("int").alias("last"))
    each = n.select("last", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("number"))
    return each.select("number", F.posexplode(page_links(F.col("number"), F.col("last"))).alias("place", "page"))
