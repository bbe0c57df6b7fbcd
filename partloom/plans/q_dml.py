"""Updates, upserts and state (group K), and batch commands (group L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.functions import rules, text as T
from partloom.operators import dml as K, relations as R
from partloom.operators.lineage import own_folder
from partloom.operators.publish import Store
from partloom.plans import commands as L
from partloom.plans.domain import frame
from partloom.plans.q_relations import ROUTED_SQL, routed
from partloom.plans.registry import query
from partloom.sources import csv as C
from partloom.streaming import ledger


@query("K01", "SELECT id, CASE WHEN id % 3 = 0 AND is_active THEN 'bulk' ELSE notes END AS notes FROM parts")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    return K.set_where(frame(spark, sf, "parts"), (F.col("id") % 3 == 0) & F.col("is_active"), notes=F.lit("bulk")).select("id", "notes")


_BATCH = "SELECT 'PN-' || cast(id AS string) AS part_number, part_name, id AS pos FROM seed_parts WHERE id % 4 = 0 UNION ALL SELECT 'PN-' || cast(id + 1 AS string), 'late ' || part_name, id + 1000000 FROM seed_parts WHERE id % 4 = 3"


@query("K02", f"""WITH b AS ({_BATCH}), l AS (SELECT part_number, arg_max(part_name, pos) AS part_name, min(pos) AS first FROM b GROUP BY 1), t AS (SELECT part_number, min(part_name) AS part_name, min(id) AS id FROM target_parts GROUP BY 1)
SELECT coalesce(t.id, (SELECT max(id) FROM t) + row_number() OVER (PARTITION BY t.id IS NULL ORDER BY l.first)) AS id, coalesce(t.part_number, l.part_number) AS part_number, CASE WHEN l.part_number IS NULL THEN t.part_name ELSE l.part_name END AS part_name, CASE WHEN t.part_number IS NULL THEN 'created' WHEN l.part_number IS NULL THEN 'kept' ELSE 'updated' END AS change FROM t FULL JOIN l ON t.part_number = l.part_number""")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    seed = frame(spark, sf, "seed_parts")
    number = lambda c: F.concat(F.lit("PN-"), c.cast("string")).alias("part_number")
    early = seed.where("id % 4 = 0").select(number(F.col("id")), "part_name", F.col("id").alias("pos"))
    late = seed.where("id % 4 = 3").select(number(F.col("id") + 1), F.concat(F.lit("late "), "part_name").alias("part_name"), (F.col("id") + 1000000).alias("pos"))
    target = frame(spark, sf, "target_parts").groupBy("part_number").agg(F.min("part_name").alias("part_name"), F.min("id").alias("id"))
    return K.upsert(target, early.unionByName(late), ["part_number"], "pos", ["part_name"])


@query("K03", "SELECT s.part_number, s.id AS stock_quantity, t.part_number IS NOT NULL AS updates, v.id AS vendor, 'C' || cast(s.id % 5 AS string) AS colour FROM seed_parts s LEFT JOIN (SELECT DISTINCT part_number FROM target_parts) t ON t.part_number = s.part_number LEFT JOIN vendors v ON v.name = 'Supplier#' || lpad(cast(s.id % 20 AS string), 9, '0')")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    """Uploaded text rows to columns, an attribute map and a vendor looked up by name, ignoring case."""
    s = frame(spark, sf, "seed_parts")
    name = F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("id") % 20).cast("string"), 9, "0"))
    raw = s.select(F.col("part_number").alias("Part #"), F.col("id").cast("string").alias("Stock Quantity"), name.alias("Vendor"), F.concat(F.lit("C"), F.col("id") % 5).alias("Colour"))
    rows = C.split_fields(C.normalized(raw, C.PART_ALIASES), ["part_number", "stock_quantity", "primary_vendor"], [])
    have = frame(spark, sf, "target_parts").select("part_number", F.lit(True).alias("have")).distinct()
    vendors = frame(spark, sf, "vendors").select(F.lower("name").alias("key"), F.col("id").alias("vendor"))
    out = rows.join(have, "part_number", "left").join(vendors, F.lower("primary_vendor") == vendors["key"], "left")
    return out.select("part_number", F.coalesce(F.col("stock_quantity").try_cast("long"), F.lit(0)).alias("stock_quantity"), F.coalesce("have", F.lit(False)).alias("updates"), "vendor", F.col("specifications")["colour"].alias("colour"))


@query("K05", "SELECT t.id, CASE WHEN t.part_name = '' AND s.part_name <> '' THEN s.part_name ELSE t.part_name END AS part_name, CASE WHEN t.notes = '' AND s.notes <> '' THEN s.notes ELSE t.notes END AS notes, t.price FROM target_parts t LEFT JOIN seed_parts s ON s.seed_id = t.seed_id")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    return K.fill_blanks(frame(spark, sf, "target_parts"), frame(spark, sf, "seed_parts"), ["part_name", "notes", "price"], ["price"]).select("id", "part_name", "notes", "price")


@query("K06", "SELECT t.id, CASE WHEN s.seed_id IS NULL THEN t.oem ELSE s.oem END AS oem, CASE WHEN s.seed_id IS NULL THEN 0 ELSE (t.oem IS DISTINCT FROM s.oem)::int + (t.price IS DISTINCT FROM s.price)::int END AS changed FROM target_parts t LEFT JOIN seed_parts s ON s.seed_id = t.seed_id")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    return K.overwrite(frame(spark, sf, "target_parts"), frame(spark, sf, "seed_parts"), ["oem", "price"]).select("id", "oem", "changed")


_GROUPS = "(SELECT id AS loser, min(id) OVER (PARTITION BY make, model, engine, year) AS survivor FROM applications)"


@query("K08", f"SELECT m.survivor AS application_id, unit_id, min(au.id) AS id, coalesce(arg_max(position, CASE WHEN position <> '' THEN au.id END), NULL) AS position FROM application_units au JOIN {_GROUPS} m ON m.loser = au.application_id GROUP BY 1, 2")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    mapping = L.merge_map(frame(spark, sf, "applications"), ["make", "model", "engine", "year"], [F.col("id")])
    return K.repoint(frame(spark, sf, "application_units"), mapping, "application_id", ["unit_id"], ["position"])


_PARTS = "(SELECT p.id AS loser, coalesce(g.s, p.id) AS survivor FROM parts p LEFT JOIN (SELECT yt_number AS k, min(id) AS s FROM parts WHERE yt_number <> '' GROUP BY 1) g ON g.k = p.yt_number)"


@query("K09", f"SELECT min(i.id) AS id, i.bom_id, m.survivor AS part_id, i.unit_qty FROM bom_items i LEFT JOIN {_PARTS} m ON m.loser = i.part_id GROUP BY i.bom_id, m.survivor, i.unit_qty")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    mapping = L.merge_map(frame(spark, sf, "parts").where("yt_number <> ''"), ["yt_number"], [F.col("id")])
    return L.clean_bom_items(frame(spark, sf, "bom_items"), mapping).select("id", "bom_id", "part_id", "unit_qty")


@query("K10", "WITH RECURSIVE e AS (SELECT p_partkey AS old, p_partkey + 3 AS new FROM part WHERE p_partkey % 10 < 7), w AS (SELECT old AS name, new AS target FROM e UNION ALL SELECT w.name, e.new FROM w JOIN e ON w.target = e.old) SELECT name, max(target) AS final FROM w GROUP BY name")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, "parts").where("id % 10 < 7")
    return K.chase(p.select(F.col("id").alias("old"), (F.col("id") + 3).alias("new")))


@query("K11", "SELECT id, bom_id, CASE WHEN part_id % 10 = 3 THEN NULL ELSE part_id END AS part_id FROM bom_items WHERE bom_id NOT IN (SELECT id FROM boms WHERE name = '')")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    left = K.cascade(frame(spark, sf, "bom_items"), frame(spark, sf, "boms").where("name = ''"), "bom_id")
    return K.set_null(left, frame(spark, sf, "parts").where("NOT is_active"), "part_id").select("id", "bom_id", "part_id")


_STOCK = "SELECT p.id, cast(p.stock_quantity - coalesce(sum(l.quantity), 0) AS bigint) AS stock FROM parts p LEFT JOIN (SELECT part_id, CASE line_number WHEN 2 THEN 0 WHEN 3 THEN quantity + 1 ELSE quantity END AS quantity FROM invoice_items) l ON l.part_id = p.id GROUP BY p.id, p.stock_quantity"


def _line_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines are created; line 2 of each invoice is deleted again and line 3 grows by one."""
    items = frame(spark, sf, "invoice_items").select("part_id", "line_number", "quantity")
    none, line = F.lit(None).cast("long"), F.col("line_number")
    made = items.select(none.alias("old_part"), none.alias("old_qty"), F.col("part_id").alias("new_part"), F.col("quantity").cast("long").alias("new_qty"))
    changed = items.where(line.isin(2, 3)).select(F.col("part_id").alias("old_part"), F.col("quantity").cast("long").alias("old_qty"), F.when(line == 3, F.col("part_id")).alias("new_part"), F.when(line == 3, F.col("quantity") + 1).cast("long").alias("new_qty"))
    return made.unionByName(changed)


@query("K12", _STOCK)
def k12(spark: SparkSession, sf: str) -> DataFrame:
    return K.stock_after(frame(spark, sf, "parts"), K.ledger(_line_changes(spark, sf)))


@query("K12b", _STOCK)
def k12b(spark: SparkSession, sf: str) -> DataFrame:
    """The same changes as a stream of several batches, of which the last comes twice; the stock is read from the last version."""
    folder = own_folder(spark, "ledger")
    changes = _line_changes(spark, sf)
    changes.repartition(6).write.parquet(f"{folder}/changes")
    store = Store(spark, f"{folder}/store")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/changes")
    ledger.fold_versions(stream, store, f"{folder}/state").awaitTermination()
    ledger.apply_batch(store, spark.read.parquet(f"{folder}/changes"), ledger.through(store.names()))
    return K.stock_after(frame(spark, sf, "parts"), ledger.movements(store))


@query("K13", "SELECT t.id, t.price IS DISTINCT FROM s.price AS touched FROM target_parts t JOIN seed_parts s ON s.id = t.id")
def k13(spark: SparkSession, sf: str) -> DataFrame:
    s = frame(spark, sf, "seed_parts").select("id", F.col("price").alias("new"))
    return frame(spark, sf, "target_parts").select("id", "price").join(s, "id").select("id", (~F.col("price").eqNullSafe(F.col("new"))).alias("touched"))


@query("K14", "SELECT s.id, coalesce(nullif(CASE WHEN s.id % 2 = 0 THEN '' ELSE s.substitute_number END, ''), u.unit_number) AS number FROM substitutes s LEFT JOIN units u ON u.id = s.substitute_unit_id")
def k14(spark: SparkSession, sf: str) -> DataFrame:
    u = frame(spark, sf, "units").select(F.col("id").alias("substitute_unit_id"), "unit_number")
    own = T.nullif_blank(F.when(F.col("id") % 2 == 0, "").otherwise(F.col("substitute_number")))
    return frame(spark, sf, "substitutes").join(u, "substitute_unit_id", "left").select("id", F.coalesce(own, "unit_number").alias("number"))


@query("K15", "SELECT b.id, coalesce(nullif(b.oem, ''), d.oem, '') AS oem, coalesce(nullif(b.notes, ''), d.notes, '') AS notes FROM parts b LEFT JOIN (SELECT manufacturer_number AS k, arg_min(oem, id) AS oem, arg_min(notes, id) AS notes FROM parts WHERE id % 2 = 1 GROUP BY 1) d ON d.k = b.manufacturer_number WHERE b.id % 2 = 0")
def k15(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, "parts")
    dupes = p.where("id % 2 = 1").groupBy("manufacturer_number").agg(F.min_by("oem", "id").alias("d_oem"), F.min_by("notes", "id").alias("d_notes"))
    merged = p.where("id % 2 = 0").join(dupes, "manufacturer_number", "left")
    take = lambda c: F.coalesce(T.nullif_blank(F.col(c)), F.col(f"d_{c}"), F.lit("")).alias(c)
    return merged.select("id", take("oem"), take("notes"))


@query("K16", "SELECT id, CASE WHEN status = 'DRAFT' AND id % 2 = 0 THEN 'SENT' WHEN id % 5 = 0 THEN 'CANCELLED' ELSE status END AS status FROM invoices")
def k16(spark: SparkSession, sf: str) -> DataFrame:
    printed = (F.col("status") == "DRAFT") & (F.col("id") % 2 == 0)
    return frame(spark, sf, "invoices").select("id", F.when(printed, "SENT").when(F.col("id") % 5 == 0, "CANCELLED").otherwise(F.col("status")).alias("status"))


_PAIRS = "SELECT least(unit_id, substitute_unit_id) AS low, greatest(unit_id, substitute_unit_id) AS high, min(id) AS kept, count(DISTINCT unit_id < substitute_unit_id) AS directions, count(*) AS n FROM substitutes WHERE substitute_unit_id IS NOT NULL AND unit_id <> substitute_unit_id GROUP BY 1, 2"


@query("K17", _PAIRS)
def k17(spark: SparkSession, sf: str) -> DataFrame:
    return R.unordered_pairs(frame(spark, sf, "substitutes"), "unit_id", "substitute_unit_id", "id")


@query("K18", "SELECT min(id) AS id FROM substitutes WHERE substitute_unit_id IS NULL GROUP BY unit_id, substitute_number")
def k18(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "substitutes").where("substitute_unit_id IS NULL").groupBy("unit_id", "substitute_number").agg(F.min("id").alias("id")).select("id")


@query("K19", "SELECT id, bom_id FROM bom_items WHERE bom_id % 3 <> 0 UNION ALL SELECT -id, id FROM boms WHERE id % 3 = 0")
def k19(spark: SparkSession, sf: str) -> DataFrame:
    changed = frame(spark, sf, "boms").where("id % 3 = 0")
    rows = changed.select((-F.col("id")).alias("id"), F.col("id").alias("bom_id"))
    return K.replace_children(frame(spark, sf, "bom_items").select("id", "bom_id"), changed.select(F.col("id").alias("bom_id")), rows, "bom_id")


@query("L02", "SELECT id, CASE WHEN notes <> '' THEN notes WHEN voltage = '12V' THEN 'low.pdf' WHEN voltage = '24V' THEN 'high.pdf' ELSE notes END AS notes FROM parts")
def l02(spark: SparkSession, sf: str) -> DataFrame:
    return L.backfill(frame(spark, sf, "parts"), "notes", F.col("voltage"), {"12V": "low.pdf", "24V": "high.pdf"}).select("id", "notes")


_SOURCES = {"FORD": "Ford", "Delco 117": "WAI"}
_SOURCE = "CASE source_name WHEN 'FORD' THEN 'Ford' WHEN 'Delco 117' THEN 'WAI' ELSE source_name END"


@query("L06", f"""WITH p AS (SELECT *, {_SOURCE} AS maker, {_SOURCE} <> source_name AS moves FROM part_interchanges)
SELECT 'xref' AS kind, unit_id AS owner, cross_ref_number AS number, maker, min(id) AS id FROM (SELECT *, CASE interchange_type WHEN 'ALFA ROMEO' THEN 'Alfa Romeo' WHEN 'Alfa-romeo.' THEN 'Alfa Romeo' ELSE interchange_type END AS maker FROM cross_references) GROUP BY 2, 3, 4
UNION ALL SELECT 'interchange', part_id, interchange_number, maker, id FROM (SELECT *, bool_or(NOT moves) OVER w AS taken, row_number() OVER (PARTITION BY part_id, interchange_number, maker ORDER BY moves, id) AS n FROM p WINDOW w AS (PARTITION BY part_id, interchange_number, maker)) WHERE NOT moves OR (NOT taken AND n = 1)""")
def l06(spark: SparkSession, sf: str) -> DataFrame:
    """Makers merged in cross references, then in part interchanges: renamed, and those deleted that the maker has already."""
    renamed = T.renamed(F.col("interchange_type"), {"ALFA ROMEO": "Alfa Romeo", "Alfa-romeo.": "Alfa Romeo"})
    xrefs = frame(spark, sf, "cross_references").groupBy(F.lit("xref").alias("kind"), F.col("unit_id").alias("owner"), F.col("cross_ref_number").alias("number"), renamed.alias("maker")).agg(F.min("id").alias("id"))
    p = R.rewritten(frame(spark, sf, "part_interchanges"), "source_name", T.mapped(F.col("source_name"), _SOURCES), ["part_id", "interchange_number"], [F.col("id")])
    return xrefs.unionByName(p.select(F.lit("interchange").alias("kind"), F.col("part_id").alias("owner"), F.col("interchange_number").alias("number"), F.col("source_name").alias("maker"), "id"))


_SEG = "CASE WHEN regexp_matches(y, '^[0-9]{2}-[0-9]{2}$') THEN CASE WHEN a > b THEN (CASE WHEN a >= 70 THEN '19' ELSE '20' END) || substr(y, 1, 2) || '-' || (CASE WHEN b >= 70 THEN '19' ELSE '20' END) || substr(y, 4, 2) ELSE (CASE WHEN greatest(a, b) >= 70 THEN '19' ELSE '20' END) || substr(y, 1, 2) || '-' || (CASE WHEN greatest(a, b) >= 70 THEN '19' ELSE '20' END) || substr(y, 4, 2) END ELSE y END"


_MODELS = "CASE WHEN id % 11 = 0 THEN '3.0GSM-A,B' WHEN id % 13 = 0 THEN 'X.1-C,A,B' ELSE model END"


@query("L09", f"""WITH a AS (SELECT id, make, {_MODELS} AS model, engine, year FROM applications),
s AS (SELECT id, trim(unnest(string_split(year, '|'))) AS y, generate_subscripts(string_split(year, '|'), 1) AS i FROM a),
e AS (SELECT id, i, {_SEG} AS seg FROM (SELECT *, try_cast(substr(y, 1, 2) AS int) AS a, try_cast(substr(y, 4, 2) AS int) AS b FROM s WHERE y <> '')),
u AS (SELECT id, seg, min(i) AS i, count(*) OVER (PARTITION BY id) AS n FROM e GROUP BY id, seg),
one AS (SELECT a.id AS origin, a.id, false AS cloned, make, model, engine, coalesce(seg, year) AS year FROM a LEFT JOIN u USING (id) WHERE coalesce(n, 0) < 2
  UNION ALL SELECT a.id, (SELECT max(id) FROM a) + row_number() OVER (ORDER BY a.id, i), true, make, model, engine, seg FROM a JOIN u USING (id) WHERE n > 1),
two AS (SELECT origin, id, cloned, make, model, engine, year FROM one WHERE NOT regexp_matches(model, '^[\\w.]+-[A-Z](,[A-Z])+$')
  UNION ALL SELECT origin, (SELECT max(id) FROM one) + row_number() OVER (ORDER BY id, k), true, make, base || '-' || letter, engine, year FROM (
    SELECT *, regexp_extract(model, '^([\\w.]+)-', 1) AS base, unnest(string_split(regexp_extract(model, '-([A-Z,]+)$', 1), ',')) AS letter, generate_subscripts(string_split(regexp_extract(model, '-([A-Z,]+)$', 1), ','), 1) AS k
    FROM one WHERE regexp_matches(model, '^[\\w.]+-[A-Z](,[A-Z])+$'))),
f AS (SELECT * REPLACE (CASE WHEN regexp_matches(year, '^[0-9]{{4}}-[0-9]{{4}}$') AND substr(year, 1, 4) > substr(year, 6, 4) THEN substr(year, 6, 4) || '-' || substr(year, 1, 4) ELSE year END AS year) FROM two),
c AS (SELECT *, min(id) OVER (PARTITION BY make, model, engine, year) AS survivor FROM f)
SELECT 'application' AS kind, id, make, model, engine, year, NULL::bigint AS unit_id, NULL AS position, count(*) AS merged FROM (SELECT survivor AS id, make, model, engine, year FROM c) GROUP BY ALL
UNION ALL SELECT 'link', survivor, NULL, NULL, NULL, NULL, unit_id, coalesce(arg_max(position, (c.id <> survivor, cloned, CASE WHEN cloned THEN c.id ELSE 0 END, l.id)) FILTER (position <> ''), ''), count(*)
FROM application_units l JOIN c ON c.origin = l.application_id GROUP BY survivor, unit_id""")
def l09(spark: SparkSession, sf: str) -> DataFrame:
    """Applications after all five steps, and their links."""
    apps, links = L.normalize_applications(frame(spark, sf, "applications").withColumn("model", F.expr(_MODELS)), frame(spark, sf, "application_units"))
    apps = apps.withColumn("kind", F.lit("application"))
    return apps.unionByName(links.withColumnRenamed("application_id", "id").withColumn("kind", F.lit("link")), allowMissingColumns=True)


@query("L15", f"SELECT kept AS id FROM ({_PAIRS}) UNION ALL SELECT min(id) FROM substitutes WHERE substitute_unit_id IS NULL GROUP BY unit_id, substitute_number")
def l15(spark: SparkSession, sf: str) -> DataFrame:
    s = frame(spark, sf, "substitutes")
    pairs = R.unordered_pairs(s, "unit_id", "substitute_unit_id", "id").select(F.col("kept").alias("id"))
    return pairs.unionByName(s.where("substitute_unit_id IS NULL").groupBy("unit_id", "substitute_number").agg(F.min("id").alias("id")).select("id"))


@query("L20", "SELECT u.id, CASE WHEN u.unit_type = '' THEN n.n_name ELSE u.unit_type END AS unit_type FROM units u LEFT JOIN nation n ON n.n_nationkey = u.unit_type_id")
def l20(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("unit_type_id"), "n_name")
    return K.set_where(frame(spark, sf, "units").join(n, "unit_type_id", "left"), F.col("unit_type") == "", unit_type=F.col("n_name")).select("id", "unit_type")


_OFFERED = f"(SELECT * REPLACE (CASE WHEN pos % 4 = 0 THEN 'U' || substr(their_number, 2) ELSE their_number END AS their_number) FROM ({ROUTED_SQL}))"


@query("L31", f"""WITH r AS (SELECT *, CASE WHEN route = 'part_yt' THEN 'part' ELSE 'unit' END AS output, trim(regexp_replace(manufacturer, '\\s+', ' ', 'g')) AS maker FROM {_OFFERED} WHERE route <> 'none'),
stored AS (SELECT DISTINCT output, target_id, maker, their_number FROM r WHERE pos % 9 = 0 UNION SELECT 'unit', unit_id, interchange_type, cross_ref_number FROM cross_references UNION SELECT 'part', part_id, source_name, interchange_number FROM part_interchanges),
named AS (SELECT unit_number, max(id) AS id FROM units WHERE unit_number <> '' GROUP BY 1)
SELECT output, target_id, maker, their_number, min(pos) AS pos, min(CASE WHEN output = 'unit' AND n.id <> target_id THEN n.id END) AS other_id FROM r LEFT JOIN named n ON n.unit_number = their_number
WHERE maker <> '' AND (output, target_id, maker, their_number) NOT IN (SELECT (output, target_id, maker, their_number) FROM stored) GROUP BY 1, 2, 3, 4""")
def l31(spark: SparkSession, sf: str) -> DataFrame:
    """Of the rows a part is stored already, beside what the catalog holds."""
    rows = routed(spark, sf).withColumn("their_number", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("U"), F.expr("substr(their_number, 2)"))).otherwise(F.col("their_number")))
    held = rows.where("pos % 9 = 0 AND route <> 'none'").withColumn("maker", T.normalize_space(F.col("manufacturer")))
    columns = lambda part, *names: held.where((F.col("route") == "part_yt") == part).select(*[F.col(c).alias(n) for c, n in zip(("target_id", "their_number", "maker"), names, strict=True)])
    stored_x, stored_p = ("unit_id", "cross_ref_number", "interchange_type"), ("part_id", "interchange_number", "source_name")
    xrefs = frame(spark, sf, "cross_references").select(*stored_x).unionByName(columns(False, *stored_x))
    interchanges = frame(spark, sf, "part_interchanges").select(*stored_p).unionByName(columns(True, *stored_p))
    return L.import_interchange(rows, frame(spark, sf, "units"), xrefs, interchanges)


@query("L34", "SELECT DISTINCT b.id AS bom_id, au.application_id AS part_id FROM boms b JOIN application_units au ON au.unit_id = b.unit_id WHERE NOT EXISTS (SELECT 1 FROM bom_items i WHERE i.bom_id = b.id AND i.part_id = au.application_id)")
def l34(spark: SparkSession, sf: str) -> DataFrame:
    boms = frame(spark, sf, "boms").select(F.col("id").alias("bom_id"), "unit_id")
    links = frame(spark, sf, "application_units").select("unit_id", F.col("application_id").alias("part_id"))
    return L.missing_bom_items(boms, links, frame(spark, sf, "bom_items"))
