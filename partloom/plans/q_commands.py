"""Batch commands with all their steps and the rows that they leave (part of groups K and L)."""

from __future__ import annotations

import functools
import itertools
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.functions import rules
from partloom.functions.lines import application_blocks
from partloom.operators import dml as K, relations as R
from partloom.operators.lineage import cut_lineage, own_folder, written
from partloom.operators.publish import Store, run_tables
from partloom.plans import commands as L
from partloom.plans.domain import frame
from partloom.plans.q_relations import FILLED_SQL, filled
from partloom.plans.q_guides import BLOCKS_SQL, application_texts
from partloom.plans.registry import query
from partloom.sources import csv as C


def stacked(**tables: DataFrame) -> DataFrame:
    """Rows of several tables as one, with `kind`; columns that a table lacks are null."""
    out = None
    for kind, df in tables.items():
        one = df.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


_BACKFILLED = "(SELECT * REPLACE (coalesce(seed_id, CASE WHEN id IN (SELECT seed_id FROM seed_parts WHERE seed_id IS NOT NULL) THEN id END) AS seed_id) FROM target_parts)"
_INSERTS = f"(SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY part_number ORDER BY seed_id) AS n FROM seed_parts WHERE seed_id IS NOT NULL AND seed_id NOT IN (SELECT seed_id FROM {_BACKFILLED} WHERE seed_id IS NOT NULL) AND part_number NOT IN (SELECT part_number FROM target_parts)) WHERE n = 1)"


@query("K04", f"SELECT (SELECT max(id) FROM target_parts) + row_number() OVER (ORDER BY seed_id) AS id, seed_id, part_number FROM {_INSERTS}")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    seed = frame(spark, sf, "seed_parts")
    target = frame(spark, sf, "target_parts")
    new = cut_lineage(K.insert_only(K.backfilled(target, seed), seed, ["part_number"]).withColumn("id", F.lit(None).cast("long")))
    return K.with_ids(new, target, [F.col("seed_id")]).select("id", "seed_id", "part_number")


def _parts_sync(spark: SparkSession, sf: str) -> L.SyncTable:
    return L.SyncTable(frame(spark, sf, "target_parts"), frame(spark, sf, "seed_parts"), ("part_number",), ("part_name", "notes", "oem"), ("price",))


_FILL = lambda c: f"CASE WHEN t.{c} = '' AND s.{c} <> '' THEN s.{c} ELSE t.{c} END"
_SYNCED = f"""SELECT t.id, t.seed_id, t.part_number, {_FILL("part_name")} AS part_name, {_FILL("notes")} AS notes, t.price, {_FILL("oem")} AS oem,
  (t.part_name = '' AND s.part_name <> '')::int + (t.notes = '' AND s.notes <> '')::int + (t.oem = '' AND s.oem <> '')::int AS n FROM {_BACKFILLED} t LEFT JOIN seed_parts s ON s.seed_id = t.seed_id"""


@query("L35", f"""SELECT id, seed_id, part_number, part_name, notes, price, oem, CASE WHEN n > 0 THEN 'fill' ELSE 'kept' END AS change FROM ({_SYNCED})
UNION ALL SELECT (SELECT max(id) FROM target_parts) + row_number() OVER (ORDER BY seed_id), seed_id, part_number, part_name, notes, price, oem, 'insert' FROM {_INSERTS}""")
def l35(spark: SparkSession, sf: str) -> DataFrame:
    """What readers of the published catalog see."""
    store = Store(spark, own_folder(spark, "catalog"))
    L.sync_catalog(store, "nightly", {"parts": _parts_sync(spark, sf)}, 3600.0)
    return store.tables()["parts"]


_VENDORS = "(SELECT * REPLACE (coalesce(seed_id, CASE WHEN id IN (SELECT seed_id FROM seed_vendors) THEN id END) AS seed_id) FROM target_vendors)"


@query("K07", f"""WITH p AS (SELECT (SELECT count(*) FROM {_INSERTS}) AS inserted, (SELECT count(*) FROM seed_parts WHERE seed_id IS NOT NULL AND seed_id NOT IN (SELECT seed_id FROM {_BACKFILLED} WHERE seed_id IS NOT NULL)) AS unknown,
  (SELECT coalesce(sum(n), 0) FROM ({_SYNCED})) AS updated, (SELECT count(*) FROM seed_parts WHERE seed_id IS NOT NULL) AS total),
v AS (SELECT (SELECT count(*) FROM seed_vendors WHERE seed_id NOT IN (SELECT seed_id FROM {_VENDORS} WHERE seed_id IS NOT NULL) AND name NOT IN (SELECT name FROM target_vendors)) AS inserted,
  (SELECT count(*) FROM seed_vendors WHERE seed_id NOT IN (SELECT seed_id FROM {_VENDORS} WHERE seed_id IS NOT NULL)) AS unknown,
  (SELECT count(*) FROM {_VENDORS} t JOIN seed_vendors s ON s.seed_id = t.seed_id WHERE t.notes = '' AND s.notes <> '') AS updated, (SELECT count(*) FROM seed_vendors) AS total)
SELECT 1 AS run, 'parts' AS table_name, 'done' AS state, inserted::bigint AS inserted, (unknown - inserted)::bigint AS conflicts, updated::bigint AS updated, greatest(0, total - unknown - updated)::bigint AS skipped FROM p
UNION ALL SELECT 1, 'vendors', 'left', 0, 0, 0, 0 UNION ALL SELECT 2, 'parts', 'done before', 0, 0, 0, 0
UNION ALL SELECT 2, 'vendors', 'done', inserted, unknown - inserted, updated, greatest(0, total - unknown - updated) FROM v
UNION ALL SELECT 3, 'parts', 'published', inserted + (SELECT count(*) FROM target_parts), 0, 0, 0 FROM p UNION ALL SELECT 3, 'vendors', 'published', inserted + (SELECT count(*) FROM target_vendors), 0, 0, 0 FROM v""")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    """A sync whose budget ends after the first table, the attempt that goes on from there, and how many rows readers see then. The clock counts how often it is asked."""
    tables = {"parts": _parts_sync(spark, sf), "vendors": L.SyncTable(frame(spark, sf, "target_vendors"), frame(spark, sf, "seed_vendors"), ("name",), ("notes",))}
    store = Store(spark, own_folder(spark, "catalog"))
    attempts = [L.sync_catalog(store, "nightly", tables, 2, clock=itertools.count().__next__) for _ in range(2)]
    rows = [(n, *r) for n, report in enumerate(attempts, 1) for r in report]
    report = spark.createDataFrame(rows, "run int, table_name string, state string, inserted long, conflicts long, updated long, skipped long")
    zero = [F.lit(0).cast("long").alias(c) for c in ("conflicts", "updated", "skipped")]
    for name, df in store.tables().items():
        seen = df.agg(F.count(F.lit(1)).alias("inserted"))
        report = report.unionByName(seen.select(F.lit(3).alias("run"), F.lit(name).alias("table_name"), F.lit("published").alias("state"), "inserted", *zero))
    return report


_BARE = "yt_number = '' AND manufacturer = '' AND unit_type_category = ''"
_KINDS = f"""kinds AS (SELECT b.id, CASE WHEN u.id IS NOT NULL THEN 'unit' WHEN p.id IS NOT NULL THEN 'part' ELSE 'none' END AS kind, coalesce(u.id, p.id) AS target FROM (SELECT * FROM stock_units WHERE {_BARE}) b
  LEFT JOIN (SELECT yt_number, max(id) AS id FROM stock_units WHERE NOT ({_BARE}) AND yt_number <> '' GROUP BY 1) u ON u.yt_number = b.unit_number LEFT JOIN (SELECT yt_number, max(id) AS id FROM parts WHERE yt_number <> '' GROUP BY 1) p ON p.yt_number = b.unit_number)"""


@query("L04", f"""WITH {_KINDS},
x AS (SELECT r.*, coalesce(CASE k.kind WHEN 'unit' THEN k.target END, r.unit_id) AS owner, coalesce(k.kind, 'none') AS kind, CASE f.kind WHEN 'unit' THEN f.target WHEN 'part' THEN NULL ELSE r.cross_ref_unit_id END AS other
  FROM cross_references r LEFT JOIN kinds k ON k.id = r.unit_id LEFT JOIN kinds f ON f.id = r.cross_ref_unit_id),
m AS (SELECT *, max(kind <> 'unit') OVER (PARTITION BY owner, cross_ref_number, interchange_type) AS taken, row_number() OVER (PARTITION BY owner, cross_ref_number, interchange_type, kind = 'unit' ORDER BY id) AS n FROM x WHERE kind <> 'part')
SELECT 'xref' AS kind, id, owner, cross_ref_number AS number, interchange_type AS label, other FROM m WHERE kind <> 'unit' OR (NOT taken AND n = 1)
UNION ALL SELECT DISTINCT 'interchange', NULL::bigint, k.target, x.cross_ref_number, x.interchange_type, NULL::bigint FROM cross_references x JOIN kinds k ON k.id = x.unit_id AND k.kind = 'part'
  WHERE NOT EXISTS (SELECT 1 FROM part_interchanges i WHERE i.part_id = k.target AND i.interchange_number = x.cross_ref_number AND i.source_name = x.interchange_type)
UNION ALL SELECT 'unit', id, NULL, unit_number, NULL, NULL FROM stock_units WHERE id NOT IN (SELECT id FROM kinds WHERE kind <> 'none')""")
def l04(spark: SparkSession, sf: str) -> DataFrame:
    got = L.fold_bare_units(frame(spark, sf, "stock_units"), frame(spark, sf, "parts"), frame(spark, sf, "cross_references"), frame(spark, sf, "application_units"), frame(spark, sf, "part_interchanges"))
    return stacked(
        xref=got.xrefs.select("id", F.col("unit_id").alias("owner"), F.col("cross_ref_number").alias("number"), F.col("interchange_type").alias("label"), F.col("cross_ref_unit_id").alias("other")),
        interchange=got.interchanges.where("new").select(F.col("part_id").alias("owner"), F.col("interchange_number").alias("number"), F.col("source_name").alias("label")),
        unit=got.units.select("id", F.col("unit_number").alias("number")),
    )


_SHELL = "manufacturer = '' AND oem = '' AND voltage = '' AND amp_rating = '' AND unit_type_id IS NULL"
_SHELLS = f"shells AS (SELECT s.id, s.unit_number, s.yt_number, r.id AS target FROM (SELECT * FROM stock_units WHERE {_SHELL} AND yt_number <> '' AND unit_number IN (SELECT cross_ref_number FROM cross_references)) s JOIN (SELECT yt_number, min(id) AS id FROM stock_units WHERE NOT ({_SHELL}) GROUP BY 1) r ON r.yt_number = s.yt_number)"


@query("L08", f"""WITH {_SHELLS},
l AS (SELECT a.id, a.application_id, coalesce(s.target, a.unit_id) AS owner, s.id IS NOT NULL AS moves, s.yt_number, s.unit_number FROM application_units a LEFT JOIN shells s ON s.id = a.unit_id),
m AS (SELECT *, max(NOT moves) OVER (PARTITION BY owner, application_id) AS taken, row_number() OVER (PARTITION BY owner, application_id, moves ORDER BY yt_number, unit_number, id) AS n FROM l)
SELECT 'link' AS kind, id, owner, application_id AS other FROM m WHERE NOT moves OR (NOT taken AND n = 1)
UNION ALL SELECT 'xref', x.id, x.unit_id, coalesce(s.target, x.cross_ref_unit_id) FROM cross_references x LEFT JOIN shells s ON s.id = x.cross_ref_unit_id WHERE x.unit_id NOT IN (SELECT id FROM shells)
UNION ALL SELECT 'unit', id, NULL, NULL FROM stock_units WHERE id NOT IN (SELECT id FROM shells)""")
def l08(spark: SparkSession, sf: str) -> DataFrame:
    got = L.fold_alias_units(frame(spark, sf, "stock_units"), frame(spark, sf, "cross_references"), frame(spark, sf, "application_units"))
    return stacked(
        link=got.links.select("id", F.col("unit_id").alias("owner"), F.col("application_id").alias("other")),
        xref=got.xrefs.select("id", F.col("unit_id").alias("owner"), F.col("cross_ref_unit_id").alias("other")),
        unit=got.units.select("id"),
    )


def _merged_sql(items: str, unique: str, order: str) -> str:
    """CTEs m (BOM and the one that stays) and after (items), for items with the columns id, bom_id."""
    return f"""items AS ({items}), sized AS (SELECT b.id, b.unit_id, count(i.id) AS n FROM boms b LEFT JOIN items i ON i.bom_id = b.id WHERE b.unit_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT id, first_value(id) OVER (PARTITION BY unit_id ORDER BY {order}) AS survivor, row_number() OVER (PARTITION BY unit_id ORDER BY {order}) AS nth FROM sized),
x AS (SELECT i.*, coalesce(m.survivor, i.bom_id) AS owner, coalesce(m.id <> m.survivor, false) AS moves, m.nth, {unique} AS u FROM items i LEFT JOIN m ON m.id = i.bom_id),
r AS (SELECT *, max(NOT moves) OVER (PARTITION BY owner, u) AS taken, row_number() OVER (PARTITION BY owner, u, moves ORDER BY nth, id) AS n FROM x),
after AS (SELECT * FROM r WHERE NOT moves OR (NOT taken AND n = 1))"""


@query("L33", f"WITH {_merged_sql('SELECT * FROM bom_items', 'part_id', 'n DESC, id DESC')} SELECT 'item' AS kind, id, owner AS bom_id, part_id FROM after UNION ALL SELECT 'bom', id, NULL, NULL FROM boms WHERE id NOT IN (SELECT id FROM m WHERE id <> survivor)")
def l33(spark: SparkSession, sf: str) -> DataFrame:
    """A unit's BOMs merged into the one with most items, of equals the latest; a part that it has already does not move."""
    unique = lambda df: df.withColumn("_unique", F.col("part_id"))
    boms, items = L.merge_unit_boms(frame(spark, sf, "boms"), frame(spark, sf, "bom_items"), unique, [F.col("n").desc(), F.col("id").desc()])
    return stacked(item=items.select("id", "bom_id", "part_id"), bom=boms.select("id"))


_NUMBER_OR_TEXT = "CASE WHEN trim(yt_number) <> '' THEN 'yt ' || lower(trim(yt_number)) ELSE 'text ' || lower(trim(description)) END"
_REAL_ITEMS = "SELECT * FROM bom_items WHERE yt_number <> '' OR description <> '' OR j_and_n <> ''"


@query("L05", f"WITH {_merged_sql(_REAL_ITEMS, _NUMBER_OR_TEXT, 'n DESC, id')} SELECT 'item' AS kind, id, owner AS bom_id FROM after UNION ALL SELECT 'bom', id, NULL FROM boms WHERE id NOT IN (SELECT id FROM m WHERE id <> survivor) AND id IN (SELECT owner FROM after)")
def l05(spark: SparkSession, sf: str) -> DataFrame:
    boms, items = L.cleanup_boms(frame(spark, sf, "boms"), frame(spark, sf, "bom_items"))
    return stacked(item=items.select("id", "bom_id"), bom=boms.select("id"))


@query("L17", """WITH owned AS (SELECT b.id, b.unit_id, b.id IN (SELECT i.bom_id FROM bom_items i JOIN parts p ON p.id = i.part_id WHERE p.part_number <> '') AS is_real FROM boms b WHERE b.unit_id IS NOT NULL),
gone AS (SELECT id FROM owned WHERE NOT is_real AND unit_id IN (SELECT unit_id FROM owned WHERE is_real))
SELECT 'bom' AS kind, id FROM boms WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'item', id FROM bom_items WHERE bom_id NOT IN (SELECT id FROM gone)""")
def l17(spark: SparkSession, sf: str) -> DataFrame:
    boms, items = frame(spark, sf, "boms"), frame(spark, sf, "bom_items")
    gone = L.empty_boms(boms, items, frame(spark, sf, "parts"))
    return stacked(bom=boms.join(gone, "id", "left_anti").select("id"), item=K.cascade(items, gone, "bom_id").select("id"))


@query("L18", "SELECT 'target_parts' AS kind, id, coalesce(seed_id, id) AS seed_id FROM target_parts UNION ALL SELECT 'target_vendors', id, coalesce(seed_id, id) FROM target_vendors")
def l18(spark: SparkSession, sf: str) -> DataFrame:
    """What is exported: two catalog tables with all seed_ids, and of the customer's invoices nothing."""
    tables = {t: frame(spark, sf, t) for t in ("target_parts", "target_vendors", "invoices")}
    out = L.export_seed(tables, ["invoices"])
    invoices = out["invoices"].select("id", F.lit(None).cast("long").alias("seed_id"))
    return stacked(target_parts=out["target_parts"].select("id", "seed_id"), target_vendors=out["target_vendors"].select("id", "seed_id"), invoices=invoices)


_SAMPLE = lambda t, cols: f"(SELECT {' || '.join([repr(c + '=') + f' || {c}' if i == 0 else repr(', ' + c + '=') + f' || {c}' for i, c in enumerate(cols)])} FROM {t} ORDER BY {cols[0]} LIMIT 1)"


@query("L32", f"""SELECT 'seed_vendors' AS table_name, 'id,seed_id,name,notes' AS columns, count(*) AS n_rows, {_SAMPLE("seed_vendors", ["id", "seed_id", "name", "notes"])} AS sample FROM seed_vendors
UNION ALL SELECT 'part_supersedings', 'id,part_id,old_part_id,old_part_number,notes', count(*), {_SAMPLE("(SELECT * REPLACE (coalesce(cast(old_part_id AS string), '') AS old_part_id) FROM part_supersedings)", ["id", "part_id", "old_part_id", "old_part_number", "notes"])} FROM part_supersedings""")
def l32(spark: SparkSession, sf: str) -> DataFrame:
    return C.inspect({t: frame(spark, sf, t) for t in ("seed_vendors", "part_supersedings")}, by="id")


_Y12 = "array_to_string(list_transform(string_split(year, ' | '), lambda g: array_to_string(list_transform(string_split(g, '-'), lambda y: CASE WHEN regexp_matches(y, '^[0-9]{2}$') THEN CASE WHEN try_cast(y AS int) <= 30 THEN '20' || y ELSE '19' || y END ELSE y END), '-')), ' | ')"
_TOKEN = "CASE WHEN contains(options, 'Manual') THEN 'Manual' WHEN contains(options, 'Automatic') THEN 'Automatic' ELSE '' END"
_KEY = "make, model, engine, part_number, mfr, transmission"


@query("L21", f"""WITH f AS ({FILLED_SQL}), x AS (SELECT * REPLACE (array_to_string(list_filter(list_transform(string_split(options, ';'), lambda x: trim(x)), lambda x: x NOT IN ('Automatic', 'Manual')), ';') AS options), {_TOKEN} AS transmission FROM f WHERE part_number <> ''),
y AS (SELECT {_KEY}, string_agg(year, ' | ' ORDER BY p) AS year FROM (SELECT {_KEY}, year, min(pos) AS p FROM x WHERE year <> '' GROUP BY ALL) GROUP BY ALL),
o AS (SELECT {_KEY}, string_agg(options, ' | ' ORDER BY p) AS options FROM (SELECT {_KEY}, options, min(pos) AS p FROM x WHERE options <> '' GROUP BY ALL) GROUP BY ALL)
SELECT concat_ws(' ', nullif(make, ''), nullif(model, ''), nullif(engine, ''), nullif(transmission, '')) AS name, {_KEY}, {_Y12.replace("(year", "(coalesce(y.year, '')")} AS year, concat_ws(' | ', nullif(transmission, ''), o.options) AS options, u.id AS unit_id
FROM (SELECT DISTINCT {_KEY} FROM x) k LEFT JOIN y USING ({_KEY}) LEFT JOIN o USING ({_KEY}) LEFT JOIN (SELECT unit_number, max(id) AS id FROM units GROUP BY 1) u ON u.unit_number = k.part_number""")
def l21(spark: SparkSession, sf: str) -> DataFrame:
    return L.import_applications(filled(spark, sf), frame(spark, sf, "units"))


_STEMS = "SELECT DISTINCT {scope} substr(lower(n), 1, k) AS stem FROM (SELECT owner, n, unnest(range(0, length(n) + 1)) AS k FROM {rows} WHERE n IS NOT NULL AND NOT ends_with(n, '-'))"
_STEM = "lower(substr(n, 1, length(n) - 1))"


@query("L16", f"""WITH x AS (SELECT id, unit_id AS owner, cross_ref_number AS n, interchange_type AS t FROM cross_references),
d AS (SELECT *, trim(coalesce(t, '')) AS text, regexp_extract(trim(coalesce(t, '')), '^([^ ]+) (.*)$', 1) AS head, trim(regexp_extract(trim(coalesce(t, '')), '^([^ ]+) (.*)$', 2)) AS tail FROM x WHERE ends_with(n, '-') AND n <> '-'),
f AS (SELECT *, contains(text, ' ') AND regexp_matches(head, '^[A-Z0-9][A-Z0-9-]*$') AND length(head) <= 8 AS two, regexp_matches(text, '^[A-Z0-9][A-Z0-9-]*$') AND length(text) <= 6 AS one FROM d),
s AS (SELECT *, CASE WHEN two THEN head WHEN one THEN text ELSE '' END AS suffix, CASE WHEN two THEN tail WHEN one THEN '' ELSE text END AS maker FROM f),
c AS (SELECT id, owner, n, t, n || suffix AS n2, coalesce(nullif(maker, ''), t) AS t2, EXISTS (SELECT 1 FROM x WHERE x.owner = s.owner AND x.n = s.n || s.suffix) AS have FROM s WHERE suffix <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, n2, t2 ORDER BY id) AS k FROM c WHERE NOT have),
own AS ({_STEMS.format(scope="owner,", rows="x")}),
b AS (SELECT id, owner, n, t, EXISTS (SELECT 1 FROM own WHERE own.owner = s.owner AND own.stem = {_STEM}) AS done FROM s WHERE suffix = ''),
gone AS (SELECT id, n, t FROM c WHERE have UNION ALL SELECT id, n, t FROM r WHERE k > 1 UNION ALL SELECT id, n, t FROM b WHERE done),
kept AS (SELECT id, owner, n2 AS n, t2 AS t, 'merge' AS action FROM r WHERE k = 1 UNION ALL SELECT id, owner, n, t, 'manual' FROM b WHERE NOT done),
now AS (SELECT id, owner, n, t FROM x WHERE n IS NULL OR NOT ends_with(n, '-') OR n = '-' UNION ALL SELECT id, owner, n, t FROM kept),
own2 AS ({_STEMS.format(scope="owner,", rows="now")}), any2 AS ({_STEMS.format(scope="", rows="now")}),
open AS (SELECT *, count(*) OVER (PARTITION BY owner, t) AS twins, list_filter(string_split(rtrim(n, '-'), '-'), lambda p: p <> '') AS p FROM kept WHERE ends_with(n, '-') AND n <> '-'),
judged AS (SELECT id, n, t, CASE WHEN EXISTS (SELECT 1 FROM own2 WHERE own2.owner = open.owner AND own2.stem = {_STEM}) OR {_STEM} IN (SELECT stem FROM any2) OR twins > 1 OR regexp_matches(n, '\\s') OR length(n) > 40
  OR ends_with(coalesce(t, ''), '-') OR len(list_filter(list_slice(p, 3, len(p) - 1), lambda q: regexp_matches(q, '^[A-Za-z]$'))) > 0 THEN 'orphan' ELSE action END AS action FROM open)
SELECT id, 'delete' AS action, n AS cross_ref_number, t AS interchange_type FROM gone UNION ALL SELECT id, action, n, t FROM judged UNION ALL SELECT id, action, n, t FROM kept WHERE NOT ends_with(n, '-') OR n = '-'""")
def l16(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each broken-off number: deleted, merged with the suffix in its label, deleted as an orphan, or left for review."""
    return L.cleanup_fragments(frame(spark, sf, "cross_references"), "unit_id", "cross_ref_number", "interchange_type")


_CATEGORY = " ".join(f"WHEN {' OR '.join(f'''regexp_matches(t, '(?i){p}')''' for p in pats)} THEN '{name}'" for name, pats in rules.PART_CATEGORIES)


@query("L11", f"SELECT id, 'fill' AS mode, CASE WHEN category <> '' THEN category ELSE coalesce(CASE {_CATEGORY} END, '') END AS category FROM (SELECT id, category AS t, CASE WHEN id % 4 = 0 THEN '' ELSE category END AS category FROM parts) UNION ALL SELECT id, 'overwrite', coalesce(CASE {_CATEGORY} END, category) FROM (SELECT id, category AS t, CASE WHEN id % 4 = 0 THEN '' ELSE category END AS category FROM parts)")
def l11(spark: SparkSession, sf: str) -> DataFrame:
    """Categories from texts, for parts without one and for all. A fourth of the parts has none."""
    p = frame(spark, sf, "parts").select("id", F.col("category").alias("t"), F.when(F.col("id") % 4 == 0, "").otherwise(F.col("category")).alias("category"))
    modes = {"fill": L.classify_parts(p, "t", rules.PART_CATEGORIES), "overwrite": L.classify_parts(p, "t", rules.PART_CATEGORIES, overwrite=True)}
    return stacked(**modes).select("id", F.col("kind").alias("mode"), "category")


_VARIANTS = [("Brand#11", "Brand#12"), ("Brand#21", "Brand#22"), *rules.MAKER_VARIANTS]
_FULL = " + ".join([f"(coalesce({c}, '') <> '')::int" for c in ("part_number", "part_name", "manufacturer_number", "yt_number", "j_and_n", "oem", "category", "voltage")] + [f"({c} IS NOT NULL)::int" for c in ("cost_price", "price")])
_VARIANT_SQL = " UNION ALL ".join(f"SELECT v.id AS loser, b.id AS survivor FROM left2 v JOIN (SELECT yt_number, min(id) AS id FROM left2 WHERE yt_number <> '' AND oem = '{b}' GROUP BY 1) b USING (yt_number) WHERE v.oem = '{v}'" for b, v in _VARIANTS)


def _moved_items(source: str, mapping: str, name: str) -> str:
    return f"""{name}x AS (SELECT i.* REPLACE (coalesce(m.survivor, i.part_id) AS part_id), m.loser IS NOT NULL AS moves FROM {source} i LEFT JOIN {mapping} m ON m.loser = i.part_id),
{name}r AS (SELECT *, max(NOT moves) OVER (PARTITION BY bom_id, part_id, unit_qty) AS taken, row_number() OVER (PARTITION BY bom_id, part_id, unit_qty, moves ORDER BY id) AS n FROM {name}x),
{name} AS (SELECT id, bom_id, part_id, unit_qty FROM {name}r WHERE NOT moves OR (NOT taken AND n = 1))"""


@query("L12", f"""WITH p AS (SELECT * REPLACE (replace(rtrim(oem, '.'), 'BRAND', 'Brand') AS oem) FROM parts),
ranked AS (SELECT id, first_value(id) OVER (PARTITION BY yt_number ORDER BY {_FULL} DESC, id) AS survivor FROM p WHERE yt_number IN (SELECT yt_number FROM p WHERE yt_number <> '' GROUP BY 1 HAVING count(DISTINCT nullif(oem, '')) = 1)),
m2 AS (SELECT id AS loser, survivor FROM ranked WHERE id <> survivor), left2 AS (SELECT * FROM p WHERE id NOT IN (SELECT loser FROM m2)), m3 AS ({_VARIANT_SQL}),
{_moved_items("bom_items", "m2", "i2")}, {_moved_items("i2", "m3", "i3")}, items AS (SELECT min(id) AS id, bom_id, part_id FROM i3 GROUP BY bom_id, part_id, unit_qty)
SELECT 'part' AS kind, id, oem, NULL::bigint AS bom_id, NULL::bigint AS part_id FROM left2 WHERE id NOT IN (SELECT loser FROM m3) UNION ALL SELECT 'item', id, NULL, bom_id, part_id FROM items UNION ALL SELECT 'bom', id, NULL, NULL, NULL FROM boms WHERE id IN (SELECT bom_id FROM items)""")
def l12(spark: SparkSession, sf: str) -> DataFrame:
    of_items = frame(spark, sf, "bom_items").select("id", "bom_id", "part_id", "unit_qty")
    parts, boms, items = L.cleanup_parts(frame(spark, sf, "parts"), frame(spark, sf, "boms"), of_items, {}, rules.OEM_RENAMES, _VARIANTS)
    return stacked(part=parts.select("id", "oem"), item=items.select("id", "bom_id", "part_id"), bom=boms.select("id"))


_SOURCES = {"Brand#11": ["FORD"], "Brand#12": ["WAI", "Delco 117"], "Brand#23": ["FORD", "WAI"]}
_SOURCE_ROWS = ", ".join(f"('{m}', '{s}')" for m, ss in _SOURCES.items() for s in ss)
_CANONICAL = ", ".join(f"('{s}', '{m}')" for s, m in {s: m for m, ss in _SOURCES.items() for s in ss}.items())


@query("L19", f"""WITH p AS (SELECT id, oem, CASE WHEN id % 5 = 0 THEN 'OE' || cast(id AS string) ELSE '' END AS oem_number, CASE WHEN id % 3 = 0 THEN '' ELSE manufacturer_number END AS manufacturer_number, CASE WHEN id % 2 = 0 AND j_and_n <> '' THEN j_and_n || ' | Z' ELSE j_and_n END AS j_and_n, voltage FROM parts),
f AS (SELECT part_id AS id, c.maker, arg_min(interchange_number, i.id) AS number FROM part_interchanges i JOIN (VALUES {_CANONICAL}) AS c(source, maker) ON c.source = i.source_name GROUP BY 1, 2),
s AS (SELECT id, min(maker) AS maker, min(number) AS number FROM f GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT part_id AS id, arg_min(voltage, unit_id) AS voltage FROM part_units JOIN stock_units u ON u.id = unit_id WHERE voltage <> '' GROUP BY 1)
SELECT p.id, CASE WHEN p.oem = '' THEN coalesce(s.maker, '') ELSE p.oem END AS oem, CASE WHEN oem_number <> '' THEN oem_number WHEN p.oem = '' THEN coalesce(s.number, '') ELSE coalesce(f.number, '') END AS oem_number,
  CASE WHEN manufacturer_number = '' THEN trim(string_split(trim(j_and_n), ' | ')[1]) ELSE manufacturer_number END AS manufacturer_number, CASE WHEN p.voltage = '' THEN coalesce(l.voltage, u.voltage, '') ELSE p.voltage END AS voltage
FROM p LEFT JOIN f ON f.id = p.id AND f.maker = p.oem LEFT JOIN s ON s.id = p.id LEFT JOIN l ON l.id = p.id LEFT JOIN part_owners o ON o.part_id = p.id LEFT JOIN stock_units u ON u.id = o.unit_id AND u.voltage <> ''""")
def l19(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, "parts").select(
        "id", "oem", F.when(F.col("id") % 5 == 0, F.concat(F.lit("OE"), "id")).otherwise("").alias("oem_number"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("manufacturer_number")).alias("manufacturer_number"),
        F.when((F.col("id") % 2 == 0) & (F.col("j_and_n") != ""), F.concat("j_and_n", F.lit(" | Z"))).otherwise(F.col("j_and_n")).alias("j_and_n"), "voltage",
    )
    return L.fill_oem_numbers(p, frame(spark, sf, "part_interchanges"), _SOURCES, frame(spark, sf, "part_units"), frame(spark, sf, "part_owners"), frame(spark, sf, "stock_units")).drop("j_and_n")


_REF_ROWS = """parts_ AS (SELECT DISTINCT trim(number) AS number FROM staging_master), refs AS (SELECT pos, r.number, ref_number, lower(coalesce(nullif(ref_type, ''), 'reference')) AS kind, maker, concat_ws(' | ', nullif(maker, ''), nullif(notes, '')) AS notes, CASE WHEN o.number <> r.number THEN o.number END AS other
  FROM staging_refs r JOIN parts_ USING (number) LEFT JOIN parts_ o ON o.number = r.ref_number WHERE ref_number <> '')"""


@query("L25", f"""WITH {_REF_ROWS},
staged AS (SELECT pos, trim(number) AS number, part_name, coalesce(nullif(category, ''), code) AS category FROM staging_master),
first AS (SELECT number, min(pos) AS pos, arg_min(part_name, pos) AS first_name, arg_min(part_name, pos) FILTER (part_name <> '') AS part_name, arg_min(category, pos) FILTER (category <> '') AS category FROM staged GROUP BY 1),
super AS (SELECT pos, number, other, ref_number, notes FROM refs WHERE kind = 'superseded_from' UNION ALL SELECT pos, other, number, 'JN:' || number, notes FROM refs WHERE kind = 'superseded_by' AND other IS NOT NULL),
rel AS (SELECT 'substitute' AS kind, pos, number, other, ref_number, notes FROM refs WHERE kind = 'substitute' UNION ALL SELECT 'interchange', pos, number, other, ref_number, notes FROM refs WHERE kind IN ('reference', 'interchange') UNION ALL SELECT 'superseding', * FROM super),
ids AS (SELECT f.number, coalesce(k.id, (SELECT max(id) FROM master_parts) + row_number() OVER (PARTITION BY k.id IS NULL ORDER BY f.pos)) AS id FROM first f LEFT JOIN master_parts k USING (number)),
lines AS (SELECT number, 'Superseded by: ' || ref_number || CASE WHEN maker <> '' THEN ' (' || maker || ')' ELSE '' END AS line, min(pos) AS p FROM refs WHERE kind = 'superseded_by' AND other IS NULL GROUP BY 1, 2)
SELECT 'part' AS kind, f.number, i.id AS part_id, NULL::bigint AS other_id, CASE WHEN k.id IS NULL THEN coalesce(nullif(f.first_name, ''), f.number) ELSE coalesce(nullif(k.part_name, ''), f.part_name, '') END AS label, coalesce(nullif(k.category, ''), f.category, '') AS other, NULL AS ref_number,
  CASE WHEN k.id IS NULL THEN 'created' WHEN (k.part_name = '' AND f.part_name <> '') OR (k.category = '' AND f.category <> '') THEN 'updated' ELSE 'kept' END AS notes FROM first f JOIN ids i USING (number) LEFT JOIN master_parts k USING (number)
UNION ALL SELECT kind, r.number, i.id, o.id, NULL, other, ref_number, notes FROM (SELECT *, row_number() OVER (PARTITION BY kind, number, ref_number ORDER BY pos) AS n FROM rel) r JOIN ids i ON i.number = r.number LEFT JOIN ids o ON o.number = r.other WHERE n = 1
UNION ALL SELECT 'note', number, NULL, NULL, NULL, NULL, NULL, string_agg(line, chr(10) ORDER BY p) FROM lines GROUP BY number""")
def l25(spark: SparkSession, sf: str) -> DataFrame:
    """A master catalog: parts created or completed, then substitutes, interchanges and supersedings, and notes on what supersedes a part."""
    got = L.import_master(frame(spark, sf, "staging_master"), frame(spark, sf, "staging_refs"), frame(spark, sf, "master_parts"))
    parts = got.pop("part").select("number", F.col("id").alias("part_id"), F.col("part_name").alias("label"), F.col("category").alias("other"), F.col("change").alias("notes"))
    return stacked(part=parts, **got)


@query("L28", """WITH prod AS (SELECT pos, yt_number, trim(regexp_replace(manufacturer, '\\s+', ' ', 'g')) AS manufacturer, family, notes FROM staging_products),
old AS (SELECT yt_number, max(id) AS id, arg_max(manufacturer, id) AS manufacturer, arg_max(family, id) AS family, arg_max(notes, id) AS notes FROM line_units GROUP BY 1),
ids AS (SELECT id AS unit_id, yt_number FROM line_units WHERE yt_number IN (SELECT yt_number FROM prod)),
x AS (SELECT our_number AS yt_number, their_number AS number, trim(regexp_replace(manufacturer, '\\s+', ' ', 'g')) AS label FROM staging_interchange WHERE their_number <> '' AND our_number IN (SELECT yt_number FROM prod)),
u AS (SELECT p.yt_number, coalesce(o.id, (SELECT max(id) FROM line_units) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY p.pos)) AS id FROM prod p LEFT JOIN old o USING (yt_number)),
s AS (SELECT yt_number, substitute_yt AS number FROM staging_substitutes WHERE substitute_yt <> '' AND yt_number IN (SELECT yt_number FROM prod)),
stub AS (SELECT (SELECT max(id) FROM parts) + row_number() OVER (ORDER BY p) AS id, number, label FROM (SELECT yt_part AS number, min(pos) AS p, arg_min(part_name, pos) AS label FROM staging_bom WHERE yt_part <> '' AND yt_part NOT IN (SELECT yt_number FROM parts) AND yt_part NOT IN (SELECT part_number FROM parts WHERE part_number IS NOT NULL) GROUP BY 1)),
b AS (SELECT (SELECT max(id) FROM boms) + row_number() OVER (ORDER BY unit_id) AS id, * FROM (SELECT DISTINCT yt_number, u.id AS unit_id FROM staging_bom JOIN u USING (yt_number) WHERE yt_number NOT IN (SELECT i.yt_number FROM boms JOIN ids i USING (unit_id) WHERE name = i.yt_number || ' BOM'))),
target AS (SELECT number, arg_min(id, route) AS id FROM (SELECT yt_number AS number, max(id) AS id, 0 AS route FROM parts WHERE yt_number <> '' GROUP BY 1 UNION ALL SELECT part_number, max(id), 1 FROM parts WHERE part_number <> '' GROUP BY 1 UNION ALL SELECT number, id, 2 FROM stub) GROUP BY 1)
SELECT 'unit' AS kind, p.yt_number, u.id, NULL::bigint AS unit_id, NULL::bigint AS other_id, coalesce(nullif(o.manufacturer, ''), p.manufacturer) AS label, coalesce(nullif(o.family, ''), p.family) AS number,
  CASE WHEN p.notes <> '' AND NOT contains(coalesce(o.notes, ''), p.notes) THEN CASE WHEN coalesce(o.notes, '') = '' THEN p.notes ELSE o.notes || chr(10) || p.notes END ELSE coalesce(o.notes, '') END AS notes,
  CASE WHEN o.id IS NULL THEN 'created' WHEN (o.manufacturer = '' AND p.manufacturer <> '') OR (o.family = '' AND p.family <> '') OR (p.notes <> '' AND NOT contains(o.notes, p.notes)) THEN 'updated' ELSE 'kept' END AS change FROM prod p JOIN u USING (yt_number) LEFT JOIN old o USING (yt_number)
UNION ALL SELECT DISTINCT 'xref', x.yt_number, NULL::bigint, u.id, NULL::bigint, x.label, x.number, NULL, NULL FROM x JOIN u USING (yt_number) WHERE NOT EXISTS (SELECT 1 FROM cross_references c JOIN ids USING (unit_id) WHERE ids.yt_number = x.yt_number AND c.cross_ref_number = x.number AND c.interchange_type = x.label)
UNION ALL SELECT DISTINCT 'substitute', s.yt_number, NULL::bigint, u.id, o.id, o.yt_number, s.number, NULL, NULL FROM s JOIN u USING (yt_number) LEFT JOIN u o ON o.yt_number = s.number WHERE NOT EXISTS (SELECT 1 FROM substitutes c JOIN ids USING (unit_id) WHERE ids.yt_number = s.yt_number AND c.substitute_number = s.number)
UNION ALL SELECT 'part', NULL, id, NULL, NULL, label, number, NULL, NULL FROM stub UNION ALL SELECT 'bom', yt_number, id, unit_id, NULL, yt_number || ' BOM', NULL, NULL, NULL FROM b
UNION ALL SELECT 'item', s.yt_number, pos, b.id, t.id, part_name, yt_part, NULL, NULL FROM staging_bom s JOIN b USING (yt_number) LEFT JOIN target t ON t.number = yt_part WHERE yt_part <> ''""")
def l28(spark: SparkSession, sf: str) -> DataFrame:
    """A product line: all six kinds of rows that its import adds or changes."""
    names = ("staging_products", "staging_interchange", "staging_substitutes", "staging_bom", "line_units", "parts", "boms", "cross_references", "substitutes")
    got = L.import_line(*[frame(spark, sf, n) for n in names])
    unit = got["unit"].select("yt_number", "id", F.col("manufacturer").alias("label"), F.col("family").alias("number"), "notes", "change")
    return stacked(unit=unit, xref=got["xref"], substitute=got["substitute"].withColumnRenamed("other", "label"), part=got["part"], bom=got["bom"], item=got["item"].withColumnRenamed("pos", "id"))


_ONE = "(SELECT identifier, min(id) AS id FROM (SELECT id, unnest([part_number, manufacturer_number, yt_number, j_and_n]) AS identifier FROM parts) WHERE identifier <> '' GROUP BY 1 HAVING count(DISTINCT id) = 1)"
_CROSS = "(SELECT pos, our_number AS source_number, 'J' || substr(their_number, 2, 2) AS number, manufacturer AS section, CASE WHEN pos % 3 = 0 THEN '' ELSE 'Family ' || cast(pos % 4 AS string) END AS family FROM staging_interchange)"


@query("L30", f"""WITH s AS (SELECT trim(number) AS number, arg_min(part_name, pos) AS part_name, arg_min(category, pos) AS category, arg_min(maker, pos) AS maker FROM staging_master GROUP BY 1),
x AS (SELECT pos, source_number, number, trim(regexp_replace(section, '\\s+', ' ', 'g')) AS section, family FROM {_CROSS}),
meta AS (SELECT number, arg_min(family, (source_number, pos)) FILTER (family <> '') AS family, arg_min(section, (source_number, pos)) FILTER (section <> '') AS section FROM x GROUP BY 1),
every AS (SELECT n.number, s.number IS NOT NULL AS detail, s.part_name AS d_name, s.category AS d_category, s.maker AS d_maker, meta.family, meta.section, k.* EXCLUDE number FROM (SELECT number FROM s UNION SELECT number FROM x) n LEFT JOIN s USING (number) LEFT JOIN meta USING (number) LEFT JOIN master_parts k USING (number)),
made AS (SELECT number, id, CASE WHEN id IS NULL THEN coalesce(nullif(d_name, ''), number) ELSE coalesce(nullif(part_name, ''), nullif(d_name, ''), '') END AS part_name,
  coalesce(nullif(category, ''), CASE WHEN detail AND id IS NULL THEN coalesce(nullif(d_category, ''), family, '') WHEN detail THEN d_category ELSE coalesce(family, section, '') END) AS category, coalesce(nullif(maker, ''), d_maker, '') AS maker,
  part_name AS o_name, category AS o_category, maker AS o_maker FROM every),
d AS (SELECT number, ref_number, arg_min('Original number' || CASE WHEN maker <> '' THEN ': ' || maker ELSE '' END || CASE WHEN notes <> '' THEN ' | ' || notes ELSE '' END, pos) AS notes FROM staging_refs WHERE ref_number <> '' AND lower(ref_type) = 'original_number' AND number IN (SELECT number FROM every)
  AND (number, ref_number) NOT IN (SELECT 'J' || cast(part_id AS string), interchange_number FROM part_interchanges) GROUP BY 1, 2),
c AS (SELECT number, source_number AS ref_number, arg_min(concat_ws(' | ', nullif(section, ''), nullif(family, '')), pos) AS notes FROM x WHERE source_number <> '' AND (number, source_number) NOT IN (SELECT 'J' || cast(part_id AS string), interchange_number FROM part_interchanges) AND (number, source_number) NOT IN (SELECT number, ref_number FROM d) GROUP BY 1, 2)
SELECT 'part' AS kind, number, NULL AS ref_number, id AS other, part_name || '/' || category || '/' || maker AS label, CASE WHEN id IS NULL THEN 'created' WHEN part_name <> o_name OR category <> o_category OR maker <> o_maker THEN 'updated' ELSE 'kept' END AS notes FROM made
UNION ALL SELECT 'detail', number, ref_number, o.id, NULL, notes FROM d LEFT JOIN {_ONE} o ON o.identifier = ref_number UNION ALL SELECT 'xref', number, ref_number, o.id, NULL, notes FROM c LEFT JOIN {_ONE} o ON o.identifier = ref_number""")
def l30(spark: SparkSession, sf: str) -> DataFrame:
    """A numbers catalog: parts of both staging tables, then the interchanges of its original numbers and of its cross references."""
    cross = frame(spark, sf, "staging_interchange").select(
        "pos", F.col("our_number").alias("source_number"), F.concat(F.lit("J"), F.substring("their_number", 2, 2)).alias("number"), F.col("manufacturer").alias("section"),
        F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit("Family "), (F.col("pos") % 4).cast("string"))).alias("family"),
    )
    one = R.unambiguous(frame(spark, sf, "parts"), "id", ["part_number", "manufacturer_number", "yt_number", "j_and_n"])
    have = frame(spark, sf, "part_interchanges").select(F.concat(F.lit("J"), "part_id").alias("number"), F.col("interchange_number").alias("ref_number"))
    got = L.import_numbers(frame(spark, sf, "staging_master"), frame(spark, sf, "staging_refs"), cross, frame(spark, sf, "master_parts"), one, have)
    part = got["part"].select("number", F.col("id").alias("other"), F.concat_ws("/", "part_name", "category", "maker").alias("label"), F.col("change").alias("notes"))
    return stacked(part=part, detail=got["detail"], xref=got["xref"])


_OLD = "(SELECT id, yt_number, part_number, CASE WHEN id % 4 = 1 THEN '' ELSE 'old ' || voltage END AS category, CASE WHEN id % 3 = 0 THEN '' ELSE notes END AS notes FROM parts)"
_LAST = f"(SELECT yt_number, arg_max(category, id) AS category, arg_max(notes, id) AS notes FROM {_OLD} WHERE yt_number <> '' GROUP BY 1)"


@query("L36", f"""SELECT p.id, 'fill' AS mode, CASE WHEN o.category <> '' THEN o.category ELSE p.category END AS category, CASE WHEN o.notes <> '' THEN o.notes ELSE p.notes END AS notes FROM parts p LEFT JOIN {_LAST} o USING (yt_number)
UNION ALL SELECT p.id, 'strict', CASE WHEN o.yt_number IS NULL THEN p.category ELSE o.category END, CASE WHEN o.yt_number IS NULL THEN p.notes ELSE o.notes END FROM parts p LEFT JOIN {_LAST} o USING (yt_number)""")
def l36(spark: SparkSession, sf: str) -> DataFrame:
    """Columns copied by key from an older state: blanks there change nothing, or, strictly, clear the value."""
    p = frame(spark, sf, "parts")
    old = p.select("id", "yt_number", F.when(F.col("id") % 4 == 1, "").otherwise(F.concat(F.lit("old "), "voltage")).alias("category"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("notes")).alias("notes"))
    now = p.select("id", "yt_number", "category", "notes")
    return stacked(fill=L.copy_by_key(now, old, "yt_number", ["category", "notes"], strict=False), strict=L.copy_by_key(now, old, "yt_number", ["category", "notes"], strict=True)).select("id", F.col("kind").alias("mode"), "category", "notes")


_KEYWORDS = {"STANDARD BRUSHED TIN": "old 12V", "SMALL PLATED COPPER": "nowhere"}
_WORD = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KEYWORDS.items())
_FIELDS = "(SELECT r_name AS category, 'field ' || cast(n_nationkey % 4 AS string) AS field_name, n_nationkey % 4 AS place FROM nation JOIN region ON r_regionkey = n_regionkey)"


@query("L37", f"""WITH y AS (SELECT yt_number, arg_max(category, id) AS category FROM {_OLD} WHERE category <> '' AND yt_number <> '' GROUP BY 1), n AS (SELECT part_number, arg_max(category, id) AS category FROM {_OLD} WHERE category <> '' AND part_number <> '' GROUP BY 1),
best AS (SELECT p.id, p.category, coalesce(y.category, n.category, CASE p.category {_WORD} END) AS best FROM parts p LEFT JOIN y USING (yt_number) LEFT JOIN n ON n.part_number = p.part_number),
f AS (SELECT DISTINCT * FROM {_FIELDS}), prod AS (SELECT category, CASE WHEN category = 'ASIA' THEN 'new ' || field_name ELSE field_name END AS field_name, place FROM f WHERE category IN ('ASIA', 'EUROPE') UNION ALL SELECT 'MOON', 'field', 0),
changed AS (SELECT DISTINCT category FROM prod WHERE category IN (SELECT category FROM f) AND (EXISTS (SELECT * FROM prod q WHERE q.category = prod.category EXCEPT SELECT * FROM f) OR EXISTS (SELECT * FROM f q WHERE q.category = prod.category EXCEPT SELECT * FROM prod)))
SELECT 'part' AS kind, id, CASE WHEN best IN ('old 12V', 'old 24V') THEN best ELSE category END AS category, NULL AS field_name, NULL::bigint AS place FROM best
UNION ALL SELECT 'field', NULL, category, field_name, place FROM f WHERE category NOT IN (SELECT category FROM changed) UNION ALL SELECT 'field', NULL, category, field_name, place FROM prod WHERE category IN (SELECT category FROM changed)""")
def l37(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of parts by production's yt numbers, part numbers and keywords, and the fields of categories replaced where they differ."""
    p = frame(spark, sf, "parts")
    prod = p.select("id", "yt_number", "part_number", F.when(F.col("id") % 4 == 1, "").otherwise(F.concat(F.lit("old "), "voltage")).alias("category"))
    valid = spark.createDataFrame([("old 12V",), ("old 24V",)], "name string")
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    place = F.col("n_nationkey") % 4
    fields = read("nation").join(read("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("category"), F.concat(F.lit("field "), place).alias("field_name"), place.cast("long").alias("place")).distinct()
    theirs = fields.where("category IN ('ASIA', 'EUROPE')").withColumn("field_name", F.when(F.col("category") == "ASIA", F.concat(F.lit("new "), "field_name")).otherwise(F.col("field_name")))
    theirs = theirs.unionByName(spark.createDataFrame([("MOON", "field", 0)], "category string, field_name string, place long"))
    return stacked(part=L.recategorize(p.select("id", "yt_number", "part_number", "category"), prod, valid, _KEYWORDS).select("id", "category"), field=L.replace_fields(fields, theirs, "category", ["field_name", "place"]))


_REPOINTED = "SELECT coalesce(m.survivor, l.application_id) AS application_id, l.unit_id, min(l.id) AS id, arg_max(l.position, CASE WHEN l.position <> '' THEN l.id END) AS position FROM {links} l LEFT JOIN {mapping} m ON m.loser = l.application_id GROUP BY 1, 2"
_MAKES = {"Brand#11": "Brand#12"}
_PAIRS = [("Brand#21", "Brand#22")]


@query("L03", f"""WITH a AS (SELECT id, CASE make WHEN 'Brand#11' THEN 'Brand#12' ELSE make END AS make, model, engine, year FROM applications),
m1 AS (SELECT v.id AS loser, b.id AS survivor FROM a v JOIN (SELECT model, engine, year, min(id) AS id FROM a WHERE make = 'Brand#21' GROUP BY 1, 2, 3) b USING (model, engine, year) WHERE v.make = 'Brand#22'),
a1 AS (SELECT * FROM a WHERE id NOT IN (SELECT loser FROM m1)), m2 AS (SELECT id AS loser, s AS survivor FROM (SELECT id, min(id) OVER (PARTITION BY make, model, engine, year) AS s FROM a1) WHERE id <> s),
l1 AS ({_REPOINTED.format(links="application_units", mapping="m1")}), l2 AS ({_REPOINTED.format(links="l1", mapping="m2")})
SELECT 'application' AS kind, id, make, model, NULL::bigint AS application_id, NULL::bigint AS unit_id, NULL AS position FROM a1 WHERE id NOT IN (SELECT loser FROM m2) UNION ALL SELECT 'link', id, NULL, NULL, application_id, unit_id, position FROM l2""")
def l03(spark: SparkSession, sf: str) -> DataFrame:
    """Models come with spare spaces and a full stop, which the clean-up takes off again."""
    untidy = frame(spark, sf, "applications").withColumn("model", F.concat(F.regexp_replace("model", " ", "   "), F.lit(".")))
    apps, links = L.cleanup_applications(untidy, frame(spark, sf, "application_units"), _MAKES, _PAIRS)
    return stacked(application=apps.select("id", "make", "model"), link=links.select("id", "application_id", "unit_id", "position"))


@query("L10", """WITH n AS (SELECT id, unit_id, cross_ref_number, notes, CASE interchange_type WHEN 'ALFA ROMEO' THEN 'Alfa Romeo' WHEN 'Alfa-romeo.' THEN 'Alfa-Romeo' WHEN '10346 Ford' THEN '10346 FORD' WHEN 'BOSCH-' THEN 'Bosch-' ELSE interchange_type END AS maker FROM cross_references)
SELECT id, maker FROM (SELECT id, maker, row_number() OVER (PARTITION BY unit_id, cross_ref_number, maker ORDER BY length(notes) DESC, id) AS k FROM n) WHERE k = 1""")
def l10(spark: SparkSession, sf: str) -> DataFrame:
    """FORD and WAI are short words in capitals, which stay so wherever they stand."""
    return L.normalize_makers(frame(spark, sf, "cross_references"), rules.MAKER_ACRONYMS).select("id", F.col("interchange_type").alias("maker"))


def _rewritten_sql(source: str, column: str, value: str, unique: str, name: str) -> str:
    return f"""{name}x AS (SELECT * REPLACE (coalesce({value}, {column}) AS {column}), coalesce({value}, {column}) <> {column} AS moves FROM {source}),
{name} AS (SELECT * EXCLUDE (moves, taken, k) FROM (SELECT *, max(NOT moves) OVER (PARTITION BY {column}, {unique}) AS taken, row_number() OVER (PARTITION BY {column}, {unique}, moves ORDER BY id) AS k FROM {name}x) WHERE NOT moves OR (NOT taken AND k = 1))"""


_OPEN = "CASE WHEN contains(n, '(') AND NOT contains(n, ')') THEN nullif(trim(regexp_replace(n, '\\s*\\([^)]*$', '')), '') END"
_PAGE = "nullif(trim(regexp_replace(n, '(?i)\\s+Pg\\.\\s*\\d+\\s*$', '')), '')"
_BASE = "nullif(trim(regexp_extract(n, '^(.+?)\\s+\\(([^)]+)\\)(.*)$', 1)), '')"


@query("L13", f"""WITH c AS (SELECT id, unit_id, CASE WHEN id % 97 = 0 THEN 'Pg. 17' ELSE cross_ref_number END AS n, interchange_type AS t FROM cross_references),
{_rewritten_sql("c", "n", _OPEN, "unit_id, t", "s0")}, {_rewritten_sql("s0", "n", _PAGE, "unit_id, t", "s1")}, s2 AS (SELECT *, lower(coalesce(t, '')) AS brand FROM s1 WHERE NOT regexp_matches(n, '(?i)^\\s*Pg\\.\\s*\\d+\\s*$')),
s3 AS (SELECT id, unit_id, n, t FROM s2 s WHERE NOT EXISTS (SELECT 1 FROM (SELECT id, unit_id, brand, {_BASE} AS base FROM s2) a WHERE a.unit_id = s.unit_id AND a.brand = s.brand AND a.base = s.n AND a.id <> s.id)),
{_rewritten_sql("s3", "t", "CASE t WHEN 'ALFA ROMEO' THEN 'Alfa Romeo' WHEN 'Alfa-romeo.' THEN 'Alfa Romeo' END", "unit_id, n", "s4")}
SELECT id, unit_id, n AS number, t AS maker FROM s4 s WHERE NOT (t = '10346 Ford' AND EXISTS (SELECT 1 FROM s4 b WHERE b.t = 'FORD' AND b.unit_id = s.unit_id AND b.n = s.n))""")
def l13(spark: SparkSession, sf: str) -> DataFrame:
    """All five steps. Some numbers are made mere page references."""
    x = frame(spark, sf, "cross_references").select("id", "unit_id", F.when(F.col("id") % 97 == 0, "Pg. 17").otherwise(F.col("cross_ref_number")).alias("cross_ref_number"), "interchange_type")
    out = L.cleanup_xrefs(x, {"ALFA ROMEO": "Alfa Romeo", "Alfa-romeo.": "Alfa Romeo"}, [("FORD", "10346 Ford")])
    return out.select("id", "unit_id", F.col("cross_ref_number").alias("number"), F.col("interchange_type").alias("maker"))


_GENERATORS = ", ".join(f"'{m}'" for m in rules.GENERATOR_MAKERS)


@query("L14", f"""WITH u AS (SELECT *, yt_number = '' AND manufacturer = '' AND category = '' AS bare, regexp_replace(trim(unit_number), ',+$', '') AS clean FROM loose_units),
m AS (SELECT u.id AS loser, k.id AS survivor FROM u JOIN (SELECT unit_number, min(id) AS id FROM loose_units GROUP BY 1) k ON k.unit_number = u.clean WHERE NOT bare AND ends_with(u.unit_number, ',')),
l AS (SELECT a.id, a.application_id, coalesce(m.survivor, a.unit_id) AS unit_id, m.loser IS NOT NULL AS moves FROM application_units a LEFT JOIN m ON m.loser = a.unit_id),
r AS (SELECT *, max(NOT moves) OVER (PARTITION BY unit_id, application_id) AS taken, row_number() OVER (PARTITION BY unit_id, application_id, moves ORDER BY id) AS k FROM l),
s AS (SELECT id, bare, yt_number, CASE WHEN NOT bare THEN clean ELSE unit_number END AS unit_number, CASE WHEN bare OR category <> '' THEN category WHEN upper(trim(family)) = 'TILT&TRIM' THEN 'Motor' WHEN upper(trim(family)) IN ('DD', 'PMGR') THEN 'Starter'
  WHEN regexp_matches(trim(yt_number), '^[45][0-9]{{5}}$') THEN 'Generator' WHEN regexp_matches(trim(yt_number), '^[0-9]{{6,}}$') AND manufacturer IN ({_GENERATORS}) THEN 'Generator' WHEN unit_type <> '' THEN unit_type WHEN manufacturer = 'Romaine Electric' THEN 'Alternator' ELSE '' END AS category
  FROM u WHERE id NOT IN (SELECT loser FROM m)),
h AS (SELECT cross_ref_number AS unit_number, arg_min(s.yt_number, s.id) AS yt FROM cross_references c JOIN s ON s.id = c.unit_id WHERE s.yt_number <> '' GROUP BY 1),
f AS (SELECT s.id, s.unit_number, s.category, CASE WHEN s.bare OR s.yt_number <> '' OR s.unit_number = '' THEN s.yt_number WHEN s.category = 'Motor' AND regexp_matches(s.unit_number, '^45[0-9]{{4}}$') THEN s.unit_number ELSE coalesce(h.yt, '') END AS yt_number FROM s LEFT JOIN h USING (unit_number))
SELECT 'unit' AS kind, id, unit_number, category, yt_number, NULL::bigint AS unit_id FROM f WHERE lower(unit_number) <> 'test' AND lower(yt_number) <> 'test'
UNION ALL SELECT 'link', id, NULL, NULL, NULL, unit_id FROM r WHERE (NOT moves OR (NOT taken AND k = 1)) AND unit_id NOT IN (SELECT id FROM f WHERE lower(unit_number) = 'test' OR lower(yt_number) = 'test')""")
def l14(spark: SparkSession, sf: str) -> DataFrame:
    units, links = L.cleanup_units(frame(spark, sf, "loose_units"), frame(spark, sf, "cross_references"), frame(spark, sf, "application_units"), rules.GENERATOR_MAKERS)
    return stacked(unit=units.select("id", "unit_number", "category", "yt_number"), link=links.select("id", "unit_id"))


_LEAKED = "(SELECT id, CASE WHEN id % 6 = 1 THEN 'Bosch: 1 | ' || yt_number ELSE yt_number END AS yt_number, CASE WHEN id % 5 = 2 THEN part_name || ' | Delco: 2' ELSE part_name END AS part_name, notes FROM parts)"
_FEW_ITEMS = "(SELECT id, part_id FROM bom_items WHERE part_id IS NULL OR part_id % 3 = 0)"


@query("L07", f"""WITH p AS (SELECT *, contains(yt_number, '|') OR (contains(part_name, '|') AND id IN (SELECT part_id FROM {_FEW_ITEMS} WHERE part_id IS NOT NULL)) AS gone FROM {_LEAKED})
SELECT 'part' AS kind, id, CASE WHEN contains(part_name, '|') THEN '' ELSE part_name END AS part_name, CASE WHEN contains(part_name, '|') THEN '' ELSE notes END AS notes FROM p WHERE NOT gone
UNION ALL SELECT 'item', id, NULL, NULL FROM {_FEW_ITEMS} i WHERE part_id IS NULL OR part_id NOT IN (SELECT id FROM p WHERE gone)""")
def l07(spark: SparkSession, sf: str) -> DataFrame:
    """Lists leaked into some parts' numbers and names; a third of the parts has items."""
    yt = F.when(F.col("id") % 6 == 1, F.concat(F.lit("Bosch: 1 | "), "yt_number")).otherwise(F.col("yt_number"))
    name = F.when(F.col("id") % 5 == 2, F.concat("part_name", F.lit(" | Delco: 2"))).otherwise(F.col("part_name"))
    items = frame(spark, sf, "bom_items").select("id", "part_id").where("part_id IS NULL OR part_id % 3 = 0")
    parts, items = L.cleanup_leaked_parts(frame(spark, sf, "parts").select("id", yt.alias("yt_number"), name.alias("part_name"), "notes"), items)
    return stacked(part=parts.drop("yt_number"), item=items.select("id"))


@query("L22", """WITH s AS (SELECT pos, yt_part AS yt_number, part_name, CASE WHEN pos % 3 = 0 THEN '' ELSE 'Kits' END AS category FROM staging_bom WHERE yt_part <> ''),
f AS (SELECT yt_number, arg_min(part_name, pos) FILTER (part_name <> '') AS part_name, arg_min(category, pos) FILTER (category <> '') AS category FROM s GROUP BY 1),
o AS (SELECT yt_number, max(id) AS id, arg_max(part_name, id) AS part_name, arg_max(category, id) AS category FROM (SELECT id, yt_number, CASE WHEN id % 2 = 0 THEN '' ELSE part_name END AS part_name, CASE WHEN id % 3 = 0 THEN '' ELSE category END AS category FROM parts) GROUP BY 1),
x AS (SELECT our_number AS yt_number, their_number AS number, trim(regexp_replace(manufacturer, '\\s+', ' ', 'g')) AS maker FROM staging_interchange WHERE our_number IN (SELECT yt_number FROM f) AND their_number <> '')
SELECT 'part' AS kind, f.yt_number, o.id, coalesce(nullif(o.part_name, ''), f.part_name, '') AS label, coalesce(nullif(o.category, ''), f.category, '') AS maker,
  CASE WHEN o.id IS NULL THEN 'created' WHEN (o.part_name = '' AND f.part_name <> '') OR (o.category = '' AND f.category <> '') THEN 'updated' ELSE 'kept' END AS change FROM f LEFT JOIN o USING (yt_number)
UNION ALL SELECT DISTINCT 'interchange', yt_number, NULL::bigint, number, maker, NULL FROM x WHERE NOT EXISTS (SELECT 1 FROM part_interchanges i JOIN parts p ON p.id = i.part_id WHERE p.yt_number = x.yt_number AND i.interchange_number = x.number AND i.source_name = x.maker)
UNION ALL SELECT DISTINCT 'link', b.yt_part, u.id, NULL, NULL, NULL FROM staging_bom b JOIN (SELECT unit_number, max(id) AS id FROM units WHERE unit_number IS NOT NULL GROUP BY 1) u ON u.unit_number = 'U' || substr(b.yt_number, 3)
  WHERE b.yt_part <> '' AND NOT EXISTS (SELECT 1 FROM part_units k JOIN parts p ON p.id = k.part_id WHERE p.yt_number = b.yt_part AND k.unit_id = u.id)""")
def l22(spark: SparkSession, sf: str) -> DataFrame:
    staged = frame(spark, sf, "staging_bom")
    parts = frame(spark, sf, "parts").select("id", "yt_number", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("part_name")).alias("part_name"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("category")).alias("category"))
    numbers = parts.select(F.col("id").alias("part_id"), "yt_number").where("yt_number <> ''")
    known = frame(spark, sf, "part_interchanges").join(numbers, "part_id").select("yt_number", F.col("interchange_number").alias("number"), F.col("source_name").alias("maker"))
    linked = frame(spark, sf, "part_units").join(numbers, "part_id").select("yt_number", "unit_id")
    xrefs = frame(spark, sf, "staging_interchange").select("pos", F.col("our_number").alias("yt_number"), F.col("their_number").alias("number"), F.col("manufacturer").alias("maker"))
    links = staged.where("yt_part <> ''").select("pos", F.col("yt_part").alias("yt_number"), F.concat(F.lit("U"), F.expr("substr(yt_number, 3)")).alias("unit_number"))
    components = staged.select("pos", F.col("yt_part").alias("yt_number"), "part_name", F.when(F.col("pos") % 3 == 0, "").otherwise("Kits").alias("category"))
    got = L.import_components(components, xrefs, links, parts, known, linked, frame(spark, sf, "units"))
    part = got["part"].select("yt_number", "id", F.col("part_name").alias("label"), F.col("category").alias("maker"), "change")
    return stacked(part=part, interchange=got["interchange"].withColumnRenamed("number", "label"), link=got["link"].withColumnRenamed("unit_id", "id"))


@query("L27", f"""WITH s AS (SELECT pos, trim(number) AS number, part_name, coalesce(nullif(category, ''), code) AS category, maker FROM staging_master),
f AS (SELECT number, arg_min(part_name, pos) AS first_name, arg_min(part_name, pos) FILTER (part_name <> '') AS part_name, arg_min(category, pos) FILTER (category <> '') AS category, arg_min(maker, pos) FILTER (maker <> '') AS maker FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY number, ref_number ORDER BY pos) AS k FROM staging_refs WHERE ref_number <> '' AND number IN (SELECT number FROM f) AND (number, ref_number) NOT IN (SELECT 'J' || cast(part_id AS string), interchange_number FROM part_interchanges))
SELECT 'part' AS kind, f.number, NULL AS ref_number, k.id AS other, CASE WHEN k.id IS NULL THEN coalesce(nullif(first_name, ''), f.number) ELSE coalesce(nullif(k.part_name, ''), f.part_name, '') END || '/' || coalesce(nullif(k.category, ''), f.category, '') || '/' || coalesce(nullif(k.maker, ''), f.maker, '') AS label,
  CASE WHEN k.id IS NULL THEN 'created' WHEN (k.part_name = '' AND f.part_name <> '') OR (k.category = '' AND f.category <> '') OR (k.maker = '' AND f.maker <> '') THEN 'updated' ELSE 'kept' END AS notes FROM f LEFT JOIN master_parts k USING (number)
UNION ALL SELECT 'interchange', number, ref_number, o.id, NULL, 'Metro ' || lower(coalesce(nullif(ref_type, ''), 'reference')) || ': ' || ref_number || CASE WHEN notes <> '' THEN ' | ' || notes ELSE '' END FROM r LEFT JOIN {_ONE} o ON o.identifier = ref_number WHERE k = 1""")
def l27(spark: SparkSession, sf: str) -> DataFrame:
    one = R.unambiguous(frame(spark, sf, "parts"), "id", ["part_number", "manufacturer_number", "yt_number", "j_and_n"])
    have = frame(spark, sf, "part_interchanges").select(F.concat(F.lit("J"), "part_id").alias("number"), F.col("interchange_number").alias("ref_number"))
    got = L.import_by_references(frame(spark, sf, "staging_master"), frame(spark, sf, "staging_refs"), frame(spark, sf, "master_parts"), one, have, "Metro")
    part = got["part"].select("number", F.col("id").alias("other"), F.concat_ws("/", "part_name", "category", "maker").alias("label"), F.col("change").alias("notes"))
    return stacked(part=part, interchange=got["interchange"])


_PRODUCTS = "(SELECT CASE WHEN pos <= 29 THEN 'BOM ' || cast(pos AS string) ELSE yt_number END AS name, notes AS description FROM staging_products)"


@query("L24", f"""WITH unit AS (SELECT yt_number AS number, max(id) AS id FROM line_units GROUP BY 1), old AS (SELECT name, min(id) AS id, arg_min(unit_id, id) AS unit_id FROM (SELECT id, name, coalesce(unit_id, NULL) AS unit_id FROM boms) GROUP BY 1),
first AS (SELECT b.name, b.id, b.unit_id FROM boms b JOIN old ON old.id = b.id),
h AS (SELECT p.name, o.id, coalesce(o.unit_id, u.id) AS unit_id, p.description, CASE WHEN o.id IS NULL THEN 'created' WHEN p.description <> '' OR (o.unit_id IS NULL AND u.id IS NOT NULL) THEN 'updated' ELSE 'kept' END AS change FROM {_PRODUCTS} p LEFT JOIN unit u ON u.number = p.name LEFT JOIN first o ON o.name = p.name),
known AS (SELECT 'jn' AS by, j_and_n AS number, max(id) AS part_id FROM parts WHERE j_and_n <> '' GROUP BY 2 UNION ALL SELECT 'oem', manufacturer_number, max(id) FROM parts GROUP BY 2),
r AS (SELECT pos, yt_number AS name, part_name AS text, CASE WHEN pos % 4 = 0 THEN 'as req' ELSE cast(pos % 9 AS string) END AS qty, CASE WHEN pos % 3 = 0 THEN '' ELSE jn_part END AS jn, CASE WHEN pos % 5 = 0 THEN '' ELSE 'MF' || substr(yt_part, 3) END AS oem FROM staging_bom),
i AS (SELECT pos, name, text, coalesce(try_cast(qty AS int), 1) AS qty, CASE WHEN jn <> '' THEN 'jn' ELSE 'oem' END AS by, CASE WHEN jn <> '' THEN jn ELSE oem END AS number FROM r WHERE (jn <> '' OR oem <> '') AND name IN (SELECT name FROM h)),
j AS (SELECT i.*, k.part_id FROM i LEFT JOIN known k ON k.by = i.by AND k.number = i.number),
x AS (SELECT s.pos, u.id AS unit_id, s.ref_number, CASE lower(ref_type) WHEN 'substitute' THEN 'Substitute' WHEN 'superseded_by' THEN 'Superseded By' ELSE 'Reference' END || CASE WHEN lower(ref_type) <> 'superseded_by' AND maker <> '' THEN ': ' || maker ELSE '' END AS label
  FROM (SELECT pos, 'YT' || substr(number, 2) AS name, CASE WHEN starts_with(ref_number, 'J') THEN 'YT' || substr(ref_number, 2) ELSE ref_number END AS ref_number, ref_type, maker FROM staging_refs WHERE ref_number <> '') s JOIN unit u ON u.number = s.name)
SELECT 'bom' AS kind, name, id, unit_id AS other, description AS label, change AS number, NULL::int AS qty FROM h UNION ALL SELECT 'item', name, pos, part_id, NULL, number, qty FROM j
UNION ALL SELECT 'part', NULL, NULL, NULL, arg_min(text, pos), number, NULL FROM j WHERE part_id IS NULL GROUP BY number
UNION ALL SELECT DISTINCT 'xref', NULL, x.unit_id, CASE WHEN u.id <> x.unit_id THEN u.id END, label, ref_number, NULL FROM x LEFT JOIN unit u ON u.number = x.ref_number""")
def l24(spark: SparkSession, sf: str) -> DataFrame:
    """BOMs of units: headers, items with quantities as text, stub parts, and references with labels."""
    i = F.col("pos")
    products = frame(spark, sf, "staging_products").select(F.when(i <= 29, F.concat(F.lit("BOM "), i.cast("string"))).otherwise(F.col("yt_number")).alias("name"), F.col("notes").alias("description"))
    rows = frame(spark, sf, "staging_bom").select(
        "pos", F.col("yt_number").alias("name"), F.col("part_name").alias("text"), F.when(i % 4 == 0, "as req").otherwise((i % 9).cast("string")).alias("qty"),
        F.when(i % 3 == 0, "").otherwise(F.col("jn_part")).alias("jn"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("MF"), F.expr("substr(yt_part, 3)"))).alias("oem"),
    )
    as_unit = lambda c: F.when(F.col(c).startswith("J"), F.concat(F.lit("YT"), F.expr(f"substr({c}, 2)"))).otherwise(F.col(c))
    refs = frame(spark, sf, "staging_refs").select("pos", as_unit("number").alias("name"), F.lower("ref_type").alias("ref_type"), "maker", as_unit("ref_number").alias("ref_number"))
    units = frame(spark, sf, "line_units").select(F.col("yt_number").alias("number"), "id")
    boms = frame(spark, sf, "boms").select("id", "name", "unit_id", F.lit("").alias("description"))
    parts = frame(spark, sf, "parts").select("id", "j_and_n", F.col("manufacturer_number").alias("oem_number"))
    got = L.import_boms(products, rows, refs, units, boms, parts)
    return stacked(
        bom=got["bom"].select("name", "id", F.col("unit_id").alias("other"), F.col("description").alias("label"), F.col("change").alias("number")),
        item=got["item"].select("name", F.col("pos").alias("id"), F.col("part_id").alias("other"), "number", "qty"), part=got["part"], xref=got["xref"].withColumnRenamed("unit_id", "id"),
    )


_FOUND = "SELECT unit, '{c}' AS category, {f} AS field, '{s}' AS status, '{v}' AS severity, '{t}' AS tag FROM {src}"
_ATTR = {
    "e": "SELECT id AS unit, field, value FROM (SELECT id, unnest(['family', 'maker', 'colour']) AS field, unnest([CASE WHEN id % 3 = 0 THEN '' ELSE family END, CASE WHEN id % 4 = 0 THEN 'Other' ELSE ' ' || upper(manufacturer) END, CASE WHEN id % 10 = 0 THEN 'red' ELSE '' END]) AS value FROM units)",
    "s": "SELECT id AS unit, field, value FROM (SELECT id, unnest(['family', 'maker']) AS field, unnest([CASE WHEN id % 7 = 0 THEN '' ELSE family END, manufacturer]) AS value FROM units)",
}


def _finds(category: str, *rows: tuple[str, str, str, str, str]) -> str:
    return " UNION ALL ".join(_FOUND.format(c=category, f=f, s=s, v=v, t=t, src=src) for f, s, v, t, src in rows)


_APPS_E = "SELECT id, id % 50 AS unit, make, model, engine, CASE WHEN id % 4 = 0 THEN '1999-2001' ELSE year END AS year FROM applications WHERE id % 7 <> 0"
_APPS_S = "SELECT id, id % 50 AS unit, upper(make) AS make, CASE WHEN id % 9 = 0 THEN 'GS-A,B' ELSE model END AS model, CASE WHEN id % 11 = 0 THEN '2000- 2002' ELSE engine END AS engine, CASE WHEN id % 13 = 0 THEN '2000-2000' ELSE year END AS year FROM applications WHERE id % 8 <> 0"
_NORM_YEAR = "CASE WHEN regexp_matches(trim(year), '^[0-9]{2}-[0-9]{2}$') THEN (CASE WHEN substr(trim(year), 1, 2)::int >= 70 THEN '19' ELSE '20' END) || substr(trim(year), 1, 2) || '-' || (CASE WHEN substr(trim(year), 4, 2)::int >= 70 THEN '19' ELSE '20' END) || substr(trim(year), 4, 2) ELSE trim(year) END"
_NORMED = "SELECT *, concat_ws('|', unit, lower(make), lower(model), lower(engine), {y}) AS k, concat_ws('/', make, model, engine, year) AS whole, concat_ws('/', make, model, engine) AS named FROM ({src})"
_ITEMS_E = "SELECT pos, cast(substr(yt_number, 3) AS bigint) AS unit, lower(yt_part) AS number, part_name AS text, CASE WHEN pos % 3 = 0 THEN 'jn ' ELSE jn_part END AS jn FROM staging_bom"
_ITEMS_S = "SELECT id, bom_id % 300 AS unit, yt_number AS number, description AS text, CASE WHEN id % 5 = 0 THEN '130- 05' ELSE j_and_n END AS jn FROM bom_items"
_ONE_ITEM = "SELECT unit, upper(number) AS number, arg_max(trim(jn), {by}) AS jn FROM ({src}) WHERE number <> '' GROUP BY 1, 2"


@query("L01", f"""WITH ae AS (SELECT unit, field, trim(value) AS v FROM ({_ATTR["e"]}) WHERE trim(value) <> ''), as_ AS (SELECT unit, field, trim(value) AS v FROM ({_ATTR["s"]}) WHERE trim(value) <> ''),
ab AS (SELECT coalesce(e.unit, s.unit) AS unit, coalesce(e.field, s.field) AS field, e.v AS ev, s.v AS sv FROM (SELECT * FROM ae WHERE field <> 'colour') e FULL JOIN as_ s ON e.unit = s.unit AND e.field = s.field),
xe AS (SELECT unit_id AS unit, trim(upper(interchange_type)) AS maker, cross_ref_number AS number FROM cross_references WHERE id % 5 <> 0), xs AS (SELECT unit_id AS unit, interchange_type AS maker, cross_ref_number AS number FROM cross_references WHERE id % 6 <> 0 UNION ALL SELECT unit_id, 'ford', cross_ref_number FROM cross_references WHERE id % 12 = 1),
ne AS ({_NORMED.format(y=_NORM_YEAR, src=_APPS_E)}), ns AS ({_NORMED.format(y=_NORM_YEAR, src=_APPS_S)}),
ie AS ({_ONE_ITEM.format(by="pos", src=_ITEMS_E)}), is_ AS ({_ONE_ITEM.format(by="id", src=_ITEMS_S)}), ib AS (SELECT coalesce(e.unit, s.unit) AS unit, coalesce(e.number, s.number) AS number, e.jn AS ej, s.jn AS sj FROM ie e FULL JOIN is_ s ON e.unit = s.unit AND e.number = s.number),
ue AS (SELECT unit_id AS unit, CASE WHEN id % 4 = 0 THEN 'Q' ELSE substitute_number END AS number FROM substitutes), us AS (SELECT unit_id AS unit, substitute_number AS number FROM substitutes WHERE id % 3 <> 0),
found AS ({_finds("ATTRIBUTE", ("field", "EXTRA_IN_DB", "INFO", "db_value_no_pdf_source", "ab WHERE ev IS NULL"), ("field", "MISSING_IN_DB", "ERROR", "pdf_attr_not_imported", "ab WHERE sv IS NULL"), ("field", "MATCH", "INFO", "", "ab WHERE lower(ev) = lower(sv)"), ("field", "MISMATCH", "ERROR", "attr_value_differs", "ab WHERE lower(ev) <> lower(sv)"), ("field", "FLAG", "WARN", "unmapped_attr_key", "ae WHERE field = 'colour'"))}
UNION ALL {_finds("INTERCHANGE", ("concat_ws(':', maker, number)", "MISSING_IN_DB", "ERROR", "pdf_xref_not_in_db", "xe WHERE (unit, lower(maker), number) NOT IN (SELECT unit, lower(maker), number FROM xs)"), ("concat_ws(':', maker, number)", "MATCH", "INFO", "", "xe WHERE (unit, lower(maker), number) IN (SELECT unit, lower(maker), number FROM xs)"), ("concat_ws(':', maker, number)", "EXTRA_IN_DB", "INFO", "db_xref_not_in_pdf", "xs WHERE (unit, lower(maker), number) NOT IN (SELECT unit, lower(maker), number FROM xe)"), ("m || ':' || number", "FLAG", "ERROR", "case_variant_dupe", "(SELECT unit, lower(maker) AS m, number FROM xs GROUP BY 1, 2, 3 HAVING count(DISTINCT maker) > 1)"))}
UNION ALL {_finds("APPLICATION", ("whole", "MISSING_IN_DB", "ERROR", "pdf_app_not_in_db", "ne WHERE k NOT IN (SELECT k FROM ns)"), ("whole", "MATCH", "INFO", "", "ne WHERE k IN (SELECT k FROM ns)"), ("whole", "EXTRA_IN_DB", "INFO", "db_app_not_in_pdf", "ns WHERE k NOT IN (SELECT k FROM ne)"), ("named", "FLAG", "ERROR", "year_format_dupe", "(SELECT unit, k, arg_min(named, id) AS named FROM ns GROUP BY 1, 2 HAVING count(DISTINCT trim(year)) > 1)"), ("named", "FLAG", "WARN", "year_2digit", "ns WHERE regexp_matches(trim(year), '^[0-9]{2}-[0-9]{2}$')"), ("named", "FLAG", "ERROR", "year_pipe_noise", "ns WHERE contains(year, '|')"), ("named", "FLAG", "WARN", "year_same_start_end", "ns WHERE regexp_matches(trim(year), '^[0-9]{4}-[0-9]{4}$') AND substr(trim(year), 1, 4) = substr(trim(year), 6, 4)"), ("named", "FLAG", "ERROR", "line_wrap_year_in_engine", "ns WHERE engine = '2000- 2002'"), ("named", "FLAG", "ERROR", "submodel_list_not_split", "ns WHERE model = 'GS-A,B'"))}
UNION ALL {_finds("BOM", ("number", "MISSING_IN_DB", "ERROR", "pdf_bom_item_missing", "ib WHERE sj IS NULL"), ("number", "EXTRA_IN_DB", "INFO", "db_bom_item_not_in_pdf", "ib WHERE ej IS NULL"), ("number", "MISMATCH", "WARN", "bom_jn_differs", "ib WHERE ej <> '' AND sj <> '' AND lower(ej) <> lower(sj)"), ("number", "MATCH", "INFO", "", "ib WHERE ej IS NOT NULL AND sj IS NOT NULL AND NOT (ej <> '' AND sj <> '' AND lower(ej) <> lower(sj))"), ("number", "FLAG", "ERROR", "jn_line_wrap", f"({_ITEMS_S}) WHERE jn = '130- 05'"))}
UNION ALL {_finds("SUBSTITUTE", ("number", "MISSING_IN_DB", "WARN", "pdf_substitute_not_in_db", "ue WHERE (unit, number) NOT IN (SELECT unit, number FROM us)"), ("number", "MATCH", "INFO", "", "ue WHERE (unit, number) IN (SELECT unit, number FROM us)"), ("number", "EXTRA_IN_DB", "INFO", "db_substitute_not_in_pdf", "us WHERE (unit, number) NOT IN (SELECT unit, number FROM ue)"))})
SELECT 'finding' AS kind, unit, category, field, status, severity, tag, NULL::bigint AS n FROM found UNION ALL SELECT 'severity', NULL, NULL, severity, NULL, NULL, NULL, count(*) FROM found GROUP BY severity
UNION ALL SELECT 'issue', NULL, NULL, category || ':' || status, NULL, NULL, NULL, count(*) FROM found WHERE status <> 'MATCH' GROUP BY 4 UNION ALL SELECT 'tag', NULL, NULL, tag, NULL, NULL, NULL, count(*) FROM found WHERE tag <> '' GROUP BY tag""")
def l01(spark: SparkSession, sf: str) -> DataFrame:
    """Five kinds of rows, expected and stored, of which some differ; every finding, and what is counted of them."""
    i = F.col("id")
    u, x, s = frame(spark, sf, "units"), frame(spark, sf, "cross_references"), frame(spark, sf, "substitutes")
    long = lambda df, cols: df.select(i.alias("unit"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in cols.items()])).alias("a")).select("unit", "a.*")
    unless = lambda k, v, c: F.when(i % k == 0, v).otherwise(c)
    wanted = {"family": unless(3, "", F.col("family")), "maker": unless(4, "Other", F.concat(F.lit(" "), F.upper("manufacturer"))), "colour": unless(10, "red", F.lit(""))}
    attributes = L.audit_attributes(long(u, wanted), long(u, {"family": unless(7, "", F.col("family")), "maker": F.col("manufacturer")}), ["family", "maker"])
    as_x = lambda df, maker: df.select(F.col("unit_id").alias("unit"), maker.alias("maker"), F.col("cross_ref_number").alias("number"))
    stored = as_x(x.where(i % 6 != 0), F.col("interchange_type")).unionByName(as_x(x.where(i % 12 == 1), F.lit("ford")))
    interchanges = L.audit_interchanges(as_x(x.where(i % 5 != 0), F.upper("interchange_type")), stored)
    apps = frame(spark, sf, "applications").withColumn("unit", i % 50)
    expected = apps.where(i % 7 != 0).select("unit", "make", "model", "engine", unless(4, "1999-2001", F.col("year")).alias("year"))
    have = apps.where(i % 8 != 0).select("id", "unit", F.upper("make").alias("make"), unless(9, "GS-A,B", F.col("model")).alias("model"), unless(11, "2000- 2002", F.col("engine")).alias("engine"), unless(13, "2000-2000", F.col("year")).alias("year"))
    bom = frame(spark, sf, "staging_bom").select("pos", F.expr("cast(substr(yt_number, 3) AS bigint)").alias("unit"), F.lower("yt_part").alias("number"), F.col("part_name").alias("text"), F.when(F.col("pos") % 3 == 0, "jn ").otherwise(F.col("jn_part")).alias("jn"))
    items = frame(spark, sf, "bom_items").select("id", (F.col("bom_id") % 300).alias("unit"), F.col("yt_number").alias("number"), F.col("description").alias("text"), unless(5, "130- 05", F.col("j_and_n")).alias("jn"))
    as_s = lambda df, number: df.select(F.col("unit_id").alias("unit"), number.alias("number"))
    substitutes = L.audit_substitutes(as_s(s, unless(4, "Q", F.col("substitute_number"))), as_s(s.where(i % 3 != 0), F.col("substitute_number")))
    kinds = (attributes, interchanges, L.audit_applications(expected, have), L.audit_items(bom, items), substitutes)
    found = functools.reduce(DataFrame.unionByName, [k.withColumn("unit", F.col("unit").cast("long")) for k in kinds])
    found = written(found.drop("expected", "stored"), "findings")
    counts = L.audit_counts(found).select("kind", F.col("name").alias("field"), "n")
    return stacked(finding=found).unionByName(counts, allowMissingColumns=True)


_GUIDE = "(SELECT pos, our_number AS unit_number, their_number AS number, CASE WHEN pos % 7 = 0 THEN 'model  NUMBER' ELSE manufacturer END AS maker FROM staging_interchange)"


@query("L23", f"""{BLOCKS_SQL}, g AS (SELECT pos, u.id AS unit_id, trim(g.number) AS number, trim(regexp_replace(maker, '\\s+', ' ', 'g')) AS maker FROM {_GUIDE} g JOIN units u ON u.unit_number = trim(g.unit_number) WHERE trim(g.number) <> ''),
t AS (SELECT unit_id, arg_min(number, pos) AS told FROM g WHERE lower(maker) = 'model number' GROUP BY 1)
SELECT 'unit' AS kind, u.id, coalesce(nullif(trim(family), ''), told, '') AS number, NULL AS maker FROM units u LEFT JOIN t ON t.unit_id = u.id
UNION ALL SELECT DISTINCT 'xref', unit_id, number, maker FROM g WHERE lower(maker) <> 'model number' AND NOT EXISTS (SELECT 1 FROM cross_references c WHERE c.unit_id = g.unit_id AND c.cross_ref_number = g.number AND c.interchange_type = g.maker)
UNION ALL SELECT DISTINCT 'application', cast(substr(key, 2) AS bigint) % 100, concat_ws('/', make, model, engine, year), NULL FROM applications_read WHERE model <> ''""")
def l23(spark: SparkSession, sf: str) -> DataFrame:
    """A guide's interchanges, of which some tell a unit's family, and the applications in its texts; BOMs and substitutes are as in L28."""
    rows = frame(spark, sf, "staging_interchange").select("pos", F.col("our_number").alias("unit_number"), F.col("their_number").alias("number"), F.when(F.col("pos") % 7 == 0, "model  NUMBER").otherwise(F.col("manufacturer")).alias("maker"))
    got = L.import_guide_xrefs(rows, frame(spark, sf, "units"), frame(spark, sf, "cross_references"))
    found = application_blocks(application_texts(spark, sf), "key", "text", rules.ATTRIBUTE_NAMES)
    apps = found.select((F.substring("key", 2, 20).cast("long") % 100).alias("id"), F.concat_ws("/", "make", "model", "engine", "year").alias("number")).distinct()
    return stacked(unit=got["unit"].withColumnRenamed("family", "number"), xref=got["xref"].withColumnRenamed("unit_id", "id"), application=apps)


_STAR_UNITS = "(SELECT c_custkey AS pos, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 9 = 1 THEN 'P1' ELSE 'C' || cast(c_custkey AS string) END AS number, c_nationkey AS type_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 6 END AS maker_id, c_mktsegment AS note FROM customer)"
_STAR_PARTS = "(SELECT p_partkey AS pos, 'P' || cast(p_partkey AS string) AS number, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS class, p_size AS type_id, p_partkey % 7 AS maker_id, p_brand AS note FROM part)"
_STAR_APPS = "(SELECT o_orderkey AS id, o_custkey % 30 AS make_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 END AS model_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS engine, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '1999-2001' END AS years, 'C' || cast(o_custkey AS string) AS number, o_orderpriority AS position FROM orders)"


@query("L26", f"""WITH nat AS (SELECT n_nationkey AS id, n_name AS name FROM nation), reg AS (SELECT r_regionkey AS id, r_name AS name FROM region),
u0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY pos) AS k FROM {_STAR_UNITS} WHERE number <> '') WHERE k = 1), p0 AS (SELECT * FROM {_STAR_PARTS}),
b AS (SELECT DISTINCT 'C' || cast(l_orderkey % 200 AS string) AS number, 'P' || cast(l_partkey AS string) AS other FROM lineitem),
x AS (SELECT DISTINCT 'C' || cast(l_suppkey AS string) AS number, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'C' || cast(l_partkey % 120 AS string) ELSE 'X' || cast(l_partkey AS string) END AS other, l_linenumber % 6 AS type_id FROM lineitem)
SELECT 'unit' AS kind, number, NULL AS name, coalesce(nat.name, '') AS label, coalesce(reg.name, '') AS maker, note AS notes, NULL AS other FROM u0 LEFT JOIN nat ON nat.id = type_id LEFT JOIN reg ON reg.id = maker_id
UNION ALL SELECT 'part', number, coalesce(nullif(class, ''), number), coalesce(nat.name, ''), coalesce(reg.name, ''), note, NULL FROM p0 LEFT JOIN nat ON nat.id = type_id LEFT JOIN reg ON reg.id = maker_id
UNION ALL SELECT 'application', cast(a.id AS string), coalesce(nullif(concat_ws(' ', nat.name, reg.name, nullif(engine, ''), years), ''), 'App-' || a.id) || ' [#' || a.id || ']', CASE WHEN a.number IN (SELECT number FROM u0) THEN position END, NULL, NULL, CASE WHEN a.number IN (SELECT number FROM u0) THEN a.number END
  FROM {_STAR_APPS} a LEFT JOIN nat ON nat.id = make_id LEFT JOIN reg ON reg.id = model_id
UNION ALL SELECT 'bom', number, NULL, NULL, NULL, NULL, other FROM b WHERE number IN (SELECT number FROM u0) AND other IN (SELECT number FROM p0)
UNION ALL SELECT DISTINCT 'xref', number, NULL, coalesce(reg.name, ''), NULL, CASE WHEN other <> number AND other IN (SELECT number FROM u0) THEN 'true' ELSE 'false' END, other FROM x LEFT JOIN reg ON reg.id = type_id WHERE other <> '' AND number IN (SELECT number FROM u0)
UNION ALL SELECT 'report', step, NULL, CASE WHEN attempt = 1 THEN CASE WHEN n_step <= 3 THEN 'done' ELSE 'left' END ELSE CASE WHEN n_step <= 3 THEN 'done before' ELSE 'done' END END, NULL, NULL, cast(attempt AS string)
  FROM (VALUES (1, 'unit'), (2, 'part'), (3, 'application'), (4, 'bom'), (5, 'xref')) AS t(n_step, step), (VALUES (1), (2)) AS a(attempt)""")
def l26(spark: SparkSession, sf: str) -> DataFrame:
    """A star of facts and lookups as five steps. The first attempt stops before the BOMs, the second has the other steps and goes on; the rows are those that are published then."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    nation, region = read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), read("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    with_tables = lambda sql, **tables: spark.sql(re.sub(r"\bFROM (\w+)\)$", r"FROM {\1})", f"SELECT * FROM {sql}"), **tables)
    line = read("lineitem")
    unit_of = lambda n: F.concat(F.lit("C"), n.cast("string")).alias("number")
    other = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, F.concat(F.lit("C"), F.col("l_partkey") % 120)).otherwise(F.concat(F.lit("X"), "l_partkey"))
    tables = {
        "unit": with_tables(_STAR_UNITS, customer=read("customer")), "part": with_tables(_STAR_PARTS, part=read("part")), "application": with_tables(_STAR_APPS, orders=read("orders")),
        "bom": line.select(unit_of(F.col("l_orderkey") % 200), F.concat(F.lit("P"), "l_partkey").alias("part_number")),
        "xref": line.select(unit_of(F.col("l_suppkey")), other.alias("other"), (F.col("l_linenumber") % 6).alias("type_id")),
    }
    lookups = {"unit_type": nation, "part_type": nation, "make": nation, "maker": region, "model": region, "relation": region}
    store, asked, report = Store(spark, own_folder(spark, "star")), itertools.count().__next__, []
    for attempt, steps in ((1, 3), (2, 99)):
        makes = {k: (lambda df=df: (df, {})) for k, df in L.import_star(tables, lookups).items()}
        told = run_tables(store, "star", makes, lambda: asked() < steps)  # noqa: B023  used at once
        report += [(name, state, str(attempt)) for name, (state, _) in told.items()]
    return stacked(**store.tables(), report=spark.createDataFrame(report, "number string, label string, other string"))
