"""The catalog's tables as views of the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "parts": """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '' ELSE 'PN-' || cast(p_partkey AS string) END AS part_number,
  p_name AS part_name, 'MF' || cast(p_partkey % 500 AS string) AS manufacturer_number,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'YT' || cast(p_partkey % 300 AS string) END AS yt_number,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'JN' || cast(p_partkey % 90 AS string) END AS j_and_n,
  CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 9 = 0 THEN upper(p_brand) || '.' ELSE p_brand END AS oem,
  p_type AS category, CASE WHEN p_partkey % 3 = 0 THEN '12V' WHEN p_partkey % 3 = 1 THEN '24V' ELSE '' END AS voltage,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN cast(0 AS decimal(10,2)) ELSE cast(p_retailprice AS decimal(10,2)) END AS cost_price,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE cast(cast(p_retailprice AS decimal(10,2)) * cast(1.3 AS decimal(2,1)) AS decimal(10,2)) END AS price,
  cast(p_partkey % 12 AS int) AS stock_quantity, p_size % 10 AS reorder_qty, p_partkey % 10 <> 3 AS is_active,
  CASE WHEN p_partkey % 2 = 0 THEN 'note on ' || p_type ELSE '' END AS notes, cast(p_partkey % 100 AS int) AS vendor_id
FROM part""",
    "units": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'U' || cast(c_custkey AS string) END AS unit_number,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'YT' || cast(c_custkey % 300 AS string) END AS yt_number,
  CASE c_nationkey % 6 WHEN 0 THEN 'MAHLE' WHEN 1 THEN 'Hitachi' WHEN 2 THEN 'Romaine Electric' WHEN 3 THEN 'J&N' WHEN 4 THEN 'Leece Neville' ELSE 'Unknown' END AS manufacturer,
  CASE c_custkey % 4 WHEN 0 THEN 'DD' WHEN 1 THEN 'PMGR' WHEN 2 THEN 'TILT&TRIM' ELSE '' END AS family,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS unit_type, cast(c_nationkey AS bigint) AS unit_type_id,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE cast(abs(c_acctbal) AS decimal(10,2)) END AS new_unit_price,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN cast(0 AS decimal(10,2)) ELSE cast(cast(abs(c_acctbal) AS decimal(10,2)) - cast(0.5 AS decimal(10,2)) AS decimal(10,2)) END AS rebuilt_unit_price,
  c_custkey % 9 <> 1 AS is_active
FROM customer""",
    "applications": """
SELECT p_partkey AS id, p_name AS name, p_brand AS make, 'Model ' || cast(p_size % 12 AS string) AS model,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE cast(1 + p_partkey % 4 AS string) || '.0L' END AS engine,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN cast(1960 + p_partkey % 60 AS string)
    WHEN 2 THEN lpad(cast(p_partkey % 100 AS string), 2, '0') || '-' || lpad(cast((p_partkey * 7) % 100 AS string), 2, '0')
    WHEN 3 THEN cast(1990 + p_partkey % 20 AS string) || '-' || cast(1985 + p_partkey % 23 AS string)
    ELSE lpad(cast(p_partkey % 97 AS string), 2, '0') || '-' || lpad(cast(p_partkey % 89 AS string), 2, '0') || ' | ' || cast(2000 + p_partkey % 9 AS string) END AS year,
  p_partkey % 10 <> 3 AS is_active, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'U' || cast(1 + p_partkey % 150 AS string) END AS unit_number
FROM part""",
    "application_units": """
SELECT min((l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000) AS id, l_partkey AS application_id, l_suppkey AS unit_id,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'P' || cast(l_suppkey % 4 AS string) END AS position
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "cross_references": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, l_suppkey AS unit_id,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 1 + l_partkey % 150 END AS cross_ref_unit_id,
  CASE WHEN l_linenumber = 3 THEN 'X' || cast(l_partkey AS string) || '-' WHEN l_linenumber = 4 THEN '400-' || cast(l_partkey AS string) || ' (12V'
    WHEN l_linenumber = 5 THEN cast(l_partkey AS string) || ' (Aftermarket) Pg. ' || cast(l_suppkey AS string) ELSE 'X' || cast(l_partkey AS string) END AS cross_ref_number,
  CASE l_linenumber % 6 WHEN 0 THEN 'FORD' WHEN 1 THEN 'ALFA ROMEO' WHEN 2 THEN 'WAI' WHEN 3 THEN 'Alfa-romeo.' WHEN 4 THEN '10346 Ford' ELSE 'BOSCH-' END AS interchange_type,
  CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag || l_linestatus END AS notes
FROM lineitem""",
    "substitutes": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, l_suppkey AS unit_id,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE 1 + l_partkey % 40 END AS substitute_unit_id, 'S' || cast(l_partkey % 60 AS string) AS substitute_number
FROM lineitem WHERE l_linenumber IN (1, 2, 7)""",
    "boms": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS unit_id,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'BOM ' || cast(o_orderkey % 30 AS string) END AS name
FROM orders""",
    "bom_items": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, l_orderkey AS bom_id, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_partkey END AS part_id,
  CASE WHEN l_linenumber = 2 THEN '' ELSE l_linestatus || ' item ' || cast(l_partkey % 50 AS string) END AS description, cast(l_quantity AS int) AS unit_qty,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'YT' || cast(l_partkey % 300 AS string) END AS yt_number, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'JN' || cast(l_partkey % 90 AS string) END AS j_and_n,
  CASE WHEN l_linenumber = 1 THEN 'OE' || cast(l_partkey % 211 AS string) ELSE '' END AS oem_number, 'n' || cast(l_suppkey % 13 AS string) AS notes, 'B' || cast(l_suppkey AS string) AS bin_number
FROM lineitem""",
    "part_interchanges": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, l_partkey AS part_id, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 1 + l_suppkey % 150 END AS interchange_part_id,
  'X' || cast((l_suppkey * 7 + l_partkey) % 1000 AS string) AS interchange_number, CASE l_suppkey % 3 WHEN 0 THEN 'FORD' WHEN 1 THEN 'WAI' ELSE 'Delco 117' END AS source_name, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE l_returnflag END AS notes
FROM lineitem WHERE l_linenumber = 4""",
    "part_supersedings": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, l_partkey AS part_id, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 1 + l_suppkey % 140 END AS old_part_id,
  'Z' || cast(l_suppkey % 300 AS string) AS old_part_number, CASE WHEN l_suppkey % 50 = 7 THEN 'was 117' ELSE '' END AS notes
FROM lineitem WHERE l_linenumber = 5""",
    "part_substitutes": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, l_partkey AS part_id, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 1 + l_suppkey % 130 END AS substitute_part_id,
  'S' || cast(l_suppkey % 200 AS string) AS substitute_number, CASE WHEN l_suppkey % 60 = 9 THEN 'like 117' ELSE '' END AS notes
FROM lineitem WHERE l_linenumber = 6""",
    "part_units": """
SELECT DISTINCT l_partkey AS part_id, 1 + l_suppkey % 150 AS unit_id FROM lineitem WHERE l_linenumber = 3""",
    "part_owners": """
SELECT p_partkey AS part_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1 + p_partkey % 140 END AS unit_id FROM part""",
    "stock_units": """
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'YT' || cast(c_custkey % 400 AS string) WHEN 1 THEN 'X' || cast(c_custkey AS string) ELSE 'U' || cast(c_custkey AS string) END AS unit_number,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'YT' || cast(c_custkey % 97 AS string) ELSE 'YT' || cast(c_custkey % 200 AS string) END AS yt_number,
  CASE WHEN c_custkey % 4 < 2 THEN '' ELSE 'Hitachi' END AS manufacturer, CASE WHEN c_custkey % 4 < 2 THEN '' ELSE 'OEM' END AS oem, CASE WHEN c_custkey % 4 = 2 THEN '12V' ELSE '' END AS voltage,
  CASE WHEN c_custkey % 4 = 3 THEN '90' ELSE '' END AS amp_rating, CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE c_nationkey END AS unit_type_id, CASE WHEN c_custkey % 4 < 2 THEN '' ELSE c_mktsegment END AS unit_type_category
FROM customer""",
    "staging_products": """
SELECT p_partkey AS pos, 'YT' || cast(p_partkey AS string) AS yt_number, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' Maker  ' || cast(p_partkey % 5 AS string) END AS manufacturer,
  CASE p_partkey % 4 WHEN 0 THEN 'TILT' WHEN 1 THEN 'TRIM' ELSE '' END AS family, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'fits ' || p_type END AS notes FROM part""",
    "line_units": """
SELECT c_custkey AS id, 'YT' || cast(c_custkey - c_custkey % 3 AS string) AS yt_number, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Old' END AS manufacturer, CASE WHEN c_custkey % 5 = 0 THEN 'DD' ELSE '' END AS family,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'seen' ELSE 'fits STANDARD' END AS notes FROM customer WHERE c_custkey % 5 <> 4""",
    "staging_substitutes": """
SELECT s_suppkey AS pos, 'YT' || cast(s_suppkey AS string) AS yt_number, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'YT' || cast(s_suppkey * 7 % 300 AS string) END AS substitute_yt FROM supplier""",
    "staging_bom": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos, 'YT' || cast(l_orderkey % 300 AS string) AS yt_number, 'Part ' || cast(l_partkey % 50 AS string) AS part_name,
  CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE 'YT' || cast(l_partkey % 400 AS string) END AS yt_part, 'JN' || cast(l_partkey % 90 AS string) AS jn_part FROM lineitem WHERE l_linenumber <= 2""",
    "staging_master": """
SELECT p_partkey AS pos, ' J' || cast(p_partkey - p_partkey % 3 AS string) AS number, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS part_name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS category,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'C' || cast(p_size AS string) END AS code, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'about ' || p_brand END AS description, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS maker FROM part""",
    "master_parts": """
SELECT p_partkey AS id, 'J' || cast(p_partkey AS string) AS number, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'kept name' END AS part_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'kept' END AS category, '' AS maker FROM part WHERE p_partkey % 5 < 2""",
    "staging_refs": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos, 'J' || cast(l_partkey AS string) AS number, CASE WHEN l_suppkey % 11 = 0 THEN '' WHEN l_linenumber = 2 THEN 'MF' || cast(l_partkey % 600 AS string) ELSE 'J' || cast(l_partkey - 3 + l_suppkey % 7 AS string) END AS ref_number,
  CASE l_linenumber WHEN 1 THEN 'Substitute' WHEN 2 THEN 'interchange' WHEN 3 THEN 'superseded_from' WHEN 4 THEN 'superseded_by' WHEN 5 THEN '' ELSE 'Original_Number' END AS ref_type,
  CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'Maker ' || cast(l_suppkey % 4 AS string) END AS maker, l_returnflag AS notes FROM lineitem""",
    "loose_units": """
SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 'W' || cast(c_custkey AS string) || ',' ELSE 'U' || cast(c_custkey - 4 AS string) || ',,' END WHEN 1 THEN 'U' || cast(c_custkey AS string)
    WHEN 2 THEN 'X' || cast(c_custkey AS string) WHEN 3 THEN '45' || lpad(cast(c_custkey % 10000 AS string), 4, '0') ELSE CASE WHEN c_custkey % 20 = 4 THEN 'Test' ELSE 'V' || cast(c_custkey AS string) END END AS unit_number,
  CASE WHEN c_custkey % 5 = 1 THEN 'YT' || cast(c_custkey % 300 AS string) WHEN c_custkey % 30 = 9 THEN '450123' ELSE '' END AS yt_number, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Romaine Electric' ELSE 'Hitachi' END AS manufacturer,
  CASE WHEN c_custkey % 5 = 3 THEN 'TILT&TRIM' WHEN c_custkey % 7 = 0 THEN 'DD' ELSE '' END AS family, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE '' END AS unit_type, CASE WHEN c_custkey % 8 = 1 THEN 'Old' ELSE '' END AS category
FROM customer""",
    "seed_vendors": """
SELECT s_suppkey AS id, s_suppkey AS seed_id, s_name AS name, 'nation ' || cast(s_nationkey AS string) AS notes FROM supplier WHERE s_suppkey % 4 <> 1""",
    "target_vendors": """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS seed_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'kept' END AS notes FROM supplier WHERE s_suppkey % 4 <> 2""",
    "invoices": """
SELECT o_orderkey AS id, 'INV-' || lpad(cast(o_orderkey % 10000 AS string), 4, '0') AS invoice_number,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS customer_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Stored ' || cast(o_custkey % 50 AS string) ELSE '' END AS customer_name,
  cast(o_orderdate AS date) AS date, CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'SENT' ELSE 'DRAFT' END AS status,
  cast(o_totalprice AS decimal(12,2)) AS total
FROM orders""",
    "invoice_items": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS id, l_orderkey AS invoice_id, l_partkey AS part_id, l_linenumber AS line_number, cast(l_quantity AS int) AS quantity,
  cast(l_extendedprice AS decimal(10,2)) AS unit_price, cast(l_discount * 100 AS decimal(5,2)) AS discount_pct
FROM lineitem""",
    "bill_to": """
SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'NET_10' WHEN 2 THEN 'NET_30' WHEN 3 THEN 'DUE_ON_RECEIPT' WHEN 4 THEN 'CUSTOM' ELSE 'OTHER' END AS net_terms,
  cast(c_custkey % 50 - 5 AS int) AS net_days, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast(c_custkey % 900 / 100.0 AS decimal(5,2)) END AS tax_rate, c_custkey % 7 = 0 AS is_tax_exempt,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE cast(c_custkey AS string) || ' Main St' END AS line1, '' AS line2, c_mktsegment AS city, 'S' || cast(c_nationkey AS string) AS state, lpad(cast(c_custkey AS string), 5, '0') AS zip
FROM customer""",
    "vendors": "SELECT s_suppkey AS id, s_name AS name, s_suppkey % 6 <> 0 AS is_active FROM supplier",
    "contacts": """
SELECT c_custkey AS id, 1 + c_custkey % 100 AS vendor_id, c_name AS name, c_custkey % 5 = 0 AS is_primary, cast(c_custkey % 3 AS int) AS ordering FROM customer""",
    "staging_applications": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos, 'M' || cast(cast(floor(l_orderkey / 8) AS int) % 7 AS int) AS make, 'D' || cast(l_orderkey % 3 AS int) AS model, '' AS engine,
  CASE WHEN l_linenumber IN (2, 3, 5) THEN '' ELSE lpad(cast(l_partkey % 100 AS string), 2, '0') || '-' || lpad(cast(l_suppkey % 100 AS string), 2, '0') END AS year,
  CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END AS mfr,
  CASE l_linenumber % 4 WHEN 0 THEN 'Automatic; AC' WHEN 1 THEN 'AC; Manual; 4WD' WHEN 2 THEN '' ELSE 'Turbo' END AS options,
  'U' || cast(1 + l_suppkey % 150 AS string) AS part_number
FROM lineitem""",
    "staging_interchange": """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos, CASE l_linenumber % 5 WHEN 0 THEN 'BOSCH' WHEN 1 THEN ' Delco  Remy ' WHEN 2 THEN '' WHEN 3 THEN 'FORD' ELSE 'Lucas' END AS manufacturer,
  'T' || cast(l_partkey AS string) AS their_number,
  CASE l_suppkey % 4 WHEN 0 THEN 'U' || cast(l_partkey % 150 AS string) WHEN 1 THEN 'YT' || cast(l_partkey % 400 AS string) WHEN 2 THEN 'Q' || cast(l_partkey AS string) ELSE '' END AS our_number
FROM lineitem""",
    "guide_texts": """
SELECT o_orderkey AS id, 'YT' || cast(o_custkey AS string) || chr(10) || CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'APPLICATION' || chr(10) END ||
  CASE o_orderkey % 5 WHEN 0 THEN 'gamma' WHEN 1 THEN 'Volvo' || chr(10) || 'Stern Drive' WHEN 2 THEN 'ford' || chr(10) || '(Europe)' WHEN 3 THEN 'OMC Engine' || chr(10) || '- Inboard &' || chr(10) || 'V-Drive' ELSE 'case' END || chr(10) ||
  CASE WHEN o_orderkey % 13 = 0 THEN 'Fan Type' || chr(10) || 'Internal' || chr(10) ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN 'Bosch: 12 | Delco: 45' || chr(10) ELSE '' END ||
  'Model ' || cast(o_custkey % 90 AS string) || CASE o_custkey % 6 WHEN 0 THEN ' 2.0L' WHEN 1 THEN ' Diesel' WHEN 2 THEN ', V8 5.7L' WHEN 3 THEN ' V8 350 5.7L Turbo' ELSE '' END || ' ' || cast(1960 + o_orderkey % 50 AS string) ||
  CASE o_orderkey % 7 WHEN 0 THEN '-' || chr(10) WHEN 1 THEN ' ' || chr(10) || ' -' WHEN 2 THEN '' ELSE '-' END || cast(1980 + o_custkey % 40 AS string) || CASE WHEN o_orderkey % 7 = 2 THEN ' only' ELSE '' END ||
  CASE o_custkey % 4 WHEN 0 THEN '; Fiesta 1.4L 1999-' || cast(2000 + o_orderkey % 20 AS string) || ';; Tamd' WHEN 1 THEN ', 1991-1992 or later' ELSE '' END || chr(10) ||
  CASE WHEN o_orderkey % 2 = 0 THEN 'opel' || chr(10) || 'Corsa 7277CC 1.2L 2000-' || cast(2001 + o_orderkey % 9 AS string) || '; Astra' || chr(10) ELSE '' END ||
  CASE WHEN o_orderkey % 17 = 0 THEN 'YouTech : ' || cast(100000 + o_custkey AS string) || chr(10) ELSE '' END ||
  CASE WHEN o_orderkey % 3 = 0 THEN 'INTERCHANGE' || chr(10) || 'Bosch: B' || cast(o_custkey AS string) || ', 12-' || cast(100 + o_orderkey % 900 AS string) || '-X | 400-' || chr(10) || lpad(cast(o_custkey % 100000 AS string), 5, '0') || ' | Lucas: IN' || cast(o_orderkey AS string) || chr(10) ELSE '' END ||
  CASE WHEN o_orderkey % 8 = 0 THEN 'POSSIBLE SUBSTITUTIONS' || chr(10) || 'YouTech : 123456 or 130-05AB*' ELSE '' END AS text
FROM orders""",
    "seed_parts": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey END AS seed_id, 'PN-' || cast(p_partkey AS string) AS part_number, p_name AS part_name,
  'seed ' || p_type AS notes, cast(p_retailprice AS decimal(10,2)) AS price, p_brand AS oem
FROM part WHERE p_partkey % 3 <> 1""",
    "target_parts": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey END AS seed_id, 'PN-' || cast(p_partkey + CASE WHEN p_partkey % 50 = 2 THEN 1 ELSE 0 END AS string) AS part_number,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Original ' || p_name END AS part_name, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'kept' END AS notes,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE cast(99.99 AS decimal(10,2)) END AS price, '' AS oem
FROM part WHERE p_partkey % 3 <> 2 OR p_partkey % 50 = 2""",
}


def _used(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the catalog as a DataFrame; only the columns that a query takes are read."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)


def oracle(sql: str) -> str:
    """sql with the views that it names in front, for DuckDB."""
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in _used(sql))
    body = sql.strip()
    if not views:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {body[15:]}"
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"
