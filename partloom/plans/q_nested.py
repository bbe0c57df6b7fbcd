"""Arrays, maps and JSON (group J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.operators import nested as N
from partloom.plans.domain import frame
from partloom.plans.registry import query, table


@query("J01", "SELECT DISTINCT id, trim(unnest(string_split(year, '|'))) AS year FROM applications")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    return N.split_rows(frame(spark, sf, "applications").select("id", "year"), "year")


@query("J02", "SELECT id, CASE WHEN id % 3 = 0 THEN '3.0GSM-' || unnest(['A', 'B', 'C']) ELSE unnest([model]) END AS model FROM (SELECT id, model FROM applications WHERE id % 3 = 0) UNION ALL SELECT id, model FROM applications WHERE id % 3 <> 0")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    return N.submodels(frame(spark, sf, "applications").select("id", F.when(F.col("id") % 3 == 0, "3.0GSM-A,B,C").otherwise(F.col("model")).alias("model")), "model")


@query("J03", "SELECT id, 'JN' || cast(id % 7 AS string) AS first, 'K' || cast(id AS string) AS other FROM parts WHERE id % 2 = 0 AND id > 0")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    """The first number stays, the others become relations unless the part has them already."""
    several = F.concat(F.lit("JN"), F.col("id") % 7, F.lit(", K"), "id", F.lit(", K0"))
    numbers = F.when(F.col("id") % 2 == 0, several).otherwise(F.concat(F.lit("JN"), F.col("id") % 7))
    have = frame(spark, sf, "parts").select("id", F.lit("K0").alias("other"))
    return N.further_numbers(frame(spark, sf, "parts").select("id", numbers.alias("n")), "n", have)


@query("J04", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS type, 'new' AS origin FROM events")
def j04(spark: SparkSession, sf: str) -> DataFrame:
    old = F.map_concat(N.parse_map(F.col("props")), F.create_map(F.lit("origin"), F.lit("old")))
    new = F.create_map(F.lit("type"), F.col("event_type"), F.lit("origin"), F.lit("new"))
    m = N.merge_maps(old, new)
    return table(spark, sf, "events").select("event_id", m["k"].alias("k"), m["type"].alias("type"), m["origin"].alias("origin"))


@query("J05", "SELECT event_id, 'Key' AS label, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'plain', event_type FROM events")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    definitions = spark.createDataFrame([("k", "Key"), ("unused", "Unused")], "field_name string, label string")
    specs = F.map_concat(N.parse_map(F.col("props")), F.create_map(F.lit("plain"), F.col("event_type"), F.lit("empty"), F.lit("")))
    return N.labelled(table(spark, sf, "events").withColumn("specs", specs), "event_id", "specs", definitions)


@query("J06", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", N.parse_map(raw)["k"].alias("k"))


_REFS = "SELECT id AS part, CASE id % 5 WHEN 0 THEN 'substitute' WHEN 1 THEN 'interchange' WHEN 2 THEN 'superseded_from' WHEN 3 THEN 'superseded_by' ELSE 'reference' END AS ref_type, id + 7 AS ref FROM parts"


@query("J07", f"SELECT CASE WHEN starts_with(ref_type, 'superseded') THEN 'superseding' ELSE ref_type END AS kind, CASE ref_type WHEN 'superseded_by' THEN ref ELSE part END AS a, CASE ref_type WHEN 'superseded_by' THEN part ELSE ref END AS b FROM ({_REFS}) WHERE ref_type <> 'reference'")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("substitute", "interchange", "superseded_from", "superseded_by", "reference")]), (F.col("id") % 5 + 1).cast("int"))
    return N.directed(frame(spark, sf, "parts").select(F.col("id").alias("part"), kinds.alias("ref_type"), (F.col("id") + 7).alias("ref")))


@query("J08", "SELECT make, string_agg(model || ':' || cast(n AS string), ',' ORDER BY model) AS fields FROM (SELECT make, model, count(*) AS n FROM applications GROUP BY 1, 2) GROUP BY make")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    fields = frame(spark, sf, "applications").groupBy("make", "model").agg(F.count(F.lit(1)).alias("n"))
    lists = fields.groupBy("make").agg(F.array_sort(F.collect_list(F.struct("model", "n"))).alias("f"))
    return lists.select("make", F.array_join(F.transform("f", lambda x: F.concat(x["model"], F.lit(":"), x["n"])), ",").alias("fields"))


@query("J09", "SELECT 'size_' || cast(k AS string) AS field_name, CASE WHEN k % 2 = 0 THEN 'Stored ' || cast(k AS string) ELSE 'Size ' || cast(k AS string) END AS label, CASE WHEN k <= 20 THEN k ELSE 1000 + k END AS place FROM (SELECT DISTINCT p_size AS k FROM part) WHERE k <= 20 OR k % 2 = 0")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").select(F.col("p_size").alias("k")).distinct()
    name = F.concat(F.lit("size_"), F.col("k")).alias("field_name")
    defaults = sizes.where("k <= 20").select(name, F.concat(F.lit("Size "), F.col("k")).alias("label"), F.col("k").alias("pos"))
    custom = sizes.where("k % 2 = 0").select(name, F.concat(F.lit("Stored "), F.col("k")).alias("label"), F.col("k").alias("ordering"))
    return N.merge_fields(defaults, custom)
