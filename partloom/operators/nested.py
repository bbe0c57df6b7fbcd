"""Delimited lists to rows, maps of attributes, references by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partloom.functions.text import strip


def split_rows(df: DataFrame, column: str, sep: str = r"\|") -> DataFrame:
    """A row for each distinct non-blank item of a delimited column; a column without items stays one row."""
    items = F.array_distinct(F.filter(F.transform(F.split(column, sep), strip), lambda x: x != ""))
    return df.withColumn(column, F.explode(F.when(F.size(items) > 0, items).otherwise(F.array(F.col(column)))))


def submodels(df: DataFrame, column: str) -> DataFrame:
    """`3.0GSM-A,B,C` becomes a row for each letter."""
    shape = r"^(.*-)([A-Z](?:,[A-Z])+)$"
    head, tail = F.regexp_extract(column, shape, 1), F.split(F.regexp_extract(column, shape, 2), ",")
    many = F.transform(tail, lambda x: F.concat(head, x))
    return df.withColumn(column, F.explode(F.when(F.col(column).rlike(shape), many).otherwise(F.array(F.col(column)))))


def further_numbers(df: DataFrame, column: str, have: DataFrame) -> DataFrame:
    """(id, first, other) of each number after the first of a comma list, unless have (id, other) has it; a single number has none."""
    rows = df.select("id", F.split(column, r",\s*").alias("_n")).select("id", F.col("_n")[0].alias("first"), F.explode(F.expr("slice(_n, 2, size(_n))")).alias("other"))
    return rows.join(have, ["id", "other"], "left_anti").select("id", "first", "other")


def merge_maps(old: Column, new: Column) -> Column:
    """All keys; the new value where both have one."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))


def labelled(df: DataFrame, id_: str, specs: str, definitions: DataFrame) -> DataFrame:
    """(id, label, value) of the non-blank attributes; a key without a definition (field_name, label) is its own label."""
    rows = df.select(id_, F.explode(specs).alias("field_name", "value")).where("value <> ''")
    return rows.join(definitions.select("field_name", "label"), "field_name", "left").select(id_, F.coalesce("label", "field_name").alias("label"), "value")


def parse_map(c: Column) -> Column:
    """A JSON object as a map of text, empty if it cannot be read."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def directed(refs: DataFrame) -> DataFrame:
    """(kind, a, b) of references (part, ref_type, ref): superseded_by points the other way, from ref to part."""
    back = F.col("ref_type") == "superseded_by"
    kind = F.when(F.col("ref_type").startswith("superseded"), "superseding").otherwise(F.col("ref_type"))
    return refs.where(F.col("ref_type").isin("substitute", "interchange", "superseded_from", "superseded_by")).select(
        kind.alias("kind"), F.when(back, F.col("ref")).otherwise(F.col("part")).alias("a"), F.when(back, F.col("part")).otherwise(F.col("ref")).alias("b")
    )


def merge_fields(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """(field_name, label, place): defaults (field_name, label, pos) first, with the stored label where there is one; then the other custom fields."""
    d, c = defaults.select("field_name", F.col("label").alias("_d"), F.col("pos").alias("_dp")), custom.select("field_name", F.col("label").alias("_c"), F.col("ordering").alias("_cp"))
    both = d.join(c, "field_name", "full")
    return both.select("field_name", F.coalesce("_c", "_d").alias("label"), F.when(F.col("_dp").isNotNull(), F.col("_dp")).otherwise(1000 + F.col("_cp")).alias("place"))
