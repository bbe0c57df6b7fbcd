"""CSV uploads and downloads: headers by alias, blanks as '', lenient numbers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

# Header names in uploads of parts that stand for a column.
PART_ALIASES = {
    "key": "manufacturer_number",
    "part_#": "part_number", "part_no": "part_number", "part_no.": "part_number", "part_num": "part_number", "partno": "part_number",
    "partnumber": "part_number", "item_number": "part_number", "item_#": "part_number", "item_no": "part_number",
    "item_num": "part_number", "itemnumber": "part_number", "number": "part_number", "pn": "part_number", "p/n": "part_number",
    "p_n": "part_number", "sku": "part_number",
    "manufacturer_#": "manufacturer_number", "mfr_number": "manufacturer_number", "mfr_#": "manufacturer_number",
    "mfr_no": "manufacturer_number", "mfr_no.": "manufacturer_number", "manufacturer_no": "manufacturer_number",
    "manufacturer": "manufacturer_number", "manufacture": "oem",
    "oem_#": "oem_number", "oem_no": "oem_number", "yt_#": "yt_number", "yt_no": "yt_number",
    "j_&_n": "j_and_n", "j&n": "j_and_n", "j&n_number": "j_and_n", "j&n_no": "j_and_n", "j&n_#": "j_and_n", "jn": "j_and_n", "j_n": "j_and_n",
    "jn_number": "j_and_n", "unit_type": "category", "part_type": "type", "part_category": "category", "vendor": "primary_vendor",
    "desc": "notes", "name": "part_name", "unit_#": "unit_number", "unit_no": "unit_number",
}

# The same for uploads of units.
UNIT_ALIASES = {
    "unit_#": "unit_number", "unit_no": "unit_number", "unit_no.": "unit_number", "yt_#": "yt_number", "yt_no": "yt_number",
    "j&n": "j_and_n_number", "j&n_number": "j_and_n_number", "j&n_no": "j_and_n_number", "j_&_n": "j_and_n_number",
    "j_n": "j_and_n_number", "jn": "j_and_n_number", "jn_number": "j_and_n_number",
    "model_cat_#": "model_cat_number", "model_cat": "model_cat_number", "cat_number": "model_cat_number",
    "manufacture": "manufacturer", "mfr": "manufacturer", "desc": "description", "kw": "kw_hp", "hp": "kw_hp",
    "amp": "amp_rating", "amps": "amp_rating", "teeth": "tooth_quantity", "tooth_count": "tooth_quantity", "tooth_qty": "tooth_quantity",
}


def header(name: str, aliases: dict[str, str]) -> str:
    """A header stripped of its mark and white space, in lower case, with _ for spaces, and by its alias."""
    plain = re.sub(r"\s+", "_", name.lstrip("﻿").strip().lower())
    return aliases.get(plain, plain)


def read_upload(spark: SparkSession, path: str, aliases: dict[str, str]) -> DataFrame:
    """A CSV file with all columns as trimmed text, blanks as ''. Of columns with one name the first counts."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return normalized(raw, aliases)


def normalized(raw: DataFrame, aliases: dict[str, str]) -> DataFrame:
    cols: dict[str, str] = {}
    for c in raw.columns:
        cols.setdefault(header(c, aliases), c)
    return raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(n) for n, c in cols.items()])


def template(defaults: list[str], fields: DataFrame) -> DataFrame:
    """(pos, name): the default columns and then the fields' names (ordering, field_name), each once where it comes first."""
    spark = fields.sparkSession
    first = spark.createDataFrame([(i, d) for i, d in enumerate(defaults)], "pos int, name string")
    more = fields.select((F.col("ordering") + len(defaults)).cast("int").alias("pos"), F.col("field_name").alias("name"))
    return first.unionByName(more).groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name")


def split_fields(df: DataFrame, core: list[str], keep: list[str]) -> DataFrame:
    """Columns that the model lacks go into a map `specifications`, without blanks."""
    extra = [c for c in df.columns if c not in core and c not in keep]
    pairs = F.create_map(*[x for c in extra for x in (F.lit(c), F.col(c))]) if extra else F.create_map().cast("map<string,string>")
    return df.select(*[c for c in df.columns if c in core or c in keep], F.map_filter(pairs, lambda _, v: v != "").alias("specifications"))


def write_findings(df: DataFrame, path: str, most: int = 500) -> None:
    """Audit findings as CSV with a header, each value cut to `most` characters."""
    clipped(df, most).write.mode("overwrite").csv(path, header=True)


def clipped(df: DataFrame, most: int = 500) -> DataFrame:
    return df.select(*[F.substring(F.col(c).cast("string"), 1, most).alias(c) for c in df.columns])


def append_new(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows that an insert which skips conflicts would add: one for each new key."""
    return rows.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def inspect(tables: dict[str, DataFrame], by: str | None = None) -> DataFrame:
    """(table_name, columns, n_rows) of each table; with `by` also a sample, the first row in that order as text of at most 200 characters."""
    out = None
    for name, df in tables.items():
        n = F.count(F.lit(1)).alias("n_rows")
        shown = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
        short = F.when(F.length(shown) > 200, F.concat(F.substring(shown, 1, 200), F.lit("..."))).otherwise(shown)
        figures = [n, F.coalesce(F.min_by(short, by), F.lit("(no rows)")).alias("sample")] if by else [n]
        row = df.agg(*figures).select(F.lit(name).alias("table_name"), F.lit(",".join(df.columns)).alias("columns"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns
