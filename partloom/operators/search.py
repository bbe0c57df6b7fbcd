"""Filters, ranks and pages of list views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.functions.text import any_of, contains_text, nullif_blank
from partloom.operators.lineage import cut_lineage


#: Pages that begin before this row are taken from the first rows of the order, later ones by places.
EARLY = 10_000


def where_equal(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality on each parameter that is not blank."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def search(df: DataFrame, q: str, columns: list[str]) -> DataFrame:
    """Rows with q in any of the columns, literally and ignoring case; all rows for a blank q."""
    q = q.strip()
    return df.where(any_of([F.coalesce(contains_text(F.col(c), q), F.lit(False)) for c in columns])) if q else df


def between_dates(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    if first:
        df = df.where(F.col(column) >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col(column) <= F.lit(last).cast("date"))
    return df


def by_ids(df: DataFrame, raw: str, key: str = "id") -> DataFrame:
    """Rows of a list of ids, in its order, with their place as `pos`; what is no number is skipped."""
    ids = [int(x) for x in raw.split(",") if x.strip().isdecimal()]
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, p) for p, i in enumerate(dict.fromkeys(ids))], f"{key} long, pos int")
    return df.join(wanted, key).orderBy("pos")


def blanks_last(*names: str) -> list[Column]:
    """Ascending order in which blanks count as null and nulls come last."""
    return [nullif_blank(F.col(n)).asc_nulls_last() for n in names]


def tier(direct: Column) -> Column:
    return F.when(F.coalesce(direct, F.lit(False)), 0).otherwise(1)


def placed(df: DataFrame, order: list[Column], part: str | None = None) -> DataFrame:
    """df with `place`, its position from 0 in an order without ties, by a distributed sort; with `part`, also the number of its range by that name.

    Rows are sorted into ranges and numbered within each; the sizes of the ranges before are added. Only one
    count for each range is gathered.
    """
    rows = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    within = F.lit((1 << 33) - 1)
    keyed = rows.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(within))
    sizes = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    found = keyed.join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.col("_at")).drop("_id", "_at", "_start")
    return found.withColumnRenamed("_range", part) if part else found.drop("_range")


class PageIndex:
    """An order of a table, stored in ranges with their bounds and counts, of which a page reads those that it lies in.

    Rows are sorted once and written with their places, a folder for each range. What the driver holds is a row for each range.
    """

    def __init__(self, df: DataFrame, order: list[Column], folder: str) -> None:
        self.spark, self.folder = df.sparkSession, folder
        rows = placed(df, order, "_part").withColumn("_part", F.col("_part").cast("long"))
        rows.write.partitionBy("_part").parquet(f"{folder}/rows")
        self.schema = rows.schema
        bounds = self._stored().groupBy("_part").agg(F.min("place").alias("first"), F.max("place").alias("last")).collect()
        self.bounds = sorted((r["first"], r["last"], r["_part"]) for r in bounds)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def page(self, number: int, per_page: int) -> DataFrame:
        """As page() gives it, in the order, with each row's place."""
        per_page = min(per_page, 500) if per_page > 0 else 50
        total = self.bounds[-1][1] + 1 if self.bounds else 0
        first = (min(max(1, number), max(1, -(-total // per_page))) - 1) * per_page
        last = first + per_page - 1
        parts = [p for a, b, p in self.bounds if a <= last and b >= first]
        rows = self._stored().where(F.col("_part").isin(*parts) if parts else F.lit(False))
        return rows.where((F.col("place") >= first) & (F.col("place") <= last)).orderBy("place").drop("_part")


def page(df: DataFrame, number: int, per_page: int, order: list[Column]) -> DataFrame:
    """One page of an order without ties, in that order: the last page for numbers past it, the first for lower than 1."""
    per_page = min(per_page, 500) if per_page > 0 else 50
    last = max(1, -(-df.count() // per_page))
    first = (min(max(1, number), last) - 1) * per_page
    if first < EARLY:  # the first rows of a sort, which each task cuts to as many
        return df.orderBy(*order).limit(first + per_page).offset(first)
    return placed(df, order).where((F.col("place") >= first) & (F.col("place") < first + per_page)).orderBy("place").drop("place")


def tiered(base: DataFrame, direct: Column, deep: Column, q: str, least: int = 3, probe: Column | None = None) -> DataFrame:
    """Direct hits; deep hits only if nothing is hit by the probe (else directly) and q has `least` characters. With the column `tier`.

    Whether anything is hit directly is a scalar subquery of the plan, so that the choice needs no action at the driver.
    """
    hit = F.coalesce(direct, F.lit(False))
    ranked = base.withColumn("tier", tier(hit))
    if len(q.strip()) < least:
        return ranked.where(hit)
    probed = hit if probe is None else F.coalesce(probe, F.lit(False))
    return ranked.where(hit | (F.coalesce(deep, F.lit(False)) & ~base.where(probed).exists()))


def accumulated(stages: list[DataFrame], ends: list[str], order: str, limit: int, last_share: int = 3) -> DataFrame:
    """(id, stage, rank): the ids at the `ends` of rows, read stage by stage in `order` until there are `limit` of them.

    The row at which the limit is reached counts whole, so that one id more than the limit may come of it. Of the last stage no more rows are
    read than last_share times the room that the ones before left. A stage is a frame of `order` (a number without ties) and the ends; earlier stages
    are read first. What is sorted is bounded by the limit: the first ids of each stage, each with the row where it comes first.
    """
    def told(df: DataFrame, n: int) -> DataFrame:
        each = [F.struct(F.col(e).cast("long").alias("id"), F.lit(k).alias("end")) for k, e in enumerate(ends)]
        return df.select(F.lit(n).alias("stage"), F.col(order).alias("row"), F.explode(F.array(*each)).alias("e")).select("stage", "row", "e.id", "e.end").where("id IS NOT NULL")

    def firsts(df: DataFrame) -> DataFrame:
        """The ids that come first, each with its first place; a row's second id may be one too many."""
        seen = df.groupBy("id").agg(F.min(F.struct("stage", "row", "end")).alias("at"))
        return seen.orderBy("at").limit(limit + len(ends) - 1)

    early, late = stages[:-1], stages[-1]
    before = told(early[0], 0)
    for n, df in enumerate(early[1:], 1):
        before = before.unionByName(told(df, n))
    head = firsts(before)
    room = head.agg(F.greatest(F.lit(0), F.lit(limit) - F.count(F.lit(1))).alias("room")).scalar()
    rows = late.orderBy(order).limit(last_share * limit)
    numbered = rows.withColumn("_nth", F.row_number().over(Window.orderBy(order)))  # no more rows than the limit allows
    tail = told(numbered.where(F.col("_nth") <= last_share * room), len(early))
    known = head.select("id", "at.stage", "at.row", "at.end").unionByName(tail.select("id", "stage", "row", "end"))
    ranked = firsts(known).withColumn("rank", F.row_number().over(Window.orderBy("at")))
    edge = ranked.where(F.col("rank") == limit).agg(F.max("at")).scalar()
    inside = (F.col("rank") <= limit) | ((F.col("at.stage") == edge["stage"]) & (F.col("at.row") == edge["row"]))
    return ranked.where(F.coalesce(inside, F.lit(False))).select("id", F.col("at.stage").alias("stage"), "rank")


def dropdown(df: DataFrame, column: str, q: str = "") -> DataFrame:
    """Distinct non-blank values in order, of active rows, with q in them."""
    values = df.where("is_active").where(F.col(column).isNotNull() & (F.col(column) != ""))
    if q:
        values = values.where(contains_text(F.col(column), q))
    return values.select(column).distinct().orderBy(column)


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")
