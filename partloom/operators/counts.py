"""Totals and dropdown values as a stored aggregate that changes are merged into, so that a list view reads neither the table nor its index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from partloom.operators.publish import Store

#: The name under which all rows are counted.
TOTAL = "*"
TABLE = "counts"


class ValueCounts:
    """(name, value, n): how many rows have a value in a column, and all rows under TOTAL. Blanks and nulls count in the total only."""

    def __init__(self, store: Store, columns: list[str]) -> None:
        self.store, self.columns = store, columns

    def _counted(self, rows: DataFrame, sign: int) -> DataFrame:
        each = [F.struct(F.lit(TOTAL).alias("name"), F.lit("").alias("value"))]
        each += [F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))) for c in self.columns]
        exploded = rows.select(F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*")
        return exploded.groupBy("name", "value").agg((sign * F.count(F.lit(1))).alias("n"))

    def build(self, rows: DataFrame, run: str = "build") -> None:
        """Counts a table whole, once."""
        self.store.keep(run, TABLE, self._counted(rows, 1), {})
        self.store.publish(run)

    def merge(self, run: str, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Adds the rows of a change and takes others away; an update is both. A run that is in the store already changes nothing. The table is not read."""
        if TABLE in self.store.progress(run):
            return
        parts = [self.current()] + [self._counted(df, sign) for df, sign in ((inserted, 1), (deleted, -1)) if df is not None]
        merged = reduce(DataFrame.unionByName, parts).groupBy("name", "value").agg(F.sum("n").alias("n")).where("n <> 0")
        self.store.keep(run, TABLE, merged, {})
        self.store.publish(run)

    def current(self) -> DataFrame:
        return self.store.tables()[TABLE]

    def total(self) -> DataFrame:
        return self.current().where(F.col("name") == TOTAL).select("n")

    def dropdown(self, column: str) -> DataFrame:
        """The values of a column in order."""
        return self.current().where((F.col("name") == column) & (F.col("n") > 0)).select(F.col("value").alias(column)).orderBy(column)
