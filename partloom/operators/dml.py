"""Updates as projections, deletes as anti-joins, inserts as unions: each returns what the table would hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.operators.lineage import cut_lineage
from partloom.operators.relations import looked_up
from partloom.operators.search import placed


def set_where(df: DataFrame, cond: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(F.coalesce(cond, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def with_ids(df: DataFrame, known: DataFrame, order: list[Column], id_: str = "id") -> DataFrame:
    """df in which rows without an id have the next ones after the highest of known, without gaps, in an order without ties.

    Places come from a distributed sort that is written once, so that a task that runs again gives the same ids. df is read for either kind of rows.
    """
    new = placed(df.where(F.col(id_).isNull()), order)
    highest = F.coalesce(known.agg(F.max(id_)).scalar(), F.lit(0))
    return df.where(F.col(id_).isNotNull()).unionByName(new.withColumn(id_, (highest + 1 + F.col("place")).cast("long")).select(*df.columns))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], pos: str, columns: list[str]) -> DataFrame:
    """target with rows laid over it by key: the last row of a key wins. `change` tells created, updated and kept rows.

    Where target has ids, a created row gets the next one, in the order in which its key came first.
    """
    last = rows.groupBy(*key).agg(F.min(pos).alias("_pos"), *[F.max_by(c, pos).alias(f"_{c}") for c in columns]).withColumn("_new", F.lit(True))
    both = target.withColumn("_old", F.lit(True)).join(last, key, "full")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new"), "updated").otherwise("kept")
    ids = [c for c in ("id",) if c in target.columns]
    laid = both.select(*ids, "_pos", *key, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], change.alias("change"))
    if not ids:
        return laid.drop("_pos")
    return with_ids(cut_lineage(laid), target, [F.col("_pos")]).drop("_pos")


def backfilled(target: DataFrame, seed: DataFrame) -> DataFrame:
    """target in which rows without a seed_id take their id, if the seed has it as a seed_id."""
    known = seed.where("seed_id IS NOT NULL").select(F.col("seed_id").alias("id"), F.lit(True).alias("_known")).distinct()
    return target.join(known, "id", "left").withColumn("seed_id", F.coalesce("seed_id", F.when(F.col("_known"), F.col("id")))).select(*target.columns)


def insert_only(target: DataFrame, seed: DataFrame, unique: list[str]) -> DataFrame:
    """The seed rows that a sync would add: their seed_id is not null and new, and no unique value is taken, neither in the target nor by an earlier seed row."""
    new = seed.where("seed_id IS NOT NULL").join(target.select("seed_id"), "seed_id", "left_anti")
    for c in unique:
        new = new.join(target.where(F.col(c).isNotNull()).select(c), c, "left_anti")
        first = F.row_number().over(Window.partitionBy(c).orderBy("seed_id"))
        new = new.withColumn("_n", F.when(F.col(c).isNull(), 1).otherwise(first)).where("_n = 1").drop("_n")
    return new


def fill_blanks(target: DataFrame, seed: DataFrame, columns: list[str], protected: list[str]) -> DataFrame:
    """target with blank columns filled from the seed row of its seed_id; protected columns stay."""
    s = seed.where("seed_id IS NOT NULL").select("seed_id", *[F.col(c).alias(f"_{c}") for c in columns if c not in protected]).dropDuplicates(["seed_id"])
    joined = target.join(s, "seed_id", "left")
    fill = {c: F.when(blank(F.col(c)) & ~blank(F.col(f"_{c}")), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns if c not in protected}
    return joined.withColumns(fill).select(*target.columns)


def overwrite(target: DataFrame, seed: DataFrame, columns: list[str]) -> DataFrame:
    """target with each column that differs, nulls compared as values, taken from its seed row; `changed` counts them."""
    s = seed.where("seed_id IS NOT NULL").select("seed_id", F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates(["seed_id"])
    joined = target.join(s, "seed_id", "left")
    differs = {c: F.col("_has").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns}
    total = F.lit(0)
    for d in differs.values():
        total = total + d.cast("int")
    out = joined.withColumn("changed", total)
    for c, d in differs.items():
        out = out.withColumn(c, F.when(d, F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*target.columns, "changed")


def repoint(links: DataFrame, mapping: DataFrame, key: str, with_: list[str], payload: list[str], id_: str = "id") -> DataFrame:
    """links with `key` moved from losers to survivors by mapping (loser, survivor); links that collide collapse into one.

    Of a collapsed group the lowest id stays, with each payload's last non-blank value by id.
    """
    m = mapping.select(F.col("loser").alias(key), F.col("survivor").alias("_to"))
    moved = looked_up(links, m, key).withColumn(key, F.coalesce("_to", key)).drop("_to")
    last = [F.max_by(F.col(c), F.when(~blank(F.col(c)), F.col(id_))).alias(c) for c in payload]
    return moved.groupBy(key, *with_).agg(F.min(id_).alias(id_), *last)


def chase(renames: DataFrame, rounds: int = 40) -> DataFrame:
    """(name, final) of rename rows (old, new), followed to their end; names on a cycle stay as they are.

    Each round doubles the length that is followed.
    """
    step = cut_lineage(renames.where("old <> new").groupBy(F.col("old").alias("name")).agg(F.min("new").alias("at")).withColumn("hops", F.lit(1).cast("long")))
    total = step.count()
    for _ in range(rounds):
        nxt = step.select(F.col("name").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"))
        joined = cut_lineage(step.join(nxt, "at", "left").select("name", F.coalesce("_at", "at").alias("at"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_at").isNotNull().alias("_more")))
        more = joined.where(F.col("_more") & (F.col("hops") <= total)).limit(1).count()
        step = joined.drop("_more")
        if not more:
            break
    return step.select("name", F.when(F.col("hops") > total, F.col("name")).otherwise(F.col("at")).alias("final"))


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """children without those of deleted parents."""
    return children.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def set_null(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """children whose deleted parent is null."""
    gone = deleted.select(F.col("id").alias(key), F.lit(True).alias("_gone"))
    return children.join(gone, key, "left").withColumn(key, F.when(F.col("_gone"), None).otherwise(F.col(key))).drop("_gone")


def replace_children(children: DataFrame, parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """children with those of the given parents replaced by rows."""
    return children.join(parents.select(key), key, "left_anti").unionByName(rows)


def stock_after(parts: DataFrame, movements: DataFrame) -> DataFrame:
    """(id, stock): stock less all quantities of movements (part_id, delta); a null part moves nothing."""
    sums = movements.where("part_id IS NOT NULL").groupBy(F.col("part_id").alias("id")).agg(F.sum("delta").alias("moved"))
    return parts.select("id", "stock_quantity").join(sums, "id", "left").select("id", (F.col("stock_quantity") - F.coalesce("moved", F.lit(0))).cast("long").alias("stock"))


def ledger(changes: DataFrame) -> DataFrame:
    """Movements (part_id, delta) of line changes (old_part, old_qty, new_part, new_qty): what leaves the stock counts up.

    Clearing a part from a line gives nothing back, as long as the line itself stays.
    """
    cleared = F.col("old_part").isNotNull() & F.col("new_part").isNull() & F.col("new_qty").isNotNull()
    moves = F.array(
        F.struct(F.when(~cleared, F.col("old_part")).alias("part_id"), (-F.coalesce("old_qty", F.lit(0))).alias("delta")),
        F.struct(F.col("new_part").alias("part_id"), F.coalesce("new_qty", F.lit(0)).alias("delta")),
    )
    return changes.select(F.explode(moves).alias("m")).select("m.part_id", "m.delta").where("part_id IS NOT NULL")
