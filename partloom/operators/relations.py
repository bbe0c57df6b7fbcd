"""Relation lookups: semi- and anti-joins, prioritised resolution, edges read from both ends."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from partloom.operators.lineage import cut_lineage


def both_ends(edges: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """(node, other, ...): each edge seen from either end; edges without a far end only from the near one."""
    near = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *keep)
    far = edges.where(F.col(b).isNotNull()).select(F.col(b).alias("node"), F.col(a).alias("other"), *keep)
    return near.unionByName(far)


def resolve(rows: DataFrame, key: Column, targets: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """rows with route and target_id of the first target that has the key: (route, table, key column, id column).

    A key that several of a target's rows have resolves to the lowest id. Blank keys resolve to none.
    """
    out = rows.withColumn("_key", F.nullif(key, F.lit("")))
    routes, ids = [], []
    for n, (route, df, k, i) in enumerate(targets):
        one = df.where(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(F.col(k).alias("_key")).agg(F.min(i).alias(f"_id{n}"))
        out = out.join(one, "_key", "left")
        routes.append(F.when(F.col(f"_id{n}").isNotNull(), F.lit(route)))
        ids.append(F.col(f"_id{n}"))
    out = out.withColumn("route", F.coalesce(*routes, F.lit("none"))).withColumn("target_id", F.coalesce(*ids))
    return out.drop("_key", *[f"_id{n}" for n in range(len(targets))])


def unambiguous(df: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """(identifier, id) for identifiers that stand for exactly one row, whichever of the columns they are in."""
    values = df.select(id_, F.explode(F.array(*columns)).alias("identifier")).where(F.col("identifier").isNotNull() & (F.col("identifier") != ""))
    return values.groupBy("identifier").agg(F.min(id_).alias(id_), F.max(id_).alias("_last")).where(F.col(id_) == F.col("_last")).drop("_last")


def scoped(scope: list[str], value: Column) -> Column:
    """A text that begins another's exactly if the value does, in an equal scope: scopes stand before it with their lengths. Null if one of them is."""
    parts = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in scope]
    return F.concat(*parts, value)


def with_prefix_of(rows: DataFrame, others: DataFrame, scope: list[str], column: str) -> DataFrame:
    """Rows whose value is a proper prefix of another's in the same scope, by one sort of the distinct values with their scopes before them."""
    key = lambda df: df.select(scoped(scope, F.col(column)).alias("value"))
    asked = key(rows)
    found = prefixes_of(asked, asked if others is rows else key(others))
    return rows.join(found, scoped(scope, rows[column]) == found["value"], "left_semi")


def _prefix_chains(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of values in order, those that the next value of the others begins with; at the end those that are open still, and the first of the others.

    A value can only begin a later one if it begins all between them, so that what waits is a chain of values each of which begins the next.
    """
    waiting: list[str] = []
    head, part, found = None, None, []
    for x in frames:
        for value, asks, holds, part, same in zip(x["value"], x["asks"], x["holds"], x["part"], x["same"], strict=True):
            while waiting and not value.startswith(waiting[-1]):
                waiting.pop()
            if holds:
                found += waiting
                waiting = []
                head = value if head is None else head
            if asks and holds and same:
                found.append(value)
            elif asks:
                waiting.append(value)
        if found:
            yield pd.DataFrame({"value": found, "kind": "found", "part": part})
            found = []
    rest = [(v, "open") for v in waiting] + ([] if head is None else [(head, "head")])
    if rest:
        yield pd.DataFrame(rest, columns=["value", "kind"]).assign(part=part)


def prefixes_of(asked: DataFrame, held: DataFrame, proper: bool = True) -> DataFrame:
    """(value): the distinct values of asked that begin a value of held; unless proper, also those that held has itself. Both are frames of one text, `value`.

    In the order of all distinct values those that begin with a value come right after it, so that it is a prefix of another exactly if it is one of the next
    that is different. One sort decides that, without pairs and without a list of prefixes, whatever the values begin with; only the first value of each
    range, and what a range leaves open, is carried over.
    """
    of = lambda df, asks: df.select("value", F.lit(asks).alias("asks"), F.lit(not asks).alias("holds"))
    if asked is held:
        both = asked.where("value IS NOT NULL").distinct().withColumns({"asks": F.lit(True), "holds": F.lit(True)})
    else:
        both = of(asked, True).unionByName(of(held, False)).where("value IS NOT NULL").groupBy("value").agg(F.max("asks").alias("asks"), F.max("holds").alias("holds"))
    ranged = both.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()).withColumn("same", F.lit(not proper))
    told = cut_lineage(ranged.mapInPandas(_prefix_chains, "value string, kind string, part int"))
    heads = {r["part"]: r["value"] for r in told.where("kind = 'head'").collect()}  # one for each range
    last = told.agg(F.max("part")).first()[0]
    coming, after = None, []
    for part in range((-1 if last is None else last), -1, -1):
        after.append((part, coming))
        coming = heads.get(part, coming)
    following = asked.sparkSession.createDataFrame(after, "part int, coming string")
    begins = F.substring(F.col("coming"), F.lit(1), F.length("value")) == F.col("value")
    crossing = told.where("kind = 'open'").join(F.broadcast(following), "part").where(begins)
    return told.where("kind = 'found'").select("value").unionByName(crossing.select("value"))


def with_prefix_anywhere(rows: DataFrame, others: DataFrame, column: str) -> DataFrame:
    """Rows whose value is a proper prefix of some other value, without a scope."""
    found = prefixes_of(rows.select(F.col(column).alias("value")), others.select(F.col(column).alias("value")))
    return rows.join(found.withColumnRenamed("value", column), column, "left_semi").select(*rows.columns)


def survivors(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df with `survivor`: whether the row is the first of its group."""
    return df.withColumn("survivor", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return survivors(df, keys, order).where("survivor").drop("survivor")


def completeness(text: list[str], other: list[str]) -> Column:
    """How many text columns are not blank and others not null."""
    score = F.lit(0)
    for c in text:
        score = score + F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", 1).otherwise(0)
    for c in other:
        score = score + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    return score


def ordered_concat(df: DataFrame, keys: list[str], value: str, pos: str, sep: str) -> DataFrame:
    """Distinct non-blank values of each group in the order in which they come first, joined."""
    first = df.where(F.col(value) != "").groupBy(*keys, value).agg(F.min(pos).alias("_p"))
    pairs = F.array_sort(F.collect_list(F.struct("_p", value)))
    return first.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x[value]), sep).alias(value))


def _filler(run: list[str], columns: list[str], heads: dict[int, tuple[tuple, list[str]]] | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fills the rows of a range. Without heads it gives the range's end instead: (_range, first and last run, whether the run changes, values at the end)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, number, broken = None, None, None, False
        held = [""] * len(columns)
        for batch in batches:
            if not batch.num_rows:
                continue
            keyed = lambda i: tuple(batch.column(c)[i].as_py() for c in run)  # noqa: B023, E731
            if key is None:
                number = batch.column("_range")[0].as_py()
                first = keyed(0)
                key, held = (first, held) if heads is None else heads[number]
            place, changed = np.arange(batch.num_rows), np.zeros(batch.num_rows, bool)
            changed[0] = keyed(0) != key
            for c in run:
                value = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                changed[1:] |= value[1:] != value[:-1]
            begins = np.maximum.accumulate(np.where(changed, place, -1))  # -1: the run goes on from before
            for n, c in enumerate(columns):
                value = batch.column(c).cast(pa.string())
                told = np.maximum.accumulate(np.where(pc.fill_null(pc.not_equal(value, ""), False).to_numpy(zero_copy_only=False), place, -1))
                at = np.where((told >= 0) & (told >= begins), told, np.where(begins < 0, len(place), len(place) + 1))
                filled = pa.concat_arrays([value, pa.array([held[n], ""], pa.string())]).take(pa.array(at))
                held = [*held[:n], filled[-1].as_py(), *held[n + 1 :]]
                if heads is not None:
                    batch = batch.set_column(batch.schema.get_field_index(c), c, filled)
            key, broken = keyed(-1), broken or bool(changed.any())
            if heads is not None:
                yield batch.drop_columns(["_range"])
        if heads is None and number is not None:
            end = {"_range": [number], "first": [[None if v is None else str(v) for v in first]], "last": [[None if v is None else str(v) for v in key]], "broken": [broken], "at_end": [held]}
            yield pa.RecordBatch.from_pydict(end, pa.schema([("_range", pa.int32()), ("first", pa.list_(pa.string())), ("last", pa.list_(pa.string())), ("broken", pa.bool_()), ("at_end", pa.list_(pa.string()))]))

    return work


def fill_down(df: DataFrame, run: list[str], columns: list[str], pos: str) -> DataFrame:
    """Blanks take the value above, within rows that follow one another in the order of pos with equal `run` columns, which are texts.

    The rows are sorted into ranges of pos once, and move no more. What a range begins with is carried over from the ranges before it, of which only
    the first and last run and the values at their end are gathered; then each is filled where it lies.
    """
    ranged = cut_lineage(df.repartitionByRange(pos).sortWithinPartitions(pos).withColumn("_range", F.spark_partition_id()))
    shape = "_range int, first array<string>, last array<string>, broken boolean, at_end array<string>"
    ends = ranged.select("_range", *run, *columns).mapInArrow(_filler(run, columns, None), shape).collect()  # a row for each range
    heads, before, held = {}, None, [""] * len(columns)
    for e in sorted(ends, key=lambda e: e["_range"]):
        first, last = tuple(e["first"]), tuple(e["last"])
        head = held if before == first else [""] * len(columns)
        heads[e["_range"]] = first, head
        held = [v or ("" if e["broken"] else h) for v, h in zip(e["at_end"], head, strict=True)]
        before = last
    return ranged.mapInArrow(_filler(run, columns, heads), df.schema)


def pages_of(df: DataFrame, keys: list[str], order: list[Column], first: int, then: int) -> DataFrame:
    """df with the printed page of each row: `first` rows on page 1 and `then` on each later one."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).withColumn("page", F.when(F.col("_at") <= first, 1).otherwise(2 + F.floor((F.col("_at") - first - 1) / then)).cast("int")).drop("_at")


def unordered_pairs(df: DataFrame, a: str, b: str, id_: str) -> DataFrame:
    """(low, high, kept, directions) for each pair of different ends; kept is the lowest id."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return pairs.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(
        F.min(id_).alias("kept"), F.count_distinct(F.col(a) < F.col(b)).alias("directions"), F.count(F.lit(1)).alias("n")
    )


def with_any(df: DataFrame, id_: str, paths: list[DataFrame]) -> DataFrame:
    """Rows whose id one of the paths gives; each is a table of one column of ids."""
    ids = paths[0].toDF(id_)
    for more in paths[1:]:
        ids = ids.unionByName(more.toDF(id_))
    return df.join(ids, id_, "left_semi")


def _settled(rows: DataFrame, unique: list[str], order: list[Column]) -> DataFrame:
    """rows without those with `_moves` whose unique values a row that stays has, or an earlier one that moves. Nulls are alike."""
    nth = F.row_number().over(Window.partitionBy(*unique).orderBy("_moves", *order))  # rows that stay come first
    return rows.withColumn("_keep", ~F.col("_moves") | (nth == 1)).where("_keep").drop("_keep", "_moves")


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table's row of their key, nulls if there is none. Rows without a key, which one task would get, are dealt by all their values."""
    own = F.xxhash64(F.col(key).cast("string"))
    dealt = rows.withColumn("_deal", F.when(F.col(key).isNull(), F.xxhash64(*rows.columns)).otherwise(own))
    return dealt.join(table.withColumn("_deal", own), [key, "_deal"], "left").drop("_deal")


def moved(rows: DataFrame, mapping: DataFrame, key: str, unique: list[str], order: list[Column], with_: Iterable[str] = ()) -> DataFrame:
    """rows with `key` moved from losers to survivors (loser, survivor), without those moved to where their `unique` values are already.
    The order may be over columns `with_` of the mapping too, which are not kept.

    Rows that stay are kept whatever they repeat; of several moved rows alike the first in order is kept.
    """
    to = mapping.select(F.col("loser").alias(key), F.col("survivor").alias("_to"), *with_)
    both = looked_up(rows, to, key).withColumn("_moves", F.col("_to").isNotNull()).withColumn(key, F.coalesce("_to", key)).drop("_to")
    return _settled(both, [key, *unique], order).drop(*with_)


def rewritten(rows: DataFrame, column: str, value: Column, unique: list[str], order: list[Column]) -> DataFrame:
    """rows with a new value of a column where it is not null and differs, without those that another row with the value makes needless, by `unique`."""
    new = F.coalesce(value, F.col(column))
    changed = rows.withColumn("_moves", F.coalesce(new != F.col(column), F.lit(False))).withColumn(column, new)
    return _settled(changed, [column, *unique], order)
