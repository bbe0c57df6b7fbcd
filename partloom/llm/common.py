"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word is a run of characters outside this ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Texts are long, so that frames of few rows are worked on at a time.
ROWS_PER_FRAME = 1000
#: Rows of one key that a join gives to one task.
ROWS_PER_TASK = 200_000
#: A bucket with more than so many times the mean of its group is uneven.
UNEVEN = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """For an application's own session: Arrow batches of few rows and bytes, since texts are long and workers hold a batch several times over.

    Operators do not call this; they work with batches of any size.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_FRAME))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def bounded_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one and bounded batches; the one given is left as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    bound_batches(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can write one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(frames: Iterable[pd.DataFrame], rows: int = ROWS_PER_FRAME) -> Iterator[pd.DataFrame]:
    """Frames of at most so many rows. Spark bounds the bytes of what it sends by spark.sql.execution.arrow.maxBytesPerBatch."""
    for frame in frames:
        for k in range(0, len(frame), rows):
            yield frame.iloc[k : k + rows].reset_index(drop=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case of letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, from spark.checkpoint.dir. Only a local master may go without, and gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and re.match(r"local($|\[)", sc.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; later reads survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks held-out rows. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def gapless(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str, per_task: int | None = None) -> DataFrame:
    """df with a number from 0 without gaps within each group, without a group in one task.

    Rows are numbered within (group, bucket) in the given order; the counts of a group's earlier buckets are added. bucket is an
    integer column. The counts are joined by the keys by which the rows are dealt already; Spark may broadcast them
    where it finds them small. A bucket that has over per_task rows and several times the mean of its group (as where very many rows are alike, so that
    nothing else tells them apart) is written once with the places of its rows, and cut by them into parts that are numbered alone.
    """
    per_task = per_task or ROWS_PER_TASK
    at, b, n, part, start, mean, place = fresh(df, "_at", "_bucket", "_n", "_part", "_start", "_mean", "_place")
    count = F.count(F.lit(1)).alias(n)
    rows = df.withColumn(b, bucket)
    sums = cut(rows.groupBy(*group, b).agg(count))
    uneven = sums.join(sums.groupBy(*group).agg(F.avg(n).alias(mean)), group) if group else sums.withColumn(mean, F.avg(n).over(Window.partitionBy(F.lit(0))))
    hot = cut(uneven.where((F.col(n) > per_task) & (F.col(n) > UNEVEN * F.col(mean))).drop(mean))
    if hot.isEmpty():
        rows, sums = rows.withColumn(part, F.lit(0)), sums.withColumn(part, F.lit(0))
    else:  # at most one hot bucket for each per_task rows
        told = rows.join(F.broadcast(hot), [*group, b], "left")
        split = cut(told.where(F.col(n).isNotNull()).withColumn(place, F.monotonically_increasing_id()))
        split = split.withColumn(part, F.pmod(F.xxhash64(place), F.ceil(F.col(n) / per_task)).cast("int")).drop(n, place)
        rows = told.where(F.col(n).isNull()).drop(n).withColumn(part, F.lit(0)).unionByName(split)
        sums = sums.join(F.broadcast(hot.drop(n)), [*group, b], "left_anti").withColumn(part, F.lit(0)).unionByName(split.groupBy(*group, b, part).agg(count))
    before = Window.partitionBy(*group).orderBy(b, part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, b, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(*group, b, part).orderBy(*order)
    placed = rows.withColumn(at, F.row_number().over(within)).join(starts, [*group, b, part])
    return placed.withColumn(name, (F.col(start) + F.col(at) - 1).cast("long")).drop(b, part, at, start)


def join_spread(rows: DataFrame, facts: DataFrame, key: list[str], size: str, spread: list[str], how: str = "inner", per_task: int | None = None, total: int | None = None) -> DataFrame:
    """rows joined with facts, which has each key once and in `size` about how many rows have it; size is dropped.

    The rows of a key that has over per_task of them are dealt to several tasks by a hash of their `spread` columns, and its
    facts are copied for each. What is broadcast is the list of such keys, at most one for each per_task rows. Where the `total` of all rows
    is known and no more than that, no key can have too many.
    """
    per = per_task or ROWS_PER_TASK
    if total is not None and total <= per:
        return rows.join(facts.drop(size), key, how)
    salt, splits = fresh(rows, "_salt", "_splits")
    hot = facts.where(F.col(size) > per).select(*key, F.ceil(F.col(size) / per).cast("int").alias(splits))
    dealt = rows.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn(salt, F.pmod(F.xxhash64(*spread), F.coalesce(splits, F.lit(1))).cast("int")).drop(splits)
    last = F.when(F.col(size) > per, F.ceil(F.col(size) / per) - 1).otherwise(0).cast("int")
    copies = facts.withColumn(salt, F.explode(F.sequence(F.lit(0), last))).drop(size)
    return dealt.join(copies, [*key, salt], how).drop(salt)


def shipped(df: DataFrame, path: str) -> Broadcast[bytes]:
    """A model file of the driver, of some megabytes whatever the data, sent to the executors, which need not have it."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def by_text(df: DataFrame, doc_id: str, text: str, work: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]], made: str) -> DataFrame:
    """work applied to frames (doc_id, text) and giving doc_id and the columns `made`. Ids go as strings, so that nulls do not turn others into floats."""
    kind = df.schema[doc_id].dataType
    out = df.select(df[doc_id].cast("string").alias("doc_id"), df[text].alias("text")).mapInPandas(lambda frames: work(small(frames)), f"doc_id string, {made}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def runs(frames: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames sorted by key, cut anew so that no key is in two of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame[key].iat[-1]
        first = int(np.searchsorted(frame[key].to_numpy(), last))
        if first:
            held.append(frame.iloc[:first])
            yield pd.concat(held, ignore_index=True)
            held = [frame.iloc[first:]]
        elif held and held[-1][key].iat[-1] != last:
            yield pd.concat(held, ignore_index=True)
            held = [frame]
        else:
            held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


class WordTable:
    """Numbers for words, and a row of figures for each, made once a worker. Emptied when it has over `limit` words."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], limit: int = 400_000) -> None:
        self.make, self.limit = make, limit
        self.index: dict[str, int] = {}
        self.store = make([])

    def numbers(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The row numbers of each document's words; they hold until the next call."""
        index = self.index
        if len(index) > self.limit:
            index.clear()
        n = len(index)
        new = list({w for words in docs for w in words if w not in index})
        if new:
            if n + len(new) > len(self.store):
                grown = np.zeros((2 * (n + len(new)), self.store.shape[1]), self.store.dtype)
                grown[:n] = self.store[:n]
                self.store = grown
            self.store[n : n + len(new)] = self.make(new)
            index.update(zip(new, range(n, n + len(new)), strict=True))
        get = index.__getitem__
        return [np.fromiter(map(get, words), np.int32, len(words)) for words in docs]
