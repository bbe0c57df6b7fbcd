"""Substring search by an index of trigrams, without a scan of what is searched.

Every text counts once: `grams` holds, for each distinct text of a source, its pieces of three characters and where they stand. It is written in
segments: a task sorts the pieces of some of its texts, so that nothing but distinct texts moves, and a search skips all pages of a file but those with
its pieces. A search reads the pieces of its query only: pieces that cover the query must stand one behind the other in a text, which is a chain of
semi-joins on (text, place). A query of one or two characters is the beginning of a piece, since every place of a text begins one. Texts are known by a
64-bit hash, by which rows are joined with the texts found; whoever fetches rows checks their texts anyway.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.functions.text import any_of, contains_text
from partloom.operators.lineage import cut_lineage

SIZE = 3
#: A segment ends with the batch of texts that fills it to so many characters; a row group has so many bytes.
SEGMENT, GROUP = 4_000_000, 8 << 20
#: Up to so many texts found in a column are sent to all tasks that read rows; more are joined by a shuffle.
SENT = 100_000
#: A character as a number above 0 has so many bits.
_BITS = 21

#: A source is a table's column: the table and the column.
Source = tuple[DataFrame, str]


def _segments() -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pieces of texts, in segments; what it gives is sent to the executors whole, which need not have this module."""

    def segment(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(source, text_id, at, gram) of the texts of some batches, sorted by gram. A gram is held as one number, which sorts like the text."""
        table = pa.Table.from_batches(batches)
        texts = table["text"].to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        of = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        key = np.zeros(len(codes), np.int64)
        for k in range(SIZE):
            there = np.zeros(len(codes), np.int64)
            there[: max(0, len(codes) - k)] = codes[k:]
            key = key << _BITS | np.where(at + k < lengths[of], there, 0)
        order = np.argsort(key, kind="stable")
        grams, which = np.unique(key[order], return_inverse=True)
        shown = ["".join(chr(c - 1) for c in ((g >> _BITS * k) & ((1 << _BITS) - 1) for k in reversed(range(SIZE))) if c) for g in grams.tolist()]
        for i in range(0, len(order), 100_000):
            part = order[i : i + 100_000]
            rows = table.select(["source", "text_id"]).take(pa.array(of[part]))
            gram = pa.array(shown, pa.string()).take(pa.array(which[i : i + 100_000]))
            yield from rows.append_column("at", pa.array(at[part], pa.int32())).append_column("gram", gram).combine_chunks().to_batches()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(pc.utf8_length(batch.column("text"))).as_py() or 0
            if size >= SEGMENT:
                yield from segment(held)
                held, size = [], 0
        if size:
            yield from segment(held)

    return work


def build(spark: SparkSession, folder: str, sources: Mapping[str, Source]) -> None:
    """Writes the index of the sources into a folder that all executors share. Nulls and blanks are not indexed; case is folded."""
    every = [df.select(F.lit(name).alias("source"), F.lower(column).alias("text")) for name, (df, column) in sources.items()]
    texts = functools.reduce(DataFrame.unionByName, every).where("text <> ''").distinct().withColumn("text_id", F.xxhash64("text"))
    grams = texts.mapInArrow(_segments(), "source string, text_id long, at int, gram string")
    grams.write.option("parquet.block.size", GROUP).parquet(f"{folder}/grams")


def cover(q: str) -> list[int]:
    """Where pieces of q begin that cover it whole."""
    last = len(q) - SIZE
    return [*range(0, last, SIZE), last]


def texts_with(spark: SparkSession, folder: str, q: str, sources: Iterable[str]) -> DataFrame:
    """(source, text_id) of the texts that contain q, from its pieces alone."""
    q = q.lower()
    grams = spark.read.parquet(f"{folder}/grams").where(F.col("source").isin(*sources))
    if len(q) <= SIZE:
        return grams.where(F.col("gram") == q if len(q) == SIZE else F.col("gram").startswith(q)).select("source", "text_id").distinct()
    at = lambda k: grams.where(F.col("gram") == q[k : k + SIZE]).select("source", "text_id", (F.col("at") - k).alias("first"))
    first, *others = cover(q)
    found = at(first)
    for k in others:
        found = found.join(at(k), ["source", "text_id", "first"], "left_semi")
    return found.select("source", "text_id").distinct()


def find(spark: SparkSession, folder: str, q: str, sources: Iterable[str]) -> DataFrame:
    """(source, text_id) of the texts that contain q, ignoring case. q must not be blank; white space around it does not count."""
    q = q.strip()
    if not q:
        raise ValueError("a blank query has no pieces")
    return texts_with(spark, folder, q, list(sources))


class Index:
    """The index of some tables: {table: (frame, id, columns)}."""

    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, tuple[DataFrame, str, Iterable[str]]]) -> None:
        self.spark, self.folder = spark, folder
        self.tables = {name: (df.where(F.col(id_).isNotNull()), df, list(columns)) for name, (df, id_, columns) in tables.items()}
        self._found: dict[str, tuple[DataFrame, dict[str, int]]] = {}
        build(spark, folder, {f"{name}.{c}": (df, c) for name, (df, _, columns) in self.tables.items() for c in columns})

    def _texts(self, q: str) -> tuple[DataFrame, dict[str, int]]:
        """The texts that contain q, and how many each source has: all sources at once, since a query is often put to several tables."""
        if q not in self._found:
            every = [f"{name}.{c}" for name, (_, _, columns) in self.tables.items() for c in columns]
            found = cut_lineage(find(self.spark, self.folder, q, every))
            self._found[q] = found, {r["source"]: r["count"] for r in found.groupBy("source").count().collect()}
        return self._found[q]

    def search(self, table: str, q: str, columns: Iterable[str] | None = None) -> DataFrame:
        """The rows of a table with q in any of the columns, as a scan would find them; all rows for a blank q. Only columns with texts found are read for it."""
        df, whole, every = self.tables[table]
        if not q.strip():
            return whole
        found, n = self._texts(q)
        columns = [c for c in columns or every if n.get(f"{table}.{c}")]
        if not columns:
            return df.where("false")
        known = {c: found.where(F.col("source") == f"{table}.{c}").select(F.col("text_id").alias(f"_{c}_id")) for c in columns}
        known = {c: F.broadcast(ids) if n[f"{table}.{c}"] <= SENT else ids for c, ids in known.items()}
        own = lambda c: F.xxhash64(F.lower(c)) == F.col(f"_{c}_id")
        if len(columns) == 1:
            met = df.join(known[columns[0]], own(columns[0]), "left_semi")
        else:
            met = functools.reduce(lambda rows, c: rows.join(known[c], own(c), "left"), columns, df).where(any_of([F.col(f"_{c}_id").isNotNull() for c in columns]))
        return met.select(*df.columns).where(any_of([F.coalesce(contains_text(F.col(c), q.strip()), F.lit(False)) for c in columns]))
