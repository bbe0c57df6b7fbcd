"""The corpus pipeline: quality rules, language, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread for the
next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from partloom.llm import jaccard, langid, linededup, packing, quality as rules
from partloom.llm.common import bound_batches, bounded_session, cut, remove, shared_folder
from partloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if one language holds this share of its letters.
LEAST_LANGUAGE_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose text passes all rules; null and empty texts fail. Each row is judged alone, whole, whatever its other columns hold."""
    return rules.quality(docs).where("quality.kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from what the stage is given. Rejects null texts, those without a letter and those mostly outside any one language; ids play no part."""
    bound_batches(spark)
    return langid.keep_pure(docs.select(*COLUMNS), langid.learn(docs), least_share=LEAST_LANGUAGE_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs; a document of which nothing is left goes. Rows alike in doc_id and text keep the same lines; null texts stay."""
    bound_batches(spark)
    out = linededup.dedup_lines(docs)
    left = (F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with the column _row, a long that differs in all rows and stays however a scan is cut into tasks: from the row's file and place in it.

    Files are numbered in the order of their names, a table as long as the list of files. What is not read from files is written down first.
    """
    try:
        at = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    files = cut(at.select("_file").distinct().withColumn("_no", F.row_number().over(Window.orderBy("_file"))))
    place = F.shiftleft(F.col("_no").cast("long"), 40) + F.col("_at")
    return at.join(F.broadcast(files), "_file").select(*COLUMNS, place.alias("_row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash over five words, with exact similarity: one row of each component of texts alike by 0.8 or more stays, of the smallest doc_id any row.

    Repeated rows, and nulls and texts without words among themselves, are alike. A null doc_id comes last, so that such a row stays only if its
    component has no other. Whole texts count, however long. An empty table gives an empty one.
    """
    bound_batches(spark)
    rows = numbered(docs)
    found = rows.select("_row", "doc_id").join(jaccard.near_duplicates(rows, "_row"), "_row")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")).select("first._row")
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row, repeated ones each, into sequences; a null or empty text is the one id 0, a very long one is cut. An empty table gives an empty one."""
    bound_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; between stages the rows are in Parquet in the shared checkpoint folder, where the last one's are left.

    Each stage's rows are removed when the next has its own. The caller's session is left as it is; a stage that is called alone sets its session's batches.
    """
    own = bounded_session(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = own.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(own, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = own.read.parquet(f"{folder}/{name}")
        if before:
            remove(own, f"{folder}/{before}")
        before = name
    return docs


#: Language scores, MinHash over XXH64 and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None
