"""The queries that apply each operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from partloom.llm import audit, embeddings, langid, linededup, negatives, packing, pieces, quality as _quality, sharding, simhash, topk, toxicity, urls
from partloom.llm.common import bounded_session, crc_fold, table


#: A tokenizer file of the installed package; packing takes any path.
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = WORD_BPE) -> str:
    from public_tokenizers import path

    return str(path(name))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, langid.learn(docs))
    return out.select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by doc_id, and where each would be with a 41st."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs, sharding.topology(40), sharding.topology(41))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"quality.{x}") for x in names])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is deleted of each document, and the MD5 of what is left."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.array_join(F.transform("deleted_runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return out.select("doc_id", "n_lines", "n_deleted", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.coalesce(runs, F.lit("")).alias("deleted_runs"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(bounded_session(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {
        "op1_language": op1_language,
        "op2_sharding": op2_sharding,
        "op3_pieces": op3_pieces,
        "op4_packing": op4_packing,
        "op5_quality": op5_quality,
        "op6_simhash": op6_simhash,
        "op7_toxicity": op7_toxicity,
        "op8_lines": op8_lines,
        "op9_embeddings": op9_embeddings,
        "op10_urls": op10_urls,
        "op11_negatives": op11_negatives,
        "op12_topk": op12_topk,
        "op13_audit": op13_audit,
    }
    return {name: _bounded(query) for name, query in every.items()}


def oracle_sql() -> dict[str, str]:
    from partloom.llm import oracles

    return oracles.oracle_sql()
