"""The operators applied to the tables of a folder, one query each, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_warc, fuzzy_lines, gbt_rules, jaccard_join, language_id, mih_search, source_mix, token_records, tree_bpe, zstd_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the id as text, modulo n: what the folds are drawn by."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = arc_warc.convert(arc_warc.write_arc(table(spark, sf_dir, "pages")), min_bytes=0)
    found = arc_warc.scan_warc(archives)
    return found.select(F.col("row_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gbt_rules.quality_rules(docs, gbt_rules.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents"))
    n_dropped = F.size("dropped").alias("n_dropped")
    return found.select("doc_id", "n_lines", n_dropped, "dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query
def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = zstd_quality.train(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return zstd_quality.compression_score(docs, model).withColumn("held_out", remainder(5) == 0).select("doc_id", "held_out", "score", "predicted", "difference")


@query
def op7_mih_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mih_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL["op7_mih_search"] = mih_search.SQL


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(remainder(4) != 2))
    found = language_id.language_id(docs, model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = tree_bpe.encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), decoded=True)
    n_tokens = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_records(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return token_records.checksums(token_records.read_records(manifest))


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE_SQL["op6_source_mix"] = source_mix.SQL


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))
