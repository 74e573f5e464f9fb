"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

Language ID drops documents without a language, line dedup takes out repeated lines, the n-gram Jaccard join leaves one
document of each group of near copies, the mix repeats or drops documents by source, and byte-pair encoding ends it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import fuzzy_lines, jaccard_join, language_id, source_mix, tree_bpe
from vellum.llm.common import WORD, materialise
from vellum.llm.queries import remainder, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of a text's letters that its language must hold.
LEAST_SHARE = 0.4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no prevailing language, go; the others carry the language found."""
    model = language_id.train(docs.where(remainder(4) != 2))
    found = language_id.language_id(docs, model, tuple(COLUMNS))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that these leave without a word."""
    found = fuzzy_lines.dedup_lines(docs.select(COLUMNS))
    left = (F.size("dropped") == 0) | F.col("text").rlike(WORD)
    return found.where(left).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document with the smallest id stays; rows without an id stay.

    Different texts that share an id are told apart by a number of the row: each is a document of its own, and of a group
    the one with the smallest id, then the smallest number, stays.
    """
    named = docs.select(COLUMNS).where("doc_id is not null")
    again = materialise(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-ids")
    if again.isEmpty():
        groups = jaccard_join.jaccard_groups(named)
        first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
        kept = named.join(first, "doc_id", "left_semi")
    else:
        # numbers in the order of ids: those of one id lie next to each other
        numbered = materialise(named.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "jaccard-rows")
        groups = jaccard_join.jaccard_groups(numbered.select(F.col("_row").alias("doc_id"), "text"))
        first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_row"))
        kept = numbered.join(first, "_row", "left_semi")
    return kept.select(COLUMNS).unionByName(docs.select(COLUMNS).where(F.col("doc_id").isNull()))


def copies(taken: DataFrame) -> DataFrame:
    """doc_id, source, times and part (of a further copy; null ids only), from doc_id, source, size, source_size and taken.

    In seeded shards of a source, by size, the parts of copies are summed, and where the sum passes a half the document
    has one copy more; neighbours are of like size, so a shard's words are off by about one document at most.
    """
    shards = F.ceil(F.col("source_size") / source_mix.SHARD_WORDS)
    shard = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.greatest(shards, F.lit(1)))
    part = F.when(F.col("doc_id").isNotNull(), F.expr("(taken % size) / size")).otherwise(0.0)
    w = Window.partitionBy("source", "shard").orderBy("size", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = taken.withColumn("shard", shard).withColumn("part", part).withColumn("upto", F.sum("part").over(w))
    more = F.when(F.col("part") > 0, F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("part") + 0.5)).otherwise(0)
    alone = F.when(F.col("doc_id").isNull(), F.expr("(taken % size) / size")).otherwise(0.0)
    return summed.select("doc_id", "source", (F.expr("taken div size") + F.least(more, F.lit(1))).cast("int").alias("times"), alone.alias("part"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document a whole number of times, so that the words of its source come near what the mix takes of it."""
    docs = docs.select(COLUMNS)
    taken = source_mix.mix(docs).groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.first("source_size").alias("source_size"), F.sum("taken").alias("taken")).where("size > 0")
    keep = copies(taken).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "times", "part").where("times > 0 or part > 0")
    found = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")))
    # rows without an id are one to the mix: each has its further copy by a draw of its own
    drawn = F.pmod(F.xxhash64("text", F.lit("copies")), F.lit(1 << 20)) < F.col("part") * (1 << 20)
    times = F.col("times") + drawn.cast("int")
    return found.withColumn("times", times).where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit)."""
    coded = tree_bpe.encode(docs, tokenizer("byte_bpe_50k.json"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("jaccard_join", dedup_documents), ("source_mix", mix_sources), ("bpe_encode", encode)]

#: SQL can express neither the language model nor the encoder; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
