"""A corpus pipeline: good documents, one of each near-duplicate group, without repeated
passages and benchmark passages, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontamination, near_dedup, packing, passage_dedup, quality
from spindrift.llm.tables import columns, table, without, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores below its threshold."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with an inner key: rows with one id, or none, and different texts are told apart."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group, once.

    Rows equal in id and text are one document, others with a common id are not. Rows
    without an id are linked with nothing and stay.
    """
    rows = keyed(docs)
    known = rows.where("doc_id IS NOT NULL")
    found = written(near_dedup.near_duplicates(known, id_col="__key"), "near")
    linked = found.select(F.col("doc_id").alias("__key"), "component_id").distinct()
    linked = linked.join(linked.groupBy("component_id").count().where("count > 1").select("component_id"), "component_id")
    linked = written(linked.join(known.select("__key", F.col("doc_id").alias("id")).distinct(), "__key"), "linked")
    first = linked.groupBy("component_id").agg(F.min(F.struct("id", "__key"))["__key"].alias("first"))
    kept = without(rows, linked.join(first, "component_id").where("__key <> first").select("__key"), "__key")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["__key"]).unionByName(kept.where("doc_id IS NULL"))
    return kept.select(*columns(docs))


def passage_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand earlier too; a text that loses everything stays as an empty one.

    All other columns stay as they are, whatever their names; n_chars follows the text.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = passage_dedup.remove_repeats(docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("__rest")))
    out = cut.select("doc_id", "text", *[F.col(f"__rest.`{c}`") for c in rest])
    return (out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in rest else out).select(*columns(docs))


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are contaminated with benchmark passages."""
    rows = keyed(docs)
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="__key")
    return without(rows, found.where("contaminated").select(F.col("doc_id").alias("__key")), "__key").select(*columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    import public_tokenizers

    return packing.best_fit_packing(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicate_filter", near_duplicate_filter),
    ("passage_removal", passage_removal),
    ("benchmark_filter", benchmark_filter),
    ("pack_sequences", pack_sequences),
]

#: SQL can't express the classifier or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
