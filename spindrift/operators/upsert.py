"""Keyed upserts with change detection; everything is a join, and results are new tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcomes(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """``incoming`` with each record's outcome: created, updated, unchanged or skipped.

    Records of one url apply in order: each is compared with the one before it, the first
    with the stored row. Records without url are skipped.
    """
    before = F.lag("content_hash").over(Window.partitionBy("url").orderBy(order))
    seen = F.row_number().over(Window.partitionBy("url").orderBy(order)) > 1
    joined = incoming.join(stored.select("url", F.col("content_hash").alias("stored_hash")), "url", "left")
    prior = F.when(seen, before).otherwise(F.col("stored_hash"))
    missing = F.coalesce(F.col("url"), F.lit("")) == ""
    return joined.withColumn("prior", prior).withColumn("outcome", F.when(missing, "skipped").when(F.col("prior").isNull(), "created").when(F.col("prior") == F.col("content_hash"), "unchanged").otherwise("updated")).drop("prior", "stored_hash")


OUTCOMES = ("created", "updated", "unchanged", "skipped")


def _applied(stored: DataFrame, marked: DataFrame, order: str) -> tuple[DataFrame, list]:
    """Stored rows beside what the marked records of their url come to, and the columns of the result."""
    changing = F.col("outcome").isin("created", "updated")
    payload = [c for c in marked.columns if c not in (order, "url", "article_id", "scraped_at", "outcome")]
    last = F.max(F.when(changing, F.col(order))).over(Window.partitionBy("url"))
    per = marked.withColumn("__last", last).groupBy("url").agg(
        F.max("__last").alias("__last"),
        F.max_by(F.struct(*payload), F.when(changing, F.col(order))).alias("new"),
        F.max_by("scraped_at", F.when(F.col("scraped_at").isNotNull() & (F.col("__last").isNull() | (F.col(order) >= F.col("__last"))), F.col(order))).alias("touched"),
        F.first("article_id").alias("new_id"), *[F.count_if(F.col("outcome") == o).alias(f"__{o}") for o in OUTCOMES],
    )
    joined = stored.join(per, "url", "full")
    changed = F.col("__last").isNotNull()
    kept = [c for c in stored.columns if c not in (*payload, "url", "article_id", "scraped_at")]
    scraped = F.coalesce("touched", F.when(~changed | F.col("__last").isNull(), F.col("scraped_at")))
    return joined, [F.coalesce("article_id", "new_id").alias("article_id"), F.col("url"), *[F.when(changed, F.col(f"new.{c}")).otherwise(stored[c]).alias(c) for c in payload], scraped.alias("scraped_at"), *[F.col(c) for c in kept]]


def upsert_articles(stored: DataFrame, incoming: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, outcomes, invalidated ids).

    The last changing record of a url gives all its fields; scraped_at is then refreshed by
    the last later record that has one. Ids and clusters of stored rows stay; rows that
    changed are listed as invalidated, as their vectors are out of date.
    """
    marked = outcomes(stored, incoming, order).where("outcome <> 'skipped'")
    joined, columns = _applied(stored, marked, order)
    stale = joined.where(F.col("article_id").isNotNull() & F.col("__last").isNotNull()).select("article_id")
    return joined.select(*columns), marked, stale


def counted_upsert(order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """``upsert_articles`` as a keyed table's merge, with a count of each outcome beside every row.

    Records without url come out as one row that is there to be counted only (``__keep`` false),
    so that the counters of a run are the sums of one pass, the one that writes.
    """

    def merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        joined, columns = _applied(stored, outcomes(stored, incoming, order), order)
        counts = [F.coalesce(f"__{o}", F.lit(0)).alias(f"__{o}") for o in OUTCOMES]
        return joined.select(*columns, *counts, (F.coalesce("__skipped", F.lit(0)) == 0).alias("__keep"))

    return merge


def outcome_counters() -> dict[str, Column]:
    """Counters of ``counted_upsert`` for the observation of its write."""
    return {o: F.coalesce(F.sum(f"__{o}"), F.lit(0)) for o in OUTCOMES}


def merge_keyed(stored: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Insert or overwrite by key; columns in ``keep`` stay as stored where the key exists.

    Of several incoming rows of one key the last by ``order`` counts.
    """
    if order:
        incoming = incoming.groupBy(key).agg(F.max_by(F.struct(*[c for c in incoming.columns if c != key]), order).alias("__row")).select(key, "__row.*")
    new = incoming.select(key, *[F.col(c).alias(f"__{c}") for c in stored.columns if c != key]).withColumn("__new", F.lit(True))
    joined = stored.withColumn("__old", F.lit(True)).join(new, key, "full")
    value = lambda c: F.when(F.col("__new").isNull() | (F.col("__old").isNotNull() & F.lit(c in keep)), F.col(c)).otherwise(F.col(f"__{c}"))
    return joined.select(*[F.col(c) if c == key else value(c).alias(c) for c in stored.columns])
