"""Retention: old rows go, pruned stories leave tombstones, nothing dangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .upsert import merge_keyed


def should_prune(size_mb: float, limit_mb: float = 475, force: bool = False) -> bool:
    return force or size_mb >= limit_mb


def _cutoff(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def prune_stories(stories: DataFrame, redirects: DataFrame, now: Column, days: int = 10) -> tuple[DataFrame, DataFrame]:
    """(stories, redirects): stories older than ``days`` leave; those with slug, scope and url
    leave a redirect; canonical references to them become null."""
    old = F.coalesce("published_at", "created_at") < _cutoff(now, days)
    gone = stories.where(old)
    tombs = gone.where("slug IS NOT NULL AND scope IS NOT NULL AND url IS NOT NULL").select(F.col("id").alias("story_id"), "scope", "slug", F.col("url").alias("source_url"))
    lost = gone.select(F.col("id").alias("canonical_story_id"), F.lit(True).alias("__lost"))
    kept = stories.where(~F.coalesce(old, F.lit(False))).join(lost, "canonical_story_id", "left")
    kept = kept.withColumn("canonical_story_id", F.when(F.col("__lost").isNull(), F.col("canonical_story_id"))).select(*stories.columns)
    return kept, merge_keyed(redirects, tombs, "story_id")


def prune_articles(articles: DataFrame, vectors: DataFrame, clusters: DataFrame, now: Column, days: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, vectors, clusters) without old articles, their vectors and clusters left empty;
    a representative that left becomes null."""
    old = F.coalesce("published_at", "created_at") < _cutoff(now, days)
    kept = articles.where(~F.coalesce(old, F.lit(False)))
    gone = articles.where(old).select("article_id")
    lost = gone.select(F.col("article_id").alias("representative_id"), F.lit(True).alias("__lost"))
    alive = clusters.join(kept.select("cluster_id").distinct(), "cluster_id", "left_semi").join(lost, "representative_id", "left")
    alive = alive.withColumn("representative_id", F.when(F.col("__lost").isNull(), F.col("representative_id"))).select(*clusters.columns)
    return kept, vectors.join(gone, "article_id", "left_anti"), alive


def prune_by(df: DataFrame, ts: str, now: Column, days: int = 10) -> DataFrame:
    return df.where(~F.coalesce(F.col(ts) < _cutoff(now, days), F.lit(False)))


def prune_stats(**stores: tuple[DataFrame, DataFrame]) -> DataFrame:
    """store, before, removed for each pair (before, after)."""
    rows = [b.agg(F.lit(n).alias("store"), F.count("*").alias("before")).join(F.broadcast(a.agg(F.count("*").alias("after"))), F.lit(True)) for n, (b, a) in stores.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("store", "before", (F.col("before") - F.col("after")).alias("removed"))
