"""Reports: crawl, scopes, statuses, duplicates, synthesis outcomes, stage counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def crawl_report(items: DataFrame) -> DataFrame:
    """One row over requests (status_code, bytes, dropped, at): items, drops, percentages, rate, MB, response classes."""
    n, dropped = F.count("*"), F.count_if("dropped")
    seconds = F.timestamp_diff("SECOND", F.min("at"), F.max("at"))
    classes = [F.count_if(F.floor(F.col("status_code") / 100) == c).alias(f"responses_{c}xx") for c in (2, 3, 4, 5)]
    return items.agg(n.alias("items"), dropped.alias("drops"), F.round(F.coalesce(F.try_divide(100.0 * dropped, n), F.lit(0.0)), 2).alias("drop_percent"), F.round(F.coalesce(F.try_divide(n * 1.0, seconds), F.lit(0.0)), 4).alias("items_per_second"), F.round(F.sum("bytes") / 1048576, 4).alias("megabytes"), *classes)


def status_counts(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("status").agg(F.count("*").alias("n"))


def duplicate_groups(members: DataFrame) -> DataFrame:
    """Members of clusters with more than one article, with the cluster's size."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes, "cluster_id").select("cluster_id", "article_id", "size")


def synthesis_report(results: DataFrame) -> DataFrame:
    """Per scope (the result's, else the assigned one, else unknown): counts of outcomes and the drop rate."""
    scope = F.coalesce(F.col("scope"), F.col("assigned_scope"), F.lit("unknown"))
    count = {o: F.count_if(F.col("outcome") == o).alias(o) for o in ("rewritten", "dropped", "failed", "skipped_existing")}
    done = F.col("rewritten") + F.col("dropped") + F.col("failed")
    return results.groupBy(scope.alias("scope_key")).agg(F.count("*").alias("examined"), *count.values()).withColumn("drop_rate", F.round(F.coalesce(F.try_divide(F.col("dropped") * 1.0, done), F.lit(0.0)), 4))


def synthesis_totals(results: DataFrame, seconds: float) -> DataFrame:
    """One row over all outcomes: counts, the drop rate in percent of model calls, clusters a second."""
    count = [F.count_if(F.col("outcome") == o).alias(o) for o in ("rewritten", "dropped", "failed", "skipped_existing")]
    calls = F.col("rewritten") + F.col("dropped") + F.col("failed")
    rate = F.round(F.coalesce(F.try_divide(100.0 * F.col("dropped"), calls), F.lit(0.0)), 2)
    return results.agg(F.count("*").alias("examined"), *count).withColumn("drop_percent", rate).withColumn("per_second", F.round(F.coalesce(F.try_divide(F.col("examined") * 1.0, F.lit(seconds)), F.lit(0.0)), 2))


def observed_outcomes(results: DataFrame, observation: Observation) -> DataFrame:
    """``results`` whose outcomes ``observation`` counts while they are written, without a second pass."""
    return results.observe(observation, F.count("*").alias("examined"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("rewritten", "dropped", "failed", "skipped_existing")])


def stage_counters(articles: DataFrame, assigned: DataFrame) -> DataFrame:
    """examined, skipped (no vector), created (new clusters), joined."""
    a = assigned.agg(F.count("*").alias("placed"), F.count_if(F.col("article_id") == F.col("cluster_id")).alias("created"))
    out = articles.agg(F.count("*").alias("examined")).join(F.broadcast(a), F.lit(True))
    return out.select("examined", (F.col("examined") - F.col("placed")).alias("skipped"), "created", (F.col("placed") - F.col("created")).alias("joined"))


def work_order(clusters: DataFrame, limit: int) -> DataFrame:
    """Ready clusters, the one quiet for longest first."""
    return clusters.where("status = 'ready_for_llm'").orderBy(F.col("last_published_at").asc_nulls_last(), "cluster_id").limit(limit)


def first_of(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
