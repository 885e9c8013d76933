"""Freshness filters, first-wins dedup and running per-scope quotas, in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import is_fresh, is_old
from ..functions.urls import normalize_url
from .ordering import running_sums


def freshness(df: DataFrame, ts: str, now: Column, hours: float) -> DataFrame:
    """Rows not older than ``hours``; 0 keeps all; rows without a time go."""
    return df if hours == 0 else df.where(is_fresh(F.col(ts), now, hours))


def dedup_first(df: DataFrame, url: str, order: str) -> DataFrame:
    """The first row of each normalised address, with that address; rows without one all pass."""
    keyed = df.withColumn(url, normalize_url(F.col(url)))
    first = keyed.where(F.col(url).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(url).orderBy(order))).where("__r = 1").drop("__r")
    return first.unionByName(keyed.where(F.col(url).isNull()))


def same_content(df: DataFrame, key: str, order: str) -> DataFrame:
    """Groups of rows with one content hash: key, first, copies."""
    return df.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")


def classify(df: DataFrame, ts: str, now: Column, hours: float, *, old_hours: float = 24) -> DataFrame:
    """``class``: fresh, stale or unknown; with ``hours`` 0 all are fresh and ``old`` marks old ones."""
    if hours == 0:
        return df.withColumn("class", F.lit("fresh")).withColumn("old", is_old(F.col(ts), now, old_hours))
    return df.withColumn("class", F.when(is_fresh(F.col(ts), now, hours), "fresh").when(F.col(ts).isNull(), "unknown").otherwise("stale"))


def scope_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of each class per scope and the share that isn't fresh."""
    out = df.groupBy(*keys).agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("fresh", "stale", "unknown")])
    n = F.col("fresh") + F.col("stale") + F.col("unknown")
    return out.withColumn("stale_ratio", F.coalesce(F.try_divide(F.col("stale") + F.col("unknown"), n), F.lit(0.0)))


def quota_cutoff(df: DataFrame, keys: list[str], order: str, *, max_total: int = 1000, min_check: int = 200, max_ratio: float = 0.5) -> DataFrame:
    """Encounters up to each scope's stop, with ``kept`` for the fresh ones and the stop's reason.

    A scope stops at the encounter where its fresh ones reach ``max_total``, or where, after
    ``min_check`` encounters, more than ``max_ratio`` of them weren't fresh. With a column
    ``old`` (all count as fresh) the ratio is that of old ones.
    """
    legacy = "old" in df.columns
    bad = F.col("old") if legacy else F.col("class") != "fresh"
    run = running_sums(df, keys, [F.col(order)], fresh_so_far=F.col("class") == "fresh", seen=F.lit(1), bad=F.coalesce(bad, F.lit(False)))
    why = F.when(F.col("fresh_so_far") >= max_total, "max_total").when((F.col("seen") >= min_check) & (F.col("bad") / F.col("seen") > max_ratio), "ratio")
    run = run.withColumn("why", why)
    stop = run.where("why IS NOT NULL").groupBy(*keys).agg(F.min(F.struct(order, "why")).alias("stop"))
    out = run.join(stop, keys, "left")
    return out.where(F.col("stop").isNull() | (F.col(order) <= F.col("stop")[order])).withColumn("kept", F.col("class") == "fresh").withColumn("stop_reason", F.col("stop.why")).drop("why", "stop", "bad")


def all_stopped(df: DataFrame, source: str) -> DataFrame:
    """Per source, whether every scope stopped, and the reasons."""
    per = df.groupBy(source, "scope").agg(F.max("stop_reason").alias("reason"))
    return per.groupBy(source).agg(F.bool_and(F.col("reason").isNotNull()).alias("complete"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scope", "reason"))), lambda x: x["reason"]), "; ").alias("reasons"))


def page_stop(df: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Rows of the pages up to and including the first one without any fresh row."""
    pages = df.groupBy(*keys, page).agg(F.bool_or(F.col("class") == "fresh").alias("any"))
    stop = pages.where("NOT any").groupBy(*keys).agg(F.min(page).alias("__stop"))
    return df.join(stop, keys, "left").where(F.col("__stop").isNull() | (F.col(page) <= F.col("__stop"))).drop("__stop")
