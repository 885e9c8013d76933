"""Greedy event clusters, their merging, and the collapse of published stories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shared_tokens, title_tokens, token_jaccard
from ..sources.tables import written
from .components import components, linked_components, roots
from .similarity import close_clusters, neighbours, store_vectors


def _order() -> list:
    return [F.col("published_at").asc_nulls_last(), F.col("created_at"), F.col("article_id")]


def parents(articles: DataFrame, *, cross: float = 0.82, same: float = 0.90, k: int = 5, hours: int = 48, index: str | None = None) -> DataFrame:
    """id, parent: each article's best neighbour that comes before it in time (or that has a
    cluster already) and is similar enough; itself if there is none.

    All k neighbours use up their place, later ones too. Two articles of one known source
    need ``same``, others ``cross``. Articles that have a cluster are left out; with ``index``
    (see ``neighbours``) their vectors come from there, and only new ones are compared.
    """
    has = "cluster_id" in articles.columns
    a = articles.withColumn("known", F.col("cluster_id").isNotNull() if has else F.lit(False)).where("embedding IS NOT NULL")
    facts = a.select("article_id", "source", "known", F.struct(F.col("published_at").isNull().alias("x"), F.col("published_at").alias("p"), F.col("created_at").alias("c"), F.col("article_id").alias("i")).alias("place"))
    mine = facts.withColumnsRenamed({"source": "s1", "known": "k1", "place": "p1"})
    theirs = facts.select(F.col("article_id").alias("neighbour_id"), F.col("source").alias("s2"), F.col("known").alias("k2"), F.col("place").alias("p2"))
    need = F.when(F.coalesce(F.col("s1") == F.col("s2"), F.lit(False)), same).otherwise(cross)
    near = neighbours(a if index is None else a.where("NOT known"), k=k, hours=hours, index=index)
    edges = near.join(mine, "article_id").join(theirs, "neighbour_id").where(~F.col("k1") & (F.col("similarity") >= need) & (F.col("k2") | (F.col("p2") < F.col("p1"))))
    best = edges.groupBy("article_id").agg(F.min_by("neighbour_id", F.col("rank")).alias("parent"))
    return a.where("NOT known").select("article_id").join(best, "article_id", "left").select(F.col("article_id").alias("id"), F.coalesce("parent", "article_id").alias("parent"))


def assign(articles: DataFrame, **rules: float | str) -> DataFrame:
    """article_id, cluster_id for every article with a vector: the greedy online rule in time
    order, as the roots of a forest of best earlier neighbours.

    A cluster is named by its first article, or keeps its id where one exists.
    """
    has = "cluster_id" in articles.columns
    p = parents(articles, **rules)
    if not has:
        return roots(p).select(F.col("id").alias("article_id"), F.col("root").alias("cluster_id"))
    old = articles.where("cluster_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("article_id").alias("id"), F.col("cluster_id").alias("old"))
    top = roots(p.unionByName(old.select("id", F.col("id").alias("parent"))))
    return top.join(old.withColumnRenamed("id", "root"), "root", "left").select(F.col("id").alias("article_id"), F.coalesce("old", F.col("root")).alias("cluster_id"))


def assign_new(articles: DataFrame, index: str, run: str, **rules: float) -> DataFrame:
    """article_id, cluster_id of the articles without a cluster, whose vectors then join ``index``.

    The work of a run follows its new articles: they are compared with each other and with the
    stored packs of their blocks; of the articles that have a cluster only parents are looked up.
    """
    p = written(parents(articles, index=index, **rules), "parents")
    top = p.select(F.col("parent").alias("id")).distinct().join(p.select("id"), "id", "left_anti")
    old = written(articles.where("cluster_id IS NOT NULL").select(F.col("article_id").alias("id"), F.col("cluster_id").alias("old")).join(top, "id"), "known")
    found = roots(p.unionByName(old.select("id", F.col("id").alias("parent")))).join(p.select("id"), "id", "left_semi")
    store_vectors(articles.where("cluster_id IS NULL"), index, run, hours=rules.get("hours", 48))
    return found.join(old.withColumnRenamed("id", "root"), "root", "left").select(F.col("id").alias("article_id"), F.coalesce("old", F.col("root")).alias("cluster_id"))


def cluster_attributes(members: DataFrame) -> DataFrame:
    """One row per cluster of ``members`` (articles with cluster_id): count, first and last
    date, representative and title of the earliest article (no date last), scope, status open."""
    first = F.struct(F.col("published_at").isNull(), "published_at", "created_at", "article_id")
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("article_count"), F.min("published_at").alias("first_published_at"), F.max("published_at").alias("last_published_at"),
        F.min_by("article_id", first).alias("representative_id"), F.min_by("title", first).alias("title_hint"), F.min_by("scope", first).alias("scope"),
    ).withColumn("status", F.lit("open"))


@dataclass(frozen=True)
class MergeRules:
    """Merge two clusters if their centroids, or two of their members, or centroids and titles are close."""

    centroid: float = 0.74
    pair: float = 0.82
    soft: float = 0.68
    title: float = 0.35
    tokens: int = 2
    hours: int = 48


def merge_scores(clusters: DataFrame, members: DataFrame, rules: MergeRules = MergeRules()) -> DataFrame:
    """a, b, the scores of pairs of clusters in one window, reasons, merge.

    Pairs that neither their centroids nor their members could join are left out
    (``close_clusters``), before there is a row of them.
    """
    close = close_clusters(clusters, members, hours=rules.hours, centroid=rules.centroid, pair=rules.pair, soft=rules.soft)
    t = clusters.select("cluster_id", title_tokens(F.col("title_hint")).alias("tokens"))
    both = close.join(t.withColumnsRenamed({"cluster_id": "a", "tokens": "t"}), "a").join(t.withColumnsRenamed({"cluster_id": "b", "tokens": "u"}), "b")
    some = (F.size("t") > 0) & (F.size("u") > 0)
    scored = both.select("a", "b", "centroid_sim", "max_pair", token_jaccard(F.col("t"), F.col("u")).alias("jaccard"), F.when(some, shared_tokens(F.col("t"), F.col("u"))).otherwise(0).alias("shared_tokens"))
    soft = (F.col("centroid_sim") >= rules.soft) & (F.col("jaccard") >= rules.title) & (F.col("shared_tokens") >= rules.tokens)
    why = F.array_compact(F.array(F.when(F.col("centroid_sim") >= rules.centroid, "centroid"), F.when(F.col("max_pair") >= rules.pair, "pairwise"), F.when(soft, "title_soft")))
    return scored.withColumn("reasons", F.array_join(why, ",")).withColumn("merge", F.size(why) > 0)


def survivors(groups: DataFrame, *keys: Column) -> DataFrame:
    """id, survivor: the one of each component with the smallest ``keys``, ties to the smaller id.

    A component is reduced by partial minima and joined, so a giant one is never sorted.
    """
    best = groups.groupBy("component").agg(F.min_by("id", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("id").alias("id"))).alias("survivor"))
    return groups.join(best, "component").select("id", "survivor")


def _latest_first(c: str) -> list[Column]:
    return [F.col(c).isNull(), -F.unix_micros(F.col(c).cast("timestamp"))]


def merge_targets(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """cluster_id, survivor: the survivor of a component has the most articles, then the latest date."""
    ids = clusters.select(F.col("cluster_id").alias("id"))
    groups = components(ids, scores.where("merge").select("a", "b")).join(clusters.select(F.col("cluster_id").alias("id"), "article_count", "last_published_at"), "id")
    return survivors(groups, -F.col("article_count"), *_latest_first("last_published_at")).withColumnRenamed("id", "cluster_id")


def merge_clusters(clusters: DataFrame, members: DataFrame, rules: MergeRules = MergeRules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, members, scores) after merging: the survivor of a component takes all members
    and is open again.

    Only open and ready clusters with a vector take part.
    """
    scores = written(merge_scores(clusters.where(F.col("status").isin("open", "ready_for_llm")), members, rules), "scores")
    moved = members.join(merge_targets(clusters, scores), "cluster_id").drop("cluster_id").withColumnRenamed("survivor", "cluster_id")
    return cluster_attributes(moved), moved, scores


def merge_statistics(clusters: DataFrame, merged: DataFrame, examined: DataFrame) -> DataFrame:
    """examined_pairs, merged_clusters, components of a merge run, as one row; ``examined`` are
    the pairs within one window (``overlapping_pairs``)."""
    one = examined.agg(F.count("*").alias("examined_pairs"))
    before, after = (x.agg(F.count("*").alias(n)) for x, n in ((clusters, "before"), (merged, "components")))
    return one.join(before, F.lit(True)).join(after, F.lit(True)).select("examined_pairs", (F.col("before") - F.col("components")).alias("merged_clusters"), "components")


def merge_log(scores: DataFrame, moved: DataFrame, now) -> DataFrame:
    """Lines of a merge run's log: one for each pair that merged with its scores, to four
    digits, and one for each cluster that a survivor took in (``moved``: cluster_id, survivor)."""
    pairs = scores.where("merge").select(F.lit("pair").alias("type"), F.col("b").alias("from_cluster_id"), F.col("a").alias("to_cluster_id"), *[F.round(c, 4).alias(c) for c in ("centroid_sim", "max_pair", "jaccard")], "shared_tokens", "reasons")
    taken = moved.where("cluster_id <> survivor").select(F.lit("merge").alias("type"), F.col("cluster_id").alias("from_cluster_id"), F.col("survivor").alias("to_cluster_id"))
    return pairs.unionByName(taken, allowMissingColumns=True).withColumn("timestamp", now)


def collapse_stories(stories: DataFrame, rules: MergeRules = MergeRules()) -> DataFrame:
    """id, canonical_story_id for stories (id, title, scope, priority, published_at, embedding):
    null for survivors, who have the highest priority, then the latest date."""
    one = stories.where("canonical_story_id IS NULL AND embedding IS NOT NULL") if "canonical_story_id" in stories.columns else stories.where("embedding IS NOT NULL")
    c = one.select(F.col("id").alias("cluster_id"), "scope", F.col("published_at").alias("first_published_at"), F.col("published_at").alias("last_published_at"), F.col("title").alias("title_hint"))
    scores = merge_scores(c, one.select(F.col("id").alias("cluster_id"), "embedding"), rules)
    groups = components(one, scores.where("merge").select("a", "b")).join(one.select("id", "priority", "published_at"), "id")
    to = survivors(groups, -F.col("priority"), *_latest_first("published_at"))
    return to.select("id", F.nullif("survivor", F.col("id")).alias("canonical_story_id"))


def fold_for_rewriting(collapsed: DataFrame, stories: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) after the clusters of collapsed stories went into their survivor's.

    ``collapsed`` is collapse_stories' result, ``stories`` has id and cluster_id. The clusters
    of a group's stories belong together, and groups that share a cluster are one: all fold
    into the smallest cluster that holds a surviving story. Only groups of two or more
    clusters are touched: their cluster is ready for the model again.
    """
    own = stories.select("id", "cluster_id")
    to = own.select(F.col("id").alias("canonical_story_id"), F.col("cluster_id").alias("b"))
    links = written(collapsed.where("canonical_story_id IS NOT NULL").join(own.withColumnRenamed("cluster_id", "a"), "id").join(to, "canonical_story_id").where("a <> b").select("a", "b").distinct(), "folds")
    groups = written(linked_components(links), "groups")
    first = links.select(F.col("b").alias("node")).distinct().join(groups, "node").groupBy("component").agg(F.min("node").alias("target"))
    moves = groups.join(first, "component").select(F.col("node").alias("cluster_id"), "target")
    moved = members.join(moves, "cluster_id", "left").withColumn("cluster_id", F.coalesce("target", "cluster_id")).drop("target")
    touched = first.select(F.col("target").alias("cluster_id"), F.lit(True).alias("__again"))
    attributes = cluster_attributes(moved).join(touched, "cluster_id", "left")
    return attributes.withColumn("status", F.when(F.col("__again"), "ready_for_llm").otherwise(F.col("status"))).drop("__again"), moved


def mark_ready(clusters: DataFrame, now, *, minutes: int = 10, force: bool = False) -> DataFrame:
    """Open clusters with articles and a date turn ready after ``minutes`` without a change."""
    changed = F.coalesce("updated_at", "last_published_at") if "updated_at" in clusters.columns else F.col("last_published_at")
    quiet = F.lit(force) | (F.col("last_published_at").isNotNull() & (F.col("article_count") >= 1) & (now - changed >= F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))
    return clusters.withColumn("status", F.when((F.col("status") == "open") & F.coalesce(quiet, F.lit(False)), "ready_for_llm").otherwise(F.col("status")))
