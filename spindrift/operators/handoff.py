"""Hand-off to a language model: payloads, running a function over rows, reading its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CATEGORIES, SCOPES, normalize_category, normalize_scope
from ..functions.text import json_object, story_slug
from ..functions.urls import publisher_rank
from ..sources.tables import written
from .feeds import unseen

_JSON = {"ignoreNullFields": "false"}


def members_in_order(members: DataFrame, *fields: str) -> Column:
    """The members of a group by date, absent dates first, then id (an aggregate)."""
    key = F.struct(F.col("published_at").isNotNull(), "published_at", "article_id")
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct(*fields).alias("x")))), lambda s: s["x"])


def cluster_payload(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, payload: a cluster's facts and its members as one JSON object."""
    fields = ("source", "title", "url", "summary", "body", "published_at")
    per = members.groupBy("cluster_id").agg(members_in_order(members, *fields).alias("articles"))
    return clusters.join(per, "cluster_id").select("cluster_id", F.to_json(F.struct("cluster_id", "scope", "status", "article_count", "articles"), _JSON).alias("payload"))


def classify_payload(members: DataFrame) -> DataFrame:
    """cluster_id, payload: the members' non-blank titles."""
    per = members.groupBy("cluster_id").agg(members_in_order(members, "title").alias("a"))
    titles = F.transform(F.filter("a", lambda x: F.coalesce(F.trim(x["title"]) != "", F.lit(False))), lambda x: F.trim(x["title"]))
    return per.select("cluster_id", F.to_json(F.struct(titles.alias("titles"))).alias("payload"))


def rewrite_payload(clusters: DataFrame, members: DataFrame, limit: int = 800) -> DataFrame:
    """cluster_id, payload: scope, and title, summary and cut body of each member."""
    cut = members.withColumn("body", F.coalesce(F.substring("body", 1, limit), F.lit("")))
    per = cut.groupBy("cluster_id").agg(members_in_order(cut, "title", "summary", "body").alias("articles"))
    return clusters.join(per, "cluster_id").select("cluster_id", F.to_json(F.struct(F.col("scope").alias("assigned_scope"), "articles"), _JSON).alias("payload"))


def run_model(df: DataFrame, batch_fn: Callable[[list[str]], list[str]], *, key: str = "cluster_id", batch: int = 16) -> DataFrame:
    """key, answer: ``batch_fn`` over the payloads in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(batch_fn(b.column(1).to_pylist()), pa.string())], [key, "answer"])

    source = df.select(key, "payload")
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, answer string")


def _text(answer: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(answer, f"$.{n}") for n in names])


def _action(answer: Column, keep: str) -> Column:
    """The action; ``publish`` (a flag or a word) stands in for an absent one."""
    action, publish = F.lower(F.trim(_text(answer, "action"))), F.lower(F.trim(_text(answer, "publish")))
    same = {"keep": ("rewrite",), "rewrite": ("keep", "rewrite")}[keep]
    return F.when(action.isin(list(same)), keep).when(action.isNotNull(), action).when(publish.isin("true", "yes", "1"), keep).when(publish.isNotNull(), "drop")


def coerce_classify(answer: Column) -> Column:
    """struct(action, drop_reason) of a first-stage answer with its aliases."""
    action = _action(answer, "keep")
    return F.struct(action.alias("action"), F.when(F.coalesce(action != "keep", F.lit(True)), _text(answer, "drop_reason", "reason", "dropReason")).alias("drop_reason"))


def coerce_rewrite(answer: Column) -> Column:
    """struct of a second-stage answer with its aliases; a drop has no content."""
    action = _action(answer, "rewrite")
    kept = lambda c: F.when(F.coalesce(action != "drop", F.lit(True)), c)
    priority = F.trim(_text(answer, "priority", "priority_points", "priority_score")).try_cast("int")
    return F.struct(
        action.alias("action"), _text(answer, "drop_reason", "reason", "dropReason").alias("drop_reason"),
        kept(normalize_scope(_text(answer, "scope"))).alias("scope"), kept(normalize_category(_text(answer, "category", "primary_category", "news_category"))).alias("category"), kept(priority).alias("priority"),
        kept(_text(answer, "title", "headline", "rewrite_title")).alias("title"), kept(_text(answer, "summary", "rewrite_summary")).alias("summary"), kept(_text(answer, "body", "rewrite_body", "article_body")).alias("body"),
    )


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def classify_error(r: Column) -> Column:
    """What is wrong with a first-stage result, null if nothing."""
    action = r["action"]
    return F.when(action.isNull() | ~action.isin("keep", "drop"), "bad action").when((action == "drop") & _blank(r["drop_reason"]), "drop without reason").when((action == "keep") & ~_blank(r["drop_reason"]), "keep with reason")


def rewrite_error(r: Column) -> Column:
    """What is wrong with a second-stage result, null if nothing."""
    action = r["action"]
    missing = F.array_join(F.array_compact(F.array(*[F.when(_blank(r[f]), F.lit(f)) for f in ("title", "summary", "body", "scope", "category", "priority")])), ", ")
    bad = F.when(missing != "", F.concat(F.lit("missing: "), missing)).when(~r["scope"].isin(list(SCOPES)), "bad scope").when(~r["category"].isin(CATEGORIES), "bad category").when(~r["priority"].between(1, 100), "bad priority")
    return F.when(action.isNull() | ~action.isin("rewrite", "drop"), "bad action").when((action == "drop") & _blank(r["drop_reason"]), "drop without reason").when(action == "rewrite", bad)


def outcome(existing: Column, first: Column, second: Column) -> Column:
    """skipped_existing, dropped, failed or rewritten for a cluster's two coerced results."""
    return F.when(existing, "skipped_existing").when(classify_error(first).isNotNull(), "failed").when(first["action"] == "drop", "dropped").when(rewrite_error(second).isNotNull(), "failed").when(second["action"] == "drop", "dropped").otherwise("rewritten")


def story_aggregates(members: DataFrame) -> DataFrame:
    """Per cluster: tag union in first order, sorted sources, addresses in order, main image.

    The image is that of the best-ranked publisher, the earliest of these (no date counts as
    the earliest); members are articles with tags, image and is_representative.
    """
    key = F.struct(F.col("published_at").isNotNull(), "published_at", "article_id")
    order = F.array_sort(F.collect_list(F.struct(key.alias("k"), "tags", "url")))
    tags = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(order, lambda s: F.coalesce(s["tags"], F.array().cast("array<string>")))), lambda x: F.trim(x)), lambda x: x != ""))
    has = F.coalesce(F.trim("image") != "", F.lit(False))
    early = -F.coalesce(F.unix_seconds(F.col("published_at").cast("timestamp")), F.lit(0))
    rank = publisher_rank(F.col("source"), F.col("url"))
    image = F.max_by("image", F.when(has, F.struct(rank, early, -F.col("article_id"))))
    rep = F.max_by("image", F.when(F.col("is_representative"), F.lit(1)))
    return members.groupBy("cluster_id").agg(F.nullif(F.array_join(tags, "|"), F.lit("")).alias("tags"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.array_join(F.transform(order, lambda s: s["url"]), "|").alias("source_urls"), F.coalesce(image, rep).alias("image"))


def representative(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, article_id: the stored one if still a member, else the earliest (no date last)."""
    joined = members.join(clusters.select("cluster_id", "representative_id"), "cluster_id", "left")
    order = F.struct(F.coalesce(F.col("article_id") != F.col("representative_id"), F.lit(True)), F.col("published_at").isNull(), "published_at", "created_at", "article_id")
    return joined.groupBy("cluster_id").agg(F.min_by("article_id", order).alias("article_id"))


def story_rows(clusters: DataFrame, members: DataFrame, answers: DataFrame, ids: Column, now: Column) -> DataFrame:
    """One published row for each rewritten cluster of ``answers`` (cluster_id, r: a coerced second-stage result).

    Title, texts, scope, category and priority are the answer's; address, source, author,
    language and dates are the representative's; tags, sources, addresses and image are the
    members' together. ``ids`` makes the story's id of the cluster's columns.
    """
    rep = representative(clusters, members).join(members.select("cluster_id", "article_id", "url", "source", *[c for c in ("author", "language", "scraped_at") if c in members.columns], "published_at"), ["cluster_id", "article_id"]).drop("article_id")
    marked = members.join(representative(clusters, members).select("cluster_id", F.col("article_id").alias("__rep")), "cluster_id").withColumn("is_representative", F.col("article_id") == F.col("__rep")).drop("__rep")
    both = answers.where(F.col("r.action") == "rewrite").join(rep, "cluster_id").join(story_aggregates(marked).withColumnRenamed("sources", "all_sources"), "cluster_id")
    r = F.col("r")
    return both.withColumn("id", ids).select(
        "id", "cluster_id", F.coalesce(r["title"], F.lit("")).alias("title"), story_slug(F.coalesce(F.nullif(r["title"], F.lit("")), F.lit("story")), F.col("id")).alias("slug"), r["summary"].alias("summary"), r["body"].alias("body"),
        "url", "source", *[c for c in ("author", "language", "scraped_at") if c in members.columns], "image", "tags", r["scope"].alias("scope"), r["category"].alias("category"), F.coalesce(r["priority"], F.lit(0)).alias("priority"),
        "published_at", "source_urls", F.col("all_sources").alias("sources"), now.alias("synthesized_at"),
    )


def two_stages(clusters: DataFrame, members: DataFrame, known: DataFrame, first_fn: Callable[[list[str]], list[str]], second_fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """cluster_id, outcome, r (the second stage's coerced result), drop_reason for every cluster.

    A cluster that isn't ready, or all of whose addresses are ``known`` (url), is skipped. The
    first model sees titles of unseen members and keeps or drops; only what it keeps reaches
    the second, which rewrites or drops. Each stage's answers are written, so a model is asked
    once for a cluster.
    """
    ready = clusters.where("status = 'ready_for_llm'").select("cluster_id", "scope")
    left = written(unseen(members.join(ready.select("cluster_id"), "cluster_id", "left_semi"), known), "unseen")
    first = written(run_model(classify_payload(left), first_fn), "first").select("cluster_id", coerce_classify(json_object(F.col("answer"))).alias("first"))
    kept = first.where(classify_error(F.col("first")).isNull() & (F.col("first.action") == "keep")).select("cluster_id")
    payloads = rewrite_payload(ready.join(kept, "cluster_id", "left_semi"), left.join(kept, "cluster_id", "left_semi"))
    second = written(run_model(payloads, second_fn), "second").select("cluster_id", coerce_rewrite(json_object(F.col("answer"))).alias("r"))
    out = clusters.select("cluster_id").join(first, "cluster_id", "left").join(second, "cluster_id", "left")
    return out.select("cluster_id", outcome(F.col("first").isNull(), F.col("first"), F.col("r")).alias("outcome"), "r", F.coalesce(F.col("first.drop_reason"), F.col("r.drop_reason")).alias("drop_reason"))


def settle(clusters: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``clusters`` with status synthesized where the outcome is anything but failed."""
    done = outcomes.where("outcome <> 'failed'").select("cluster_id", F.lit("synthesized").alias("__done"))
    return clusters.join(done, "cluster_id", "left").withColumn("status", F.coalesce("__done", "status")).drop("__done")
