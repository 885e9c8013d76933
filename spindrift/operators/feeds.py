"""Feed queries over published stories: filters, orders, pages, dates, lookups, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import CATEGORIES, SCOPES, scope_path
from ..functions.times import ist_date, valid_date
from ..functions.urls import publisher_of, publisher_of_url
from ..sources.tables import written
from .ordering import positions

PAGE = 20


def effective() -> Column:
    return F.coalesce("published_at", "created_at")


def feed_order(sort: str = "priority", nulls: str = "first") -> list[Column]:
    """Priority then date, absent dates first unless ``nulls`` says last; or latest. Ties by id."""
    if sort == "latest":
        return [effective().desc(), F.col("id")]
    date = F.col("published_at")
    return [F.col("priority").desc(), date.desc_nulls_first() if nulls == "first" else date.desc_nulls_last(), F.col("id")]


def feed_rows(stories: DataFrame, *, scope: str | None = None, date: str | None = None, categories: tuple[str, ...] = (), now: Column | None = None, hours: int = 24) -> DataFrame:
    """Canonical stories of legal scopes: of one IST day, or of the last ``hours`` before ``now``; all without either."""
    out = stories.where(F.col("canonical_story_id").isNull() & F.col("scope").isin(list(SCOPES)))
    if scope:
        out = out.where(scope_path(F.col("scope")) == scope)
    if categories:
        out = out.where(F.col("category").isin([c for c in categories if c in CATEGORIES]))
    if date:
        return out.where(ist_date(effective()) == F.lit(date).cast("date"))
    return out.where(effective() >= now - F.make_dt_interval(F.lit(0), F.lit(hours))) if now is not None else out


def feed(stories: DataFrame, *, page: int = 1, sort: str = "priority", nulls: str = "first", size: int = PAGE, **where) -> DataFrame:
    """One page of the feed with total and total_pages on each row."""
    rows = feed_rows(stories, **where)
    total = rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    top = rows.orderBy(*feed_order(sort, nulls)).offset((page - 1) * size).limit(size)
    # one row of totals beside at most one page
    return top.join(F.broadcast(total), F.lit(True))


def api_list(stories: DataFrame, *, page: int = 1, limit: int = PAGE, **where) -> DataFrame:
    """The list an API gives: a page of PAGE rows cut to ``limit`` (held within 1 and 50), each
    with its address and the feed's page, total_pages and total.

    Pages begin at 1. ``sources`` is the array of names, where the stories have one.
    """
    page, limit = max(1, page), min(50, max(1, limit))
    rows = feed(stories, page=page, **where).orderBy(*feed_order()).limit(limit)
    path = F.concat(F.lit("/"), scope_path(F.col("scope")), F.lit("/"), F.col("slug"))
    more = ["sources"] if "sources" in stories.columns else []
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select("id", "title", "slug", "summary", "scope", "priority", at.alias("published_at"), *more, path.alias("url"), F.lit(page).alias("page"), "total_pages", "total")


def feed_dates(stories: DataFrame, **where) -> DataFrame:
    return feed_rows(stories, **where).select(ist_date(effective()).alias("day")).distinct()


def archive_dates(stories: DataFrame, now: Column, **where) -> DataFrame:
    return feed_dates(stories, **where).where(F.col("day") != ist_date(now))


def chosen_date(stories: DataFrame, day: str, now: Column, **where) -> DataFrame:
    """``day`` as one row where it is one of the archive's, else none."""
    return archive_dates(stories, now, **where).where(F.col("day") == valid_date(F.lit(day)))


def related(stories: DataFrame, n: int = 4) -> DataFrame:
    """id, related_id, rank: for every canonical story the first ``n`` others of its scope in feed order.

    The first n + 1 of each scope are all that can be needed, so the join is small.
    """
    live = feed_rows(stories)
    top = live.withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy(*feed_order()))).where(F.col("r") <= n + 1).select("scope", F.col("id").alias("related_id"), "r")
    pairs = live.select("id", "scope").join(F.broadcast(top), "scope").where("id <> related_id")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("r"))).where(F.col("rank") <= n).select("id", "related_id", "rank")


def latest(stories: DataFrame, n: int) -> DataFrame:
    return stories.where("canonical_story_id IS NULL").orderBy(effective().desc(), "id").limit(n)


def recent_news(stories: DataFrame, now: Column, *, hours: int = 48, n: int = 500) -> DataFrame:
    return stories.where(F.col("canonical_story_id").isNull() & (F.col("published_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))).orderBy(F.col("published_at").desc(), "id").limit(n)


def story_paths(stories: DataFrame) -> DataFrame:
    return feed_rows(stories).where(F.col("slug").isNotNull()).select("id", F.concat(F.lit("/"), scope_path(F.col("scope")), F.lit("/"), "slug").alias("path"))


def search_index(stories: DataFrame) -> DataFrame:
    return feed_rows(stories).select("id", "slug", "title", "summary", "scope", "category")


def _words(c: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def token_index(stories: DataFrame) -> DataFrame:
    """token, id: each token of a title once a story; to be written where many searches follow."""
    return search_index(stories).select("id", F.explode(F.array_distinct(_words("title"))).alias("token")).select("token", "id")


def search(stories: DataFrame, query: str, n: int = 12, *, index: DataFrame | None = None, most: float = 0.4) -> DataFrame:
    """Ranked fuzzy search: the best edit distance of any title and summary token to the query,
    relative to the longer one, weighted 0.7 and 0.3; at most ``most`` apart; the best n.

    The title alone decides who can be near enough. Distances are computed once for each
    distinct title token of a possible length, then for the summaries of the stories found;
    ``index`` is the written ``token_index``.
    """
    q = query.lower()
    apart = lambda t: F.levenshtein(t, F.lit(q)) / F.greatest(F.length(t), F.lit(len(q)))
    cut = most / 0.7 + 1e-6  # the score is rounded to six digits
    if cut >= 1:  # a title without any token could do, too
        near = F.coalesce(F.array_min(F.transform(_words("title"), apart)), F.lit(1.0))
        found = search_index(stories).withColumn("t", near)
    else:
        tokens = token_index(stories) if index is None else index
        possible = F.abs(F.length("token") - len(q)) <= cut * F.greatest(F.length("token"), F.lit(len(q)))
        close = tokens.where(possible).select("token").distinct().withColumn("t", apart(F.col("token"))).where(F.col("t") <= cut)
        found = search_index(stories).join(tokens.join(close, "token").groupBy("id").agg(F.min("t").alias("t")), "id")
    score = 0.7 * F.col("t") + 0.3 * F.coalesce(F.array_min(F.transform(_words("summary"), apart)), F.lit(1.0))
    return found.withColumn("score", F.round(score, 6)).drop("t").where(F.col("score") <= most).orderBy("score", "id").limit(n)


def reading_queue(stories: DataFrame, **where) -> DataFrame:
    """Feed position of each story that has a path, with the ones before and after it."""
    rows = feed_rows(stories, **where).where("slug IS NOT NULL").select("id", "scope", "priority", "published_at")
    placed = written(positions(rows, ["scope"], feed_order()).select("id", "scope", F.col("position").cast("int").alias("position")), "queue")

    def beside(name: str, step: int) -> DataFrame:
        return placed.select("scope", (F.col("position") + step).alias("position"), F.col("id").alias(name))

    return placed.join(beside("previous_id", 1), ["scope", "position"], "left").join(beside("next_id", -1), ["scope", "position"], "left").select("id", "scope", "position", "previous_id", "next_id")


def resolve_canonical(stories: DataFrame) -> DataFrame:
    """id, target_id, target_slug: the canonical story where there is one, else the story itself."""
    target = stories.select(F.col("id").alias("canonical_story_id"), F.col("slug").alias("other"))
    joined = stories.select("id", "slug", "canonical_story_id").join(target, "canonical_story_id", "left")
    return joined.select("id", F.when(F.col("other").isNotNull(), F.col("canonical_story_id")).otherwise(F.col("id")).alias("target_id"), F.coalesce("other", "slug").alias("target_slug"))


def resolve_requests(requests: DataFrame, stories: DataFrame, redirects: DataFrame) -> DataFrame:
    """slug, action, target: serve a story, 301 to its canonical one, 302 to a pruned story's source, or 404."""
    live = resolve_canonical(stories).join(stories.select("id", "slug"), "id").select("slug", "id", "target_id", "target_slug")
    out = requests.join(live, "slug", "left").join(redirects.select("slug", "source_url"), "slug", "left")
    action = F.when(F.col("id").isNotNull() & (F.col("id") == F.col("target_id")), "serve").when(F.col("id").isNotNull(), "301").when(F.col("source_url").isNotNull(), "302").otherwise("404")
    return out.select("slug", action.alias("action"), F.when(F.col("id").isNotNull(), F.col("target_slug")).otherwise(F.col("source_url")).alias("target"))


def read_progress(feed_ids: DataFrame, read_log: DataFrame) -> DataFrame:
    """Per user: stories read of the current ids, the rounded percentage, whether all are."""
    n = feed_ids.agg(F.count("*").alias("n_feed"))
    read = read_log.join(feed_ids.select(F.col("id").alias("story_id")), "story_id", "left_semi").groupBy("user_id").agg(F.count_distinct("story_id").alias("n_read"))
    users = read_log.select("user_id").distinct().join(read, "user_id", "left").select("user_id", F.coalesce("n_read", F.lit(0)).alias("n_read")).join(F.broadcast(n), F.lit(True))
    return users.select("user_id", "n_read", F.coalesce(F.floor(F.try_divide(100 * F.col("n_read"), F.col("n_feed")) + 0.5), F.lit(0)).cast("long").alias("percent"), (F.col("n_read") == F.col("n_feed")).alias("all_read"))


def unread_first(feed_ids: DataFrame, read_log: DataFrame, user: int) -> DataFrame:
    """id, is_read, position: one user's unread stories before the read ones, both in feed order."""
    mine = read_log.where(F.col("user_id") == user).select(F.col("story_id").alias("id")).distinct().withColumn("is_read", F.lit(True))
    out = feed_ids.join(mine, "id", "left").withColumn("is_read", F.coalesce("is_read", F.lit(False)))
    return positions(out.select("id", "is_read", "scope", "priority", "published_at"), ["scope"], [F.col("is_read"), *feed_order()]).select("id", "is_read", F.col("position").cast("int").alias("position"))


def story_publishers(stories: DataFrame) -> DataFrame:
    """id, publisher, url of stories (id, sources, source_urls): publishers by address first, then
    by name, each with its first address."""
    urls = stories.select("id", F.posexplode("source_urls").alias("pos", "url")).withColumn("publisher", publisher_of_url(F.col("url"))).where("publisher IS NOT NULL")
    first = urls.groupBy("id", "publisher").agg(F.min_by("url", "pos").alias("url"))
    named = stories.select("id", F.explode("sources").alias("name")).select("id", publisher_of(F.col("name")).alias("publisher")).where("publisher IS NOT NULL").distinct()
    return named.join(first, ["id", "publisher"], "full").select("id", "publisher", "url")


def known_urls(urls: DataFrame, dropped: DataFrame, stories: DataFrame) -> DataFrame:
    """``urls`` that were dropped (by canonical id) or stand in some story's source addresses."""
    from ..functions.urls import url_id

    seen = dropped.select(F.col("id").alias("uid")).unionByName(stories.select(F.explode("source_urls").alias("u")).select(url_id(F.col("u")).alias("uid"))).distinct()
    return urls.withColumn("uid", url_id(F.col("url"))).join(seen, "uid", "left_semi").drop("uid")


def unseen(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members whose address isn't known, with each cluster's new count."""
    left = members.join(known.select("url").distinct(), "url", "left_anti")
    return left.withColumn("article_count", F.count("*").over(Window.partitionBy("cluster_id")))
