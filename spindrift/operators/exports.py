"""Exports of published stories: RSS, sitemaps, linked data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import scope_path
from ..functions.text import escape_xml
from ..functions.times import ist_iso
from .feeds import latest, recent_news

STATIC = ("", "/tamil-nadu", "/india", "/world", "/about", "/search")


def _link(site: str) -> Column:
    return F.concat(F.lit(site), F.lit("/"), scope_path(F.col("scope")), F.lit("/"), F.col("slug"))


def _utc(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rss_items(stories: DataFrame, site: str, n: int = 50) -> DataFrame:
    """id, item: the latest stories of legal scopes as RSS items with escaped text and UTC dates."""
    rows = latest(stories.where("slug IS NOT NULL").where(scope_path(F.col("scope")).isNotNull()), n)
    link = escape_xml(_link(site))
    date = F.date_format(F.coalesce("published_at", "created_at"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = F.concat(F.lit("<item><title>"), escape_xml(F.col("title")), F.lit("</title><link>"), link, F.lit('</link><guid isPermaLink="true">'), link, F.lit("</guid><description>"), escape_xml(F.coalesce("summary", F.lit(""))), F.lit("</description><pubDate>"), date, F.lit("</pubDate></item>"))
    return rows.select("id", item.alias("item"))


def news_sitemap(stories: DataFrame, site: str, now: Column, *, hours: int = 48, n: int = 500) -> DataFrame:
    """id, entry: stories of the last ``hours`` with slug, legal scope and date."""
    rows = recent_news(stories, now, hours=hours, n=n).where(F.col("slug").isNotNull() & scope_path(F.col("scope")).isNotNull())
    entry = F.concat(F.lit("<url><loc>"), escape_xml(_link(site)), F.lit("</loc><news:publication_date>"), _utc(F.col("published_at")), F.lit("</news:publication_date><news:title>"), escape_xml(F.col("title")), F.lit("</news:title></url>"))
    return rows.select("id", entry.alias("entry"))


def sitemap(stories: DataFrame, site: str, now: Column, n: int = 500) -> DataFrame:
    """loc, last_modified: fixed routes and the latest stories."""
    spark = stories.sparkSession
    fixed = spark.createDataFrame([(f"{site}{x}",) for x in STATIC], "loc string").select("loc", _utc(now).alias("last_modified"))
    rows = latest(stories, n).where(F.col("slug").isNotNull() & scope_path(F.col("scope")).isNotNull())
    modified = F.coalesce(*[c for c in ("synthesized_at", "published_at") if c in stories.columns], now)
    return fixed.unionByName(rows.select(_link(site).alias("loc"), _utc(modified).alias("last_modified")))


def news_jsonld(stories: DataFrame, site: str) -> DataFrame:
    """id, jsonld: a NewsArticle object per story; absent fields are left out."""
    body = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("NewsArticle").alias("@type"), F.col("title").alias("headline"), F.col("summary").alias("description"),
        ist_iso(F.col("published_at")).alias("datePublished"), F.col("category").alias("articleSection"), _link(site).alias("url"), F.struct(F.lit("Organization").alias("@type"), F.col("source").alias("name")).alias("author"),
    )
    return stories.select("id", F.to_json(body).alias("jsonld"))
