"""The logical article tables over the given ones, in Spark and, for the oracle, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

T0 = "2024-01-01 00:00:00"
NOW = "2024-01-31 00:00:00"


def ts(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def after(hours=None, minutes=None):
    """T0 plus so many hours or minutes (columns of integers)."""
    zero = F.lit(0)
    return ts(T0) + F.make_dt_interval(zero, (hours if hours is not None else zero).cast("int"), (minutes if minutes is not None else zero).cast("int"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    scope = F.when(F.col("lang") == "en", "India").when(F.col("lang") == "fr", "World").when(F.col("lang") == "de", "Tamil Nadu")
    return table(spark, d, "documents").select(
        doc.alias("article_id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/"), doc.cast("string")).alias("url"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.nullif(F.split_part("text", F.lit("\n"), F.lit(2)), F.lit("")).alias("summary"),
        F.col("text").alias("body"), "source", F.col("lang").alias("language"), scope.alias("scope"),
        F.when(doc % 17 != 0, after(hours=doc * 37 % 720)).alias("published_at"), after(minutes=doc).alias("created_at"),
    )


ARTICLES = """
articles AS (
  SELECT doc_id AS article_id, 'https://' || source || '.example.com/' || doc_id AS url,
         split_part(text, chr(10), 1) AS title, nullif(split_part(text, chr(10), 2), '') AS summary, text AS body, source, lang AS language,
         CASE lang WHEN 'en' THEN 'India' WHEN 'fr' THEN 'World' WHEN 'de' THEN 'Tamil Nadu' END AS scope,
         CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id * 37 % 720) END AS published_at,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at
  FROM documents)"""


def vec_articles(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return table(spark, d, "embeddings").join(docs, "vec_id", "left").select(
        v.alias("article_id"), (F.col("label") % 3).cast("string").alias("scope"), F.concat(F.lit("s"), (v % 4).cast("string")).alias("source"), "title",
        after(hours=v * 37 % 240).alias("published_at"), after(minutes=v).alias("created_at"), "embedding",
    )


VEC_ARTICLES = """
vec_articles AS (
  SELECT vec_id AS article_id, CAST(label % 3 AS VARCHAR) AS scope, 's' || (vec_id % 4) AS source, split_part(d.text, chr(10), 1) AS title,
         TIMESTAMP '2024-01-01' + to_hours(vec_id * 37 % 240) AS published_at, TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS created_at,
         CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id)"""


def stories(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("article_id")
    cats = F.array(*[F.lit(x) for x in "politics economy crime courts tech health environment sports culture".split()])
    return articles(spark, d).select(
        i.alias("id"), "title", "summary", "url", "source", "scope", "published_at", "created_at", (i * 7 % 101).cast("int").alias("priority"), F.element_at(cats, (i % 9 + 1).cast("int")).alias("category"),
        F.when((i % 13 == 0) & (i > 0), i - 1).alias("canonical_story_id"), F.concat(F.lit("story-"), i.cast("string")).alias("slug"),
    )


STORIES = (
    ARTICLES
    + """,
stories AS (
  SELECT article_id AS id, title, summary, url, source, scope, published_at, created_at, CAST(article_id * 7 % 101 AS INTEGER) AS priority,
         (['politics','economy','crime','courts','tech','health','environment','sports','culture'])[CAST(article_id % 9 + 1 AS INTEGER)] AS category,
         CASE WHEN article_id % 13 = 0 AND article_id > 0 THEN article_id - 1 END AS canonical_story_id, 'story-' || article_id AS slug
  FROM articles)"""
)


def encounters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("scope"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("published_at"), (F.col("event_id") / 50).cast("long").alias("page"))


ENCOUNTERS = "encounters AS (SELECT event_id AS pos, event_type AS scope, CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS TIMESTAMP) END AS published_at, event_id // 50 AS page FROM events)"
