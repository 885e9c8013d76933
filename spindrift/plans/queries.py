"""Registered queries: each operator over the given tables, with DuckDB SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text, times, urls
from ..operators import clusters, embedding, exports, extract, feeds, handoff, quota, reports, retention, similarity, text_join, upsert
from ..sources.readers import union_sources
from ..sources.tables import table, written
from ..streaming.streams import ready_sessions
from . import adapters as A

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SITE = "https://news.example.com"
RULES = {"cross": 0.25, "same": 0.32}
MERGE = clusters.MergeRules(centroid=0.35, pair=0.45, soft=0.30)
NOW_SQL = "TIMESTAMP '2024-01-31'"


def query(sql: str | None = None):
    """Register a query, with its oracle where SQL can express it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def now():
    return A.ts(A.NOW)


# ---- text, addresses, times

NORM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
EMB = f"concat_ws(chr(10), CASE WHEN title <> '' THEN {NORM.format('title')} END, CASE WHEN summary <> '' THEN {NORM.format('summary')} END, CASE WHEN body <> '' THEN substr({NORM.format('body')}, 1, 800) END)"
TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")))"


@query(f"WITH {A.ARTICLES} SELECT article_id, sha256({EMB}) AS content_hash, length({EMB}) AS n FROM articles")
def content_hash(spark, d):
    a = A.articles(spark, d)
    cols = (F.col("title"), F.col("summary"), F.col("body"))
    return a.select("article_id", text.content_hash(*cols).alias("content_hash"), F.length(text.embedding_text(*cols)).cast("long").alias("n"))


@query(
    f"WITH {A.ARTICLES} SELECT article_id, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: {NORM.format('x')}), lambda x: x <> ''), chr(10)) AS body, {NORM.format('title')} AS title FROM articles"
)
def clean_text(spark, d):
    return A.articles(spark, d).select("article_id", text.clean_body(F.col("body")).alias("body"), text.normalize_whitespace(F.col("title")).alias("title"))


@query(
    "SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(list_transform(t, lambda x: trim(x)), lambda x: x <> '')), lambda x: printf('%05d', list_position(list_transform(t, lambda y: trim(y)), x)) || x)), lambda x: substr(x, 6)), '|') AS tags FROM (SELECT doc_id, string_split(split_part(text, chr(10), 1), ' ') AS t FROM documents)"
)
def tags_clean(spark, d):
    tags = F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " ")
    return table(spark, d, "documents").select("doc_id", F.array_join(text.clean_tags(tags), "|").alias("tags"))


SLUG = "coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N}\\p{M}\\p{Pc}\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', ''), ''), 'story')"


@query(f"WITH {A.ARTICLES} SELECT article_id, {SLUG} || '-' || substr(md5(url), 1, 6) AS slug FROM articles")
def slug(spark, d):
    return A.articles(spark, d).select("article_id", text.story_slug(F.col("title"), F.md5("url")).alias("slug"))


@query(f"WITH {A.ARTICLES} SELECT article_id, CAST(len({TOKENS.format('title')}) AS INTEGER) AS n, array_to_string(list_sort({TOKENS.format('title')}), ' ') AS tokens FROM articles")
def title_tokens(spark, d):
    t = text.title_tokens(F.col("title"))
    return A.articles(spark, d).select("article_id", F.size(t).alias("n"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@query(
    f"""WITH {A.ARTICLES}, t AS (SELECT article_id, language, {TOKENS.format('title')} AS t FROM articles), e AS (SELECT article_id, language, t, unnest(t) AS w FROM t)
SELECT DISTINCT a.article_id AS a, b.article_id AS b, CAST(len(list_intersect(a.t, b.t)) AS INTEGER) AS shared, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 4) AS jaccard
FROM e a JOIN e b ON a.w = b.w AND a.language = b.language AND a.article_id < b.article_id
WHERE len(list_intersect(a.t, b.t)) >= 2 AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.35"""
)
def title_jaccard_pairs(spark, d):
    """Pairs of titles of one language with Jaccard of at least 0.35: met by their rarest tokens
    only (prefix filter), so a frequent token pairs nobody by itself."""
    titles = A.articles(spark, d).select("article_id", "language", text.title_tokens(F.col("title")).alias("t"))
    return text_join.similar_token_sets(titles, "article_id", "language", "t", least=0.35, shared=2).select("a", "b", "shared", F.round("jaccard", 4).alias("jaccard"))


@query("SELECT page_id, rtrim(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS url FROM pages")
def url_normal(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query(
    """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, s || '://' || h || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN f = '' THEN '' ELSE '?' || f END AS url
FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|mc_cid|mc_eid)'))), '&') AS f FROM p)"""
)
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


CANON = """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
canon AS (SELECT page_id, s || '://' || h || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN f = '' THEN '' ELSE '?' || f END AS url
FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|mc_cid|mc_eid)'))), '&') AS f FROM p))"""


@query(f"""{CANON}, h AS (SELECT page_id, sha1(unhex('{urls.URL_NAMESPACE}') || encode(url)) AS h FROM canon)
SELECT page_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], ['8', '9', 'a', 'b'][CAST((instr('0123456789abcdef', h[17:17]) - 1) % 4 AS INTEGER) + 1] || h[18:20], h[21:32]) AS id FROM h""")
def url_ids(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_id(F.col("url")).alias("id"))


@query("""SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') AS host, CAST(CASE WHEN page_id % 4 = 0 THEN 3 WHEN page_id % 4 = 1 THEN 2 ELSE 0 END AS INTEGER) AS rank FROM pages""")
def publisher_ranks(spark, d):
    name = F.when(F.col("page_id") % 4 == 0, " The Indian Express").when(F.col("page_id") % 4 == 1, "TOI").when(F.col("page_id") % 4 == 2, "other")
    return table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.publisher_rank(name, F.col("url")).alias("rank"))


@query(f"WITH {A.ARTICLES} SELECT article_id, strftime(published_at + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS iso, published_at AS parsed FROM articles")
def time_round_trip(spark, d):
    """IST text of a date, and that text parsed again."""
    iso = times.ist_iso(F.col("published_at"))
    return A.articles(spark, d).select("article_id", iso.alias("iso"), times.parse_datetime(iso).alias("parsed"))


@query(
    f"""WITH {A.ARTICLES}, t AS (SELECT article_id, published_at AS p, date_diff('second', published_at, {NOW_SQL}) AS s FROM articles)
SELECT article_id, CASE WHEN p IS NULL THEN NULL WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 7 * 86400 THEN (s // 86400) || 'd ago' ELSE strftime(p + INTERVAL 330 MINUTE, '%-d %b %Y') END AS label FROM t"""
)
def relative_age(spark, d):
    return A.articles(spark, d).select("article_id", F.when(F.col("published_at").isNotNull(), times.relative_label(F.col("published_at"), now())).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN rtrim(substr(text, 1, 159), ' ') || '…' ELSE text END AS short, replace(replace(replace(replace(replace(split_part(text, chr(10), 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM documents")
def truncate_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"), text.escape_xml(F.split_part("text", F.lit("\n"), F.lit(1))).alias("xml"))


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'tamil_nadu' WHEN 1 THEN ' India ' WHEN 2 THEN 'WORLD' WHEN 3 THEN 'Goa' WHEN 4 THEN '' END AS s, CASE event_id % 5 WHEN 0 THEN 'Foreign Affairs' WHEN 1 THEN 'law' WHEN 2 THEN 'tech' WHEN 3 THEN 'gossip' END AS c FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Tamil Nadu' WHEN 1 THEN 'India' WHEN 2 THEN 'World' WHEN 3 THEN 'Goa' END AS scope, CASE event_id % 5 WHEN 0 THEN 'politics' WHEN 1 THEN 'courts' WHEN 2 THEN 'tech' END AS category, CASE event_id % 6 WHEN 0 THEN 'tamil-nadu' WHEN 1 THEN 'india' WHEN 2 THEN 'world' END AS path FROM t"""
)
def scope_category(spark, d):
    i = F.col("event_id")
    s = F.when(i % 6 == 0, "tamil_nadu").when(i % 6 == 1, " India ").when(i % 6 == 2, "WORLD").when(i % 6 == 3, "Goa").when(i % 6 == 4, "")
    c = F.when(i % 5 == 0, "Foreign Affairs").when(i % 5 == 1, "law").when(i % 5 == 2, "tech").when(i % 5 == 3, "gossip")
    scope = labels.normalize_scope(s)
    return table(spark, d, "events").select("event_id", scope.alias("scope"), labels.normalize_category(c).alias("category"), labels.scope_path(scope).alias("path"))


@query("SELECT page_id, 'https://img.example.com/' || page_id || CASE WHEN page_id % 3 = 0 THEN '/large.jpg' ELSE '/two.jpg' END AS image FROM pages")
def srcset_pick(spark, d):
    i = F.col("page_id").cast("string")
    large = F.when(F.col("page_id") % 3 == 0, "5000w").otherwise("1200w")
    srcset = F.concat(F.lit("//img.example.com/"), i, F.lit("/small.jpg 320w, //img.example.com/"), i, F.lit("/two.jpg 2x, https://img.example.com/"), i, F.lit("/large.jpg "), large, F.lit(", //img.example.com/"), i, F.lit("/none.jpg"))
    return table(spark, d, "pages").select("page_id", urls.best_of_srcset(srcset).alias("image"))


@query("SELECT doc_id, rtrim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text || ' Stay updated with the latest news Download the TOI App' ELSE text END, '(?s)(Stay updated with the latest|You Can Also Check:).*$', ''), E' \\n\\t\\r') AS body FROM documents")
def promo_trim(spark, d):
    body = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" Stay updated with the latest news Download the TOI App"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.trim_promo(body, text.PROMO_MARKERS).alias("body"))


# ---- filters, dedup, quotas


@query(f"WITH {A.ARTICLES} SELECT article_id FROM articles WHERE {NOW_SQL} - published_at <= INTERVAL 240 HOUR")
def freshness_filter(spark, d):
    return quota.freshness(A.articles(spark, d), "published_at", now(), 240).select("article_id")


@query("SELECT url, min(page_id) AS page_id FROM (SELECT page_id, rtrim(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS url FROM pages) GROUP BY url")
def dedup_url(spark, d):
    return quota.dedup_first(table(spark, d, "pages").select("page_id", "url"), "url", "page_id")


@query(f"WITH {A.ARTICLES}, h AS (SELECT article_id, sha256({EMB}) AS content_hash FROM articles) SELECT content_hash, min(article_id) AS first, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, d):
    h = A.articles(spark, d).select("article_id", text.content_hash(F.col("title"), F.col("summary"), F.col("body")).alias("content_hash"))
    return quota.same_content(h, "content_hash", "article_id")


CLASSED = f"{A.ENCOUNTERS}, classed AS (SELECT *, CASE WHEN published_at IS NULL THEN 'unknown' WHEN {NOW_SQL} - published_at <= INTERVAL 240 HOUR THEN 'fresh' ELSE 'stale' END AS class FROM encounters)"


def _classed(spark, d):
    return quota.classify(A.encounters(spark, d), "published_at", now(), 240)


@query(f"WITH {CLASSED} SELECT scope, count(*) FILTER (class = 'fresh') AS fresh, count(*) FILTER (class = 'stale') AS stale, count(*) FILTER (class = 'unknown') AS unknown, round(count(*) FILTER (class <> 'fresh') / count(*), 6) AS stale_ratio FROM classed GROUP BY scope")
def scope_report(spark, d):
    return quota.scope_summary(_classed(spark, d), "scope").withColumn("stale_ratio", F.round("stale_ratio", 6))


QUOTA = f"""WITH {CLASSED}, run AS (SELECT *, count(*) FILTER (class = 'fresh') OVER w AS fresh, count(*) OVER w AS seen FROM classed WINDOW w AS (PARTITION BY scope ORDER BY pos)),
why AS (SELECT *, CASE WHEN fresh >= 300 THEN 'max_total' WHEN seen >= 100 AND (seen - fresh) / seen > 0.75 THEN 'ratio' END AS why FROM run), stop AS (SELECT scope, min(pos) AS stop, arg_min(why, pos) AS stop_reason FROM why WHERE why IS NOT NULL GROUP BY scope)"""


@query(f"{QUOTA} SELECT scope, pos, class = 'fresh' AS kept, stop_reason FROM why LEFT JOIN stop USING (scope) WHERE stop IS NULL OR pos <= stop")
def quota_cutoff(spark, d):
    return quota.quota_cutoff(_classed(spark, d), ["scope"], "pos", max_total=300, min_check=100, max_ratio=0.75).select("scope", "pos", "kept", "stop_reason")


@query(f"{QUOTA} SELECT 'events' AS source, bool_and(stop IS NOT NULL) AS complete, coalesce(string_agg(stop_reason, '; ' ORDER BY scope), '') AS reasons FROM (SELECT DISTINCT scope FROM classed) LEFT JOIN stop USING (scope)")
def quota_complete(spark, d):
    cut = quota.quota_cutoff(_classed(spark, d), ["scope"], "pos", max_total=300, min_check=100, max_ratio=0.75)
    return quota.all_stopped(cut.withColumn("source", F.lit("events")), "source")


@query(f"WITH {A.ENCOUNTERS} SELECT scope, count(*) AS items, count(*) FILTER ({NOW_SQL} - published_at > INTERVAL 24 HOUR) AS old FROM encounters GROUP BY scope")
def quota_legacy(spark, d):
    return quota.classify(A.encounters(spark, d), "published_at", now(), 0).groupBy("scope").agg(F.count("*").alias("items"), F.count_if("old").alias("old"))


@query(f"WITH {CLASSED}, p AS (SELECT scope, page, bool_or(class = 'fresh') AS f FROM classed GROUP BY ALL), s AS (SELECT scope, min(page) AS stop FROM p WHERE NOT f GROUP BY scope) SELECT scope, page, count(*) AS n FROM classed LEFT JOIN s USING (scope) WHERE stop IS NULL OR page <= stop GROUP BY scope, page")
def page_stop(spark, d):
    return quota.page_stop(_classed(spark, d), ["scope"], "page").groupBy("scope", "page").agg(F.count("*").alias("n"))


# ---- upserts

INCOMING = f"""{A.ARTICLES}, hashed AS (SELECT *, sha256(concat_ws(chr(10), title, body)) AS content_hash FROM articles),
incoming AS (SELECT article_id * 2 AS pos, url, CASE WHEN article_id % 5 = 0 THEN 'changed ' || title ELSE title END AS title, body, CASE WHEN article_id % 7 <> 0 THEN TIMESTAMP '2024-01-30' END AS scraped_at FROM articles WHERE article_id % 3 <> 0
  UNION ALL SELECT article_id * 2 + 1, url, title, body, TIMESTAMP '2024-01-31' FROM articles WHERE article_id % 10 = 0 AND article_id % 3 <> 0
  UNION ALL SELECT 1000000000 + article_id, url || '-new', title, body, NULL FROM articles WHERE article_id % 50 = 0),
inc AS (SELECT *, sha256(concat_ws(chr(10), title, body)) AS content_hash FROM incoming),
marked AS (SELECT i.*, coalesce(lag(i.content_hash) OVER (PARTITION BY i.url ORDER BY pos), h.content_hash) AS prior FROM inc i LEFT JOIN hashed h USING (url)),
outc AS (SELECT *, CASE WHEN prior IS NULL THEN 'created' WHEN prior = content_hash THEN 'unchanged' ELSE 'updated' END AS outcome FROM marked)"""


def _hash(df):
    return df.withColumn("content_hash", F.sha2(F.concat_ws("\n", "title", "body"), 256))


def _stored(spark, d):
    a = A.articles(spark, d).select("article_id", "url", "title", "body")
    return _hash(a.withColumn("scraped_at", A.ts("2024-01-02 00:00:00")).withColumn("cluster_id", F.col("article_id") % 10))


def _incoming(spark, d):
    a = A.articles(spark, d).select("article_id", "url", "title", "body")
    i = F.col("article_id")
    one = a.where(i % 3 != 0).select((i * 2).alias("pos"), "article_id", "url", F.when(i % 5 == 0, F.concat(F.lit("changed "), "title")).otherwise(F.col("title")).alias("title"), "body", F.when(i % 7 != 0, A.ts("2024-01-30 00:00:00")).alias("scraped_at"))
    two = a.where((i % 10 == 0) & (i % 3 != 0)).select((i * 2 + 1).alias("pos"), "article_id", "url", "title", "body", A.ts("2024-01-31 00:00:00").alias("scraped_at"))
    new = a.where(i % 50 == 0).select((i + 1_000_000_000).alias("pos"), (i + 1_000_000).alias("article_id"), F.concat("url", F.lit("-new")).alias("url"), "title", "body", F.lit(None).cast("timestamp_ntz").alias("scraped_at"))
    return _hash(one.unionByName(two).unionByName(new))


def _upsert(spark, d):
    return upsert.upsert_articles(_stored(spark, d), _incoming(spark, d), "pos")


@query(f"WITH {INCOMING} SELECT outcome, count(*) AS n FROM outc GROUP BY outcome")
def ingest_outcomes(spark, d):
    return _upsert(spark, d)[1].groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    f"""WITH {INCOMING}, ch AS (SELECT url, max(pos) AS last, arg_max(title, pos) AS title FROM outc WHERE outcome <> 'unchanged' GROUP BY url),
tch AS (SELECT o.url, arg_max(scraped_at, pos) AS t FROM outc o LEFT JOIN ch USING (url) WHERE scraped_at IS NOT NULL AND (last IS NULL OR pos >= last) GROUP BY o.url)
SELECT coalesce(h.url, ch.url) AS url, CASE WHEN ch.url IS NULL THEN h.title ELSE ch.title END AS title, CASE WHEN ch.url IS NULL THEN coalesce(t, TIMESTAMP '2024-01-02') ELSE t END AS scraped_at, h.article_id % 10 AS cluster_id
FROM hashed h FULL JOIN ch ON h.url = ch.url LEFT JOIN tch ON tch.url = coalesce(h.url, ch.url)"""
)
def upsert_result(spark, d):
    return _upsert(spark, d)[0].select("url", "title", "scraped_at", "cluster_id")


@query(f"WITH {INCOMING} SELECT DISTINCT h.article_id FROM outc o JOIN hashed h USING (url) WHERE outcome <> 'unchanged'")
def invalidated_vectors(spark, d):
    return _upsert(spark, d)[2]


@query(
    """WITH s AS (SELECT event_id % 500 AS k, max(event_id) AS v, 'old' AS note FROM events WHERE event_id % 2 = 0 GROUP BY 1), i AS (SELECT event_id % 700 AS k, max(event_id) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT coalesce(s.k, i.k) AS k, coalesce(i.v, s.v) AS v, CASE WHEN s.k IS NULL THEN 'new' ELSE 'old' END AS note FROM s FULL JOIN i ON s.k = i.k"""
)
def keyed_merge(spark, d):
    e = table(spark, d, "events")
    stored = e.where("event_id % 2 = 0").groupBy((F.col("event_id") % 500).alias("k")).agg(F.max("event_id").alias("v")).withColumn("note", F.lit("old"))
    incoming = e.where("event_id % 3 = 0").select((F.col("event_id") % 700).alias("k"), F.col("event_id").alias("v"), F.lit("new").alias("note"), F.col("event_id").alias("seq"))
    return upsert.merge_keyed(stored, incoming, "k", keep=("note",), order="seq")


# ---- vectors, neighbours, clusters


@query(f"WITH {A.ARTICLES} SELECT article_id, length({EMB}) AS n FROM articles WHERE article_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) AND trim({EMB}) <> ''")
def pending_embeddings(spark, d):
    vectors = table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("article_id"))
    return embedding.pending(A.articles(spark, d), vectors).select("article_id", F.length("text").cast("long").alias("n"))


CRC = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hexed AS (SELECT token, hex(token) AS h FROM (SELECT DISTINCT token FROM tok)), coded AS (SELECT token, list_transform(range(1, len(h), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1 AS BIGINT)) AS b FROM hexed),
crcs AS (SELECT token, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM coded, tab)"""
TODO = f"""{A.ARTICLES}, todo AS (SELECT article_id, {EMB} AS t FROM articles WHERE trim({EMB}) <> '' AND article_id NOT IN ({{have}})), tok AS (SELECT article_id, unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '')) AS token FROM todo), {CRC},
cells AS (SELECT article_id, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM tok JOIN crcs USING (token) GROUP BY ALL),
made AS (SELECT article_id, CAST(sum((i + 1) * sign(x)) AS BIGINT) AS signs, CAST(count(*) FILTER (x > 0) AS BIGINT) AS positive FROM cells GROUP BY article_id)"""


@query(f"WITH {TODO.replace('{have}', 'SELECT vec_id FROM embeddings')} SELECT article_id, 'hashed-64' AS model_name, sha256(t) AS text_hash, 64 AS dim, coalesce(signs, 0) AS signs, coalesce(positive, 0) AS positive, 1.0::DOUBLE AS norm FROM todo LEFT JOIN made USING (article_id)")
def embed_articles(spark, d):
    """Vectors of the articles that have none, with their provenance; of a vector, its signs by place and its length."""
    todo = embedding.pending(A.articles(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("article_id")))
    out = embedding.embed(todo, embedding.hashed_encoder(64), model="hashed-64", dim=64)
    v = F.col("embedding").cast("array<double>")
    signs = F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.lit(64)), lambda x, i: F.signum(x) * i), F.lit(0.0), lambda s, x: s + x).cast("long")
    return out.select("article_id", "model_name", "text_hash", "dim", signs.alias("signs"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"), F.round(similarity.dot(v, v), 4).alias("norm"))


@query(f"WITH {A.ARTICLES} SELECT vec_id AS article_id, false AS renewed FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT article_id, true FROM articles WHERE trim({EMB}) <> '' AND article_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0)")
def stale_embeddings(spark, d):
    """Vectors of another model go, and their articles are encoded anew with those that had none."""
    name = F.when(F.col("vec_id") % 3 == 0, "old-64").otherwise("hashed-64")
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("article_id"), name.alias("model_name"), "embedding")
    current = embedding.current_model(stored, "hashed-64")
    new = embedding.embed(embedding.pending(A.articles(spark, d), current), embedding.hashed_encoder(64), model="hashed-64", dim=64)
    both = current.select("article_id", "model_name", F.lit(False).alias("renewed")).unionByName(new.select("article_id", "model_name", F.lit(True).alias("renewed")))
    return embedding.current_model(both, "hashed-64").select("article_id", "renewed")


PAIRS = f"""{A.VEC_ARTICLES}, pairs AS (
  SELECT a.article_id, b.article_id AS neighbour_id, a.source AS s1, b.source AS s2, a.published_at AS p1, b.published_at AS p2, a.created_at AS c1, b.created_at AS c2, list_cosine_similarity(a.v, b.v) AS sim
  FROM vec_articles a JOIN vec_articles b ON a.scope = b.scope AND a.article_id <> b.article_id AND abs(date_diff('second', a.published_at, b.published_at)) <= 172800),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY sim DESC, neighbour_id) AS rank FROM pairs) WHERE rank <= 5)"""


@query(f"WITH {PAIRS} SELECT article_id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(sim, 4) AS similarity FROM nn")
def neighbors_topk(spark, d):
    return similarity.neighbours(A.vec_articles(spark, d)).select("article_id", "neighbour_id", "rank", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {PAIRS} SELECT article_id, neighbour_id, round(sim, 4) AS similarity FROM nn WHERE sim >= 0.3")
def neighbors_threshold(spark, d):
    return similarity.neighbours(A.vec_articles(spark, d), least=0.3).select("article_id", "neighbour_id", F.round("similarity", 4).alias("similarity"))


@query()
def neighbors_lsh(spark, d):
    return similarity.approximate_neighbours(A.vec_articles(spark, d), least=0.35).select("a", "b", F.round("similarity", 4).alias("similarity"))


ASSIGN = f"""{PAIRS}, best AS (SELECT article_id, arg_min(neighbour_id, rank) AS parent FROM nn WHERE (p2, c2, neighbour_id) < (p1, c1, article_id) AND sim >= CASE WHEN s1 = s2 THEN 0.32 ELSE 0.25 END GROUP BY article_id),
up AS (SELECT article_id, parent FROM vec_articles LEFT JOIN best USING (article_id)),
walk(article_id, cluster_id) AS (SELECT article_id, article_id FROM up UNION ALL SELECT w.article_id, u.parent FROM walk w JOIN up u ON u.article_id = w.cluster_id WHERE u.parent IS NOT NULL),
assigned AS (SELECT w.article_id, w.cluster_id FROM walk w JOIN up u ON u.article_id = w.cluster_id WHERE u.parent IS NULL)"""
ATTRS = f"""{ASSIGN}, members AS (SELECT * FROM vec_articles JOIN assigned USING (article_id)),
clusters AS (SELECT cluster_id, count(*) AS article_count, min(published_at) AS first_published_at, max(published_at) AS last_published_at, arg_min(article_id, (published_at, created_at, article_id)) AS representative_id,
  first(title ORDER BY published_at, created_at, article_id) AS title_hint, first(scope ORDER BY published_at, created_at, article_id) AS scope, 'open' AS status FROM members GROUP BY cluster_id)"""


@query(f"WITH RECURSIVE {ASSIGN} SELECT article_id, cluster_id FROM assigned")
def assign_clusters(spark, d):
    return clusters.assign(A.vec_articles(spark, d), **RULES)


def _members(spark, d):
    a = A.vec_articles(spark, d)
    return written(a.join(clusters.assign(a, **RULES), "article_id"), "members")


CLUSTER_COLUMNS = "cluster_id, article_count, first_published_at, last_published_at, representative_id, title_hint, scope, status"


@query(f"WITH RECURSIVE {ATTRS} SELECT {CLUSTER_COLUMNS} FROM clusters")
def cluster_attrs(spark, d):
    return clusters.cluster_attributes(_members(spark, d)).select(*CLUSTER_COLUMNS.split(", "))


@query(f"WITH RECURSIVE {ATTRS} SELECT cluster_id, article_id, article_count AS size FROM members JOIN clusters USING (cluster_id) WHERE article_count > 1")
def duplicate_groups(spark, d):
    return reports.duplicate_groups(_members(spark, d))


@query(f"WITH RECURSIVE {ASSIGN} SELECT (SELECT count(*) FROM vec_articles) AS examined, (SELECT count(*) FROM vec_articles) - count(*) AS skipped, count(*) FILTER (article_id = cluster_id) AS created, count(*) FILTER (article_id <> cluster_id) AS joined FROM assigned")
def stage_counts(spark, d):
    return reports.stage_counters(A.vec_articles(spark, d), _members(spark, d).select("article_id", "cluster_id"))


CENTRES = f"""{ATTRS}, unit AS (SELECT cluster_id, article_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM members), flat AS (SELECT cluster_id, unnest(u) AS x, unnest(range(64)) AS i FROM unit),
mean AS (SELECT cluster_id, list(m ORDER BY i) AS m FROM (SELECT cluster_id, i, avg(x) AS m FROM flat GROUP BY cluster_id, i) GROUP BY cluster_id), centre AS (SELECT cluster_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM mean)"""


@query(f"WITH RECURSIVE {CENTRES} SELECT cluster_id, round(c[1], 4) AS c1, round(c[64], 4) AS c64 FROM centre")
def centroids(spark, d):
    return similarity.centroids(_members(spark, d), "cluster_id").select("cluster_id", F.round(F.col("centroid")[0], 4).alias("c1"), F.round(F.col("centroid")[63], 4).alias("c64"))


CPAIRS = f"""{CENTRES}, cp AS (SELECT a.cluster_id AS a, b.cluster_id AS b, a.title_hint AS ta, b.title_hint AS tb FROM clusters a JOIN clusters b ON a.cluster_id < b.cluster_id AND a.scope = b.scope
  AND a.first_published_at - INTERVAL 48 HOUR <= b.last_published_at + INTERVAL 48 HOUR AND b.first_published_at - INTERVAL 48 HOUR <= a.last_published_at + INTERVAL 48 HOUR)"""


@query(f"WITH RECURSIVE {CPAIRS} SELECT a, b FROM cp")
def cluster_pairs(spark, d):
    return similarity.overlapping_pairs(clusters.cluster_attributes(_members(spark, d)))


MPAIR = f"{CPAIRS}, mp AS (SELECT a, b, max(list_dot_product(x.u, y.u)) AS max_pair FROM cp JOIN unit x ON x.cluster_id = a JOIN unit y ON y.cluster_id = b GROUP BY a, b)"


@query(f"WITH RECURSIVE {MPAIR} SELECT a, b, round(max_pair, 4) AS max_pair FROM mp")
def pair_max_sim(spark, d):
    m = _members(spark, d)
    return similarity.pair_similarities(clusters.cluster_attributes(m), m).select("a", "b", F.round("max_pair", 4).alias("max_pair"))


SCORES = f"""{MPAIR}, sc AS (SELECT cp.a, cp.b, list_dot_product(x.c, y.c) AS cs, max_pair AS mpv, {TOKENS.format('ta')} AS t, {TOKENS.format('tb')} AS u FROM cp JOIN mp USING (a, b) JOIN centre x ON x.cluster_id = cp.a JOIN centre y ON y.cluster_id = cp.b),
sj AS (SELECT a, b, cs, mpv, CASE WHEN len(t) > 0 AND len(u) > 0 THEN len(list_intersect(t, u)) ELSE 0 END AS shared, CASE WHEN len(t) > 0 AND len(u) > 0 THEN len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) ELSE 0 END AS j FROM sc),
edge AS (SELECT *, cs >= 0.35 AS r1, mpv >= 0.45 AS r2, cs >= 0.30 AND j >= 0.35 AND shared >= 2 AS r3 FROM sj)"""


@query(f"WITH RECURSIVE {SCORES} SELECT a, b, round(cs, 4) AS centroid_sim, round(mpv, 4) AS max_pair, round(j, 4) AS jaccard, CAST(shared AS INTEGER) AS shared_tokens, concat_ws(',', CASE WHEN r1 THEN 'centroid' END, CASE WHEN r2 THEN 'pairwise' END, CASE WHEN r3 THEN 'title_soft' END) AS reasons FROM edge WHERE r1 OR r2 OR r3")
def merge_edges(spark, d):
    m = _members(spark, d)
    s = clusters.merge_scores(clusters.cluster_attributes(m), m, MERGE).where("merge")
    return s.select("a", "b", *[F.round(c, 4).alias(c) for c in ("centroid_sim", "max_pair", "jaccard")], "shared_tokens", "reasons")


FOLD = f"""{SCORES}, lk AS (SELECT a, b FROM edge WHERE r1 OR r2 OR r3 UNION SELECT b, a FROM edge WHERE r1 OR r2 OR r3), reach(id, other) AS (SELECT cluster_id, cluster_id FROM clusters UNION SELECT r.id, lk.b FROM reach r JOIN lk ON lk.a = r.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id), surv AS (SELECT id, first_value(id) OVER (PARTITION BY component ORDER BY article_count DESC, last_published_at DESC, id) AS survivor FROM comp JOIN clusters ON cluster_id = id),
moved AS (SELECT m.* EXCLUDE (cluster_id), survivor AS cluster_id FROM members m JOIN surv ON surv.id = m.cluster_id)"""


@query(f"WITH RECURSIVE {FOLD} SELECT cluster_id, count(*) AS article_count, min(published_at) AS first_published_at, max(published_at) AS last_published_at, arg_min(article_id, (published_at, created_at, article_id)) AS representative_id FROM moved GROUP BY cluster_id")
def fold_clusters(spark, d):
    m = _members(spark, d)
    c, _, _ = clusters.merge_clusters(clusters.cluster_attributes(m), m, MERGE)
    return c.select("cluster_id", "article_count", "first_published_at", "last_published_at", "representative_id")


@query(f"WITH RECURSIVE {ATTRS} SELECT cluster_id, CASE WHEN TIMESTAMP '2024-01-08' - last_published_at >= INTERVAL 10 MINUTE THEN 'ready_for_llm' ELSE 'open' END AS status FROM clusters")
def mark_ready(spark, d):
    return clusters.mark_ready(clusters.cluster_attributes(_members(spark, d)), A.ts("2024-01-08 00:00:00")).select("cluster_id", "status")


@query(f"WITH RECURSIVE {ATTRS} SELECT CASE WHEN TIMESTAMP '2024-01-08' - last_published_at >= INTERVAL 10 MINUTE THEN 'ready_for_llm' ELSE 'open' END AS status, count(*) AS n FROM clusters GROUP BY 1")
def status_counts(spark, d):
    return reports.status_counts(clusters.mark_ready(clusters.cluster_attributes(_members(spark, d)), A.ts("2024-01-08 00:00:00")))


@query(f"WITH RECURSIVE {ATTRS} SELECT cluster_id, last_published_at FROM clusters WHERE TIMESTAMP '2024-01-08' - last_published_at >= INTERVAL 10 MINUTE ORDER BY last_published_at, cluster_id LIMIT 20")
def work_order(spark, d):
    return reports.work_order(clusters.mark_ready(clusters.cluster_attributes(_members(spark, d)), A.ts("2024-01-08 00:00:00")), 20).select("cluster_id", "last_published_at")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 HOUR THEN 0 ELSE 1 END AS n FROM (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 10 HOUR AS ready_at, count(*) AS n FROM s GROUP BY user_id, k"""
)
def ready_windows(spark, d):
    return ready_sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", quiet="10 hours")


# ---- feeds

LIVE = f"WITH {A.STORIES}, live AS (SELECT *, coalesce(published_at, created_at) AS eff FROM stories WHERE canonical_story_id IS NULL AND scope IN ('India', 'World', 'Tamil Nadu'))"
ORDER = "priority DESC, published_at DESC NULLS FIRST, id"
PATH = "CASE scope WHEN 'India' THEN 'india' WHEN 'World' THEN 'world' ELSE 'tamil-nadu' END"


@query(f"{LIVE} SELECT id, slug, priority, scope, (SELECT count(*) FROM live WHERE eff >= {NOW_SQL} - INTERVAL 24 HOUR) AS total FROM live WHERE eff >= {NOW_SQL} - INTERVAL 24 HOUR ORDER BY {ORDER} LIMIT 20")
def feed_priority(spark, d):
    return feeds.feed(A.stories(spark, d), now=now()).select("id", "slug", "priority", "scope", "total")


@query(f"{LIVE} SELECT id, eff, (SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) FROM live WHERE scope = 'India' AND category IN ('crime', 'tech', 'sports')) AS total_pages FROM live WHERE scope = 'India' AND category IN ('crime', 'tech', 'sports') ORDER BY eff DESC, id LIMIT 20 OFFSET 20")
def feed_page(spark, d):
    return feeds.feed(A.stories(spark, d), page=2, sort="latest", scope="india", categories=("crime", "tech", "sports")).select("id", feeds.effective().alias("eff"), "total_pages")


@query(f"{LIVE} SELECT id, priority FROM live WHERE CAST(eff + INTERVAL 330 MINUTE AS DATE) = DATE '2024-01-12' ORDER BY {ORDER} LIMIT 20")
def feed_day(spark, d):
    return feeds.feed(A.stories(spark, d), date="2024-01-12").select("id", "priority")


@query(f"{LIVE} SELECT DISTINCT CAST(eff + INTERVAL 330 MINUTE AS DATE) AS day FROM live WHERE CAST(eff + INTERVAL 330 MINUTE AS DATE) <> DATE '2024-01-31'")
def feed_dates(spark, d):
    return feeds.archive_dates(A.stories(spark, d), now())


@query(f"{LIVE} SELECT a.id, b.id AS related_id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY b.priority DESC, b.published_at DESC NULLS FIRST, b.id) AS INTEGER) AS rank FROM live a JOIN live b ON a.scope = b.scope AND a.id <> b.id QUALIFY rank <= 4")
def related_stories(spark, d):
    return feeds.related(A.stories(spark, d))


@query(f"WITH {A.STORIES} SELECT id FROM stories WHERE canonical_story_id IS NULL ORDER BY coalesce(published_at, created_at) DESC, id LIMIT 50")
def feed_latest(spark, d):
    return feeds.latest(A.stories(spark, d), 50).select("id")


@query(f"{LIVE} SELECT id, '/' || {PATH} || '/' || slug AS path FROM live")
def story_paths(spark, d):
    return feeds.story_paths(A.stories(spark, d))


@query(f"{LIVE} SELECT id, slug, title, summary, scope, category FROM live")
def search_index(spark, d):
    return feeds.search_index(A.stories(spark, d))


def _apart(c: str) -> str:
    return f"coalesce(list_min(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: levenshtein(t, 'edthe') / greatest(length(t), 5))), 1.0)"


@query(f"{LIVE} SELECT id, round(0.7 * {_apart('title')} + 0.3 * {_apart('summary')}, 6) AS score FROM live WHERE round(0.7 * {_apart('title')} + 0.3 * {_apart('summary')}, 6) <= 0.4 ORDER BY score, id LIMIT 12")
def fuzzy_search(spark, d):
    return feeds.search(A.stories(spark, d), "edthe").select("id", "score")


@query(f"{LIVE} SELECT id, scope, CAST(row_number() OVER w AS INTEGER) AS position, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM live WINDOW w AS (PARTITION BY scope ORDER BY {ORDER})")
def reading_queue(spark, d):
    return feeds.reading_queue(A.stories(spark, d))


def _read_log(spark, d):
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    return table(spark, d, "events").where("event_type = 'view'").join(F.broadcast(n), F.lit(True)).select("user_id", (F.col("event_id") % F.col("n")).alias("story_id"))


@query(
    f"""{LIVE}, log AS (SELECT user_id, event_id % (SELECT count(*) FROM documents) AS story_id FROM events WHERE event_type = 'view'), r AS (SELECT user_id, count(DISTINCT story_id) FILTER (story_id IN (SELECT id FROM live)) AS n_read FROM log GROUP BY user_id)
SELECT user_id, n_read, CAST(floor(100.0 * n_read / (SELECT count(*) FROM live) + 0.5) AS BIGINT) AS percent, n_read = (SELECT count(*) FROM live) AS all_read FROM r"""
)
def read_progress(spark, d):
    return feeds.read_progress(feeds.feed_rows(A.stories(spark, d)).select("id"), _read_log(spark, d))


@query(
    f"""{LIVE}, log AS (SELECT DISTINCT event_id % (SELECT count(*) FROM documents) AS id FROM events WHERE event_type = 'view' AND user_id = 7), m AS (SELECT *, id IN (SELECT id FROM log) AS is_read FROM live)
SELECT id, is_read, CAST(row_number() OVER (PARTITION BY scope ORDER BY is_read, {ORDER}) AS INTEGER) AS position FROM m"""
)
def unread_first(spark, d):
    return feeds.unread_first(feeds.feed_rows(A.stories(spark, d)), _read_log(spark, d), 7)


@query(
    f"""WITH {A.STORIES}, req AS (SELECT 'story-' || (page_id * 3) AS slug FROM pages), red AS (SELECT 'story-' || (id + (SELECT max(id) + 1 FROM stories)) AS slug, url AS source_url FROM stories WHERE id % 2 = 0)
SELECT r.slug, CASE WHEN s.id IS NOT NULL AND t.slug IS NULL THEN 'serve' WHEN s.id IS NOT NULL THEN '301' WHEN source_url IS NOT NULL THEN '302' ELSE '404' END AS action, CASE WHEN s.id IS NOT NULL THEN coalesce(t.slug, s.slug) ELSE source_url END AS target
FROM req r LEFT JOIN stories s ON s.slug = r.slug LEFT JOIN stories t ON t.id = s.canonical_story_id LEFT JOIN red ON red.slug = r.slug"""
)
def redirect_lookup(spark, d):
    s = A.stories(spark, d)
    top = s.agg((F.max("id") + 1).alias("m"))
    red = s.where("id % 2 = 0").join(F.broadcast(top), F.lit(True)).select(F.concat(F.lit("story-"), (F.col("id") + F.col("m")).cast("string")).alias("slug"), F.col("url").alias("source_url"))
    req = table(spark, d, "pages").select(F.concat(F.lit("story-"), (F.col("page_id") * 3).cast("string")).alias("slug"))
    return feeds.resolve_requests(req, s, red)


@query(
    f"""WITH {A.ARTICLES} SELECT article_id AS id, CASE WHEN article_id % 3 = 0 THEN 'hindu' WHEN article_id % 3 = 1 THEN 'indian-express' ELSE 'times-of-india' END AS publisher, CASE WHEN article_id % 2 = 0 THEN 'https://www.' || (['thehindu.com', 'indianexpress.com', 'timesofindia.com'])[CAST(article_id % 3 + 1 AS INTEGER)] || '/a' || article_id END AS url FROM articles"""
)
def publishers(spark, d):
    i = F.col("article_id")
    host = F.element_at(F.array(F.lit("thehindu.com"), F.lit("indianexpress.com"), F.lit("timesofindia.com")), (i % 3 + 1).cast("int"))
    name = F.element_at(F.array(F.lit("The Hindu"), F.lit("Indian Express"), F.lit("TOI")), (i % 3 + 1).cast("int"))
    url = F.concat(F.lit("https://www."), host, F.lit("/a"), i.cast("string"))
    s = A.articles(spark, d).select(i.alias("id"), F.array(name, F.lit("Unknown")).alias("sources"), F.when(i % 2 == 0, F.array(F.lit("https://other.example.com/x"), url)).otherwise(F.array().cast("array<string>")).alias("source_urls"))
    return feeds.story_publishers(s)


@query(f"WITH {A.ARTICLES} SELECT article_id, url || CASE WHEN article_id % 2 = 0 THEN '?utm_source=x' ELSE '/' END AS url FROM articles WHERE article_id % 4 = 0 OR article_id % 6 = 1")
def known_urls(spark, d):
    a, i = A.articles(spark, d), F.col("article_id")
    probe = a.select("article_id", F.concat("url", F.when(i % 2 == 0, "?utm_source=x").otherwise("/")).alias("url"))
    dropped = a.where(i % 4 == 0).select(urls.url_id(F.col("url")).alias("id"))
    published = a.where(i % 6 == 1).select(F.array("url").alias("source_urls"))
    return feeds.known_urls(probe, dropped, published)


@query(f"WITH {A.ARTICLES}, m AS (SELECT article_id % 20 AS cluster_id, article_id, url FROM articles WHERE article_id % 4 <> 0) SELECT cluster_id, article_id, count(*) OVER (PARTITION BY cluster_id) AS article_count FROM m")
def unseen_members(spark, d):
    a, i = A.articles(spark, d), F.col("article_id")
    return feeds.unseen(a.select((i % 20).alias("cluster_id"), "article_id", "url"), a.where(i % 4 == 0).select("url")).select("cluster_id", "article_id", "article_count")


# ---- exports

ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
LINK = f"'{SITE}/' || {PATH} || '/' || slug"


@query(f"{LIVE} SELECT id, '<item><title>' || {ESC.format('title')} || '</title><link>' || {LINK} || '</link><guid isPermaLink=\"true\">' || {LINK} || '</guid><description>' || {ESC.format("coalesce(summary, '')")} || '</description><pubDate>' || strftime(eff, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>' AS item FROM live ORDER BY eff DESC, id LIMIT 50")
def rss_items(spark, d):
    return exports.rss_items(A.stories(spark, d), SITE)


@query(f"{LIVE}, r AS (SELECT * FROM stories WHERE canonical_story_id IS NULL AND published_at >= {NOW_SQL} - INTERVAL 48 HOUR ORDER BY published_at DESC, id LIMIT 500) SELECT id, '<url><loc>' || {LINK} || '</loc><news:publication_date>' || strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') || '</news:publication_date><news:title>' || {ESC.format('title')} || '</news:title></url>' AS entry FROM r WHERE scope IN ('India', 'World', 'Tamil Nadu')")
def news_sitemap(spark, d):
    return exports.news_sitemap(A.stories(spark, d), SITE, now())


@query(f"{LIVE}, r AS (SELECT * FROM stories WHERE canonical_story_id IS NULL ORDER BY coalesce(published_at, created_at) DESC, id LIMIT 500) SELECT {LINK} AS loc, strftime(coalesce(published_at, {NOW_SQL}), '%Y-%m-%dT%H:%M:%SZ') AS last_modified FROM r WHERE scope IN ('India', 'World', 'Tamil Nadu') UNION ALL SELECT '{SITE}' || unnest(['', '/tamil-nadu', '/india', '/world', '/about', '/search']), '2024-01-31T00:00:00Z'")
def sitemap_rows(spark, d):
    return exports.sitemap(A.stories(spark, d), SITE, now())


@query(
    f"""{LIVE}, o AS (SELECT id, list_filter([['@context', 'https://schema.org'], ['@type', 'NewsArticle'], ['headline', title], ['description', summary], ['datePublished', strftime(published_at + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30'], ['articleSection', category],
['url', CASE WHEN scope IN ('India', 'World', 'Tamil Nadu') THEN {LINK} END]], lambda x: x[2] IS NOT NULL) AS f, source FROM stories)
SELECT id, '{{' || array_to_string(list_transform(f, lambda x: '"' || x[1] || '":' || CAST(to_json(x[2]) AS VARCHAR)), ',') || ',"author":{{"@type":"Organization","name":' || CAST(to_json(source) AS VARCHAR) || '}}}}' AS jsonld FROM o"""
)
def story_jsonld(spark, d):
    return exports.news_jsonld(A.stories(spark, d), SITE)


# ---- retention

CUT = f"{NOW_SQL} - INTERVAL 10 DAY"


def _no_redirects(spark):
    return spark.createDataFrame([], "story_id long, scope string, slug string, source_url string")


@query(f"WITH {A.STORIES}, gone AS (SELECT id FROM stories WHERE coalesce(published_at, created_at) < {CUT}) SELECT id, CASE WHEN canonical_story_id NOT IN (SELECT id FROM gone) THEN canonical_story_id END AS canonical_story_id FROM stories WHERE id NOT IN (SELECT id FROM gone)")
def prune_stories(spark, d):
    return retention.prune_stories(A.stories(spark, d), _no_redirects(spark), now())[0].select("id", "canonical_story_id")


@query(f"WITH {A.STORIES} SELECT id AS story_id, scope, slug, url AS source_url FROM stories WHERE coalesce(published_at, created_at) < {CUT} AND scope IS NOT NULL")
def prune_tombstones(spark, d):
    return retention.prune_stories(A.stories(spark, d), _no_redirects(spark), now())[1]


def _prunable(spark, d):
    a = A.articles(spark, d).withColumn("cluster_id", F.floor(F.col("article_id") / 3))
    c = a.groupBy("cluster_id").agg(F.min("article_id").alias("representative_id"))
    return a, table(spark, d, "embeddings").select(F.col("vec_id").alias("article_id")), c


PRUNED = f"WITH {A.ARTICLES}, a AS (SELECT *, article_id // 3 AS cluster_id FROM articles), c AS (SELECT cluster_id, min(article_id) AS representative_id FROM a GROUP BY 1), gone AS (SELECT article_id FROM a WHERE coalesce(published_at, created_at) < {CUT})"


@query(f"{PRUNED} SELECT cluster_id, CASE WHEN representative_id NOT IN (SELECT article_id FROM gone) THEN representative_id END AS representative_id FROM c WHERE cluster_id IN (SELECT cluster_id FROM a WHERE article_id NOT IN (SELECT article_id FROM gone))")
def prune_clusters(spark, d):
    return retention.prune_articles(*_prunable(spark, d), now())[2].select("cluster_id", "representative_id")


@query(f"{PRUNED} SELECT 'articles' AS store, count(*) AS before, count(*) FILTER (article_id IN (SELECT article_id FROM gone)) AS removed FROM a UNION ALL SELECT 'vectors', count(*), count(*) FILTER (vec_id IN (SELECT article_id FROM gone)) FROM embeddings UNION ALL SELECT 'events', count(*), count(*) FILTER (CAST(ts AS TIMESTAMP) < {CUT}) FROM events")
def prune_stats(spark, d):
    a, v, c = _prunable(spark, d)
    kept, left, _ = retention.prune_articles(a, v, c, now())
    e = table(spark, d, "events")
    return retention.prune_stats(articles=(a, kept), vectors=(v, left), events=(e, retention.prune_by(e, "ts", now())))


# ---- model hand-off


def _turns(spark, d):
    c = table(spark, d, "conversations")
    i = F.col("conv_id") * 100 + F.col("turn")
    return c.select(F.col("conv_id").alias("cluster_id"), i.alias("article_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.lit(None).cast("string").alias("summary"), F.col("text").alias("body"), F.col("role").alias("source"), F.concat(F.lit("https://x.example.com/"), i.cast("string")).alias("url"), A.after(minutes=F.col("turn")).alias("published_at"), A.after(minutes=F.col("turn")).alias("created_at"))


TURNS = "turns AS (SELECT conv_id AS cluster_id, conv_id * 100 + turn AS article_id, split_part(text, chr(10), 1) AS title, text AS body, role AS source, 'https://x.example.com/' || (conv_id * 100 + turn) AS url, TIMESTAMP '2024-01-01' + to_minutes(turn) AS published_at FROM conversations)"


@query(f"WITH {TURNS} SELECT cluster_id, CAST(to_json({{'titles': list(trim(title) ORDER BY published_at, article_id) FILTER (trim(title) <> '')}}) AS VARCHAR) AS payload FROM turns GROUP BY cluster_id HAVING count(*) FILTER (trim(title) <> '') > 0")
def payload_titles(spark, d):
    return handoff.classify_payload(_turns(spark, d)).where("payload <> '{\"titles\":[]}'")


@query(f"WITH {TURNS} SELECT cluster_id, CAST(to_json({{'assigned_scope': 'India', 'articles': list({{'title': title, 'summary': CAST(NULL AS VARCHAR), 'body': substr(body, 1, 800)}} ORDER BY published_at, article_id)}}) AS VARCHAR) AS payload FROM turns GROUP BY cluster_id")
def payload_rewrite(spark, d):
    t = _turns(spark, d)
    return handoff.rewrite_payload(t.select("cluster_id", F.lit("India").alias("scope")).distinct(), t)


@query(
    f"""WITH {TURNS}, p AS (SELECT cluster_id, length(CAST(to_json({{'titles': coalesce(list(trim(title) ORDER BY published_at, article_id) FILTER (trim(title) <> ''), [])}}) AS VARCHAR)) AS n FROM turns GROUP BY cluster_id)
SELECT cluster_id, CASE WHEN n % 2 = 1 THEN 'keep' ELSE 'drop' END AS action, CASE WHEN n % 2 = 0 THEN 'length ' || n END AS drop_reason, CAST(NULL AS VARCHAR) AS error FROM p"""
)
def model_answers(spark, d):
    """A stand-in for the model over the title payloads, and what is read from its answers."""
    answers = handoff.run_model(handoff.classify_payload(_turns(spark, d)), lambda batch: [f'```json\n{{"publish": {"true" if len(x) % 2 else "false"}, "reason": "length {len(x)}"}}\n```' for x in batch])
    r = answers.select("cluster_id", handoff.coerce_classify(text.json_object(F.col("answer"))).alias("r"))
    return r.select("cluster_id", "r.action", "r.drop_reason", handoff.classify_error(F.col("r")).alias("error"))


def _answers(spark, d):
    i = F.col("doc_id")
    drop = (F.col("quality") == 0) | (F.col("toxic") == 1)
    no = F.when(i % 2 == 0, F.concat(F.lit('{"action": "Drop", "reason": "low '), i.cast("string"), F.lit('"}'))).otherwise(F.lit('{"publish": "no"}'))
    yes = F.concat(F.lit('{"action": "keep", "headline": "T'), i.cast("string"), F.lit('", "summary": "S", "article_body": "B", "scope": "tamil_nadu", "news_category": "'), F.when(i % 3 == 0, "law").when(i % 3 == 1, "Tech").otherwise("gossip"), F.lit('", "priority_points": "'), (1 + i % 120).cast("string"), F.lit('"}'))
    return table(spark, d, "labels").select("doc_id", F.when(drop, no).otherwise(yes).alias("answer"), drop.alias("is_drop"))


@query(
    """SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'drop' ELSE 'rewrite' END AS action, CASE WHEN (quality = 0 OR toxic = 1) AND doc_id % 2 = 0 THEN 'low ' || doc_id END AS drop_reason, CASE WHEN NOT (quality = 0 OR toxic = 1) THEN 'Tamil Nadu' END AS scope,
CASE WHEN NOT (quality = 0 OR toxic = 1) THEN CASE doc_id % 3 WHEN 0 THEN 'courts' WHEN 1 THEN 'tech' END END AS category, CASE WHEN NOT (quality = 0 OR toxic = 1) THEN CAST(1 + doc_id % 120 AS INTEGER) END AS priority, CASE WHEN NOT (quality = 0 OR toxic = 1) THEN 'T' || doc_id END AS title FROM labels"""
)
def coerce_synthesis(spark, d):
    r = _answers(spark, d).select("doc_id", handoff.coerce_rewrite(F.col("answer")).alias("r"))
    return r.select("doc_id", "r.action", "r.drop_reason", "r.scope", "r.category", "r.priority", "r.title")


@query("SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'drop' ELSE 'keep' END AS action, CASE WHEN (quality = 0 OR toxic = 1) AND doc_id % 2 = 0 THEN 'low ' || doc_id END AS drop_reason FROM labels")
def coerce_classify(spark, d):
    return _answers(spark, d).select("doc_id", handoff.coerce_classify(F.col("answer")).alias("r")).select("doc_id", "r.action", "r.drop_reason")


@query("SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN CASE WHEN doc_id % 2 = 1 THEN 'drop without reason' END WHEN doc_id % 3 = 2 THEN 'missing: category' WHEN 1 + doc_id % 120 > 100 THEN 'bad priority' END AS error FROM labels")
def validate_answers(spark, d):
    return _answers(spark, d).select("doc_id", handoff.rewrite_error(handoff.coerce_rewrite(F.col("answer"))).alias("error"))


OUTCOME = "CASE WHEN doc_id % 9 = 0 THEN 'skipped_existing' WHEN quality = 0 OR toxic = 1 THEN CASE WHEN doc_id % 2 = 1 THEN 'failed' ELSE 'dropped' END WHEN doc_id % 3 = 2 OR 1 + doc_id % 120 > 100 THEN 'failed' ELSE 'rewritten' END"


def _outcomes(spark, d):
    a = F.col("answer")
    return _answers(spark, d).select("doc_id", handoff.outcome(F.col("doc_id") % 9 == 0, handoff.coerce_classify(a), handoff.coerce_rewrite(a)).alias("outcome"))


@query(f"SELECT doc_id, {OUTCOME} AS outcome FROM labels")
def outcome_per_cluster(spark, d):
    return _outcomes(spark, d)


@query(f"WITH o AS (SELECT doc_id, {OUTCOME} AS outcome FROM labels), s AS (SELECT outcome, CASE doc_id % 4 WHEN 0 THEN 'India' WHEN 1 THEN 'World' WHEN 2 THEN 'Tamil Nadu' ELSE 'unknown' END AS scope_key FROM o) SELECT scope_key, count(*) AS examined, count(*) FILTER (outcome = 'rewritten') AS rewritten, count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped_existing') AS skipped_existing, round(coalesce(count(*) FILTER (outcome = 'dropped') / nullif(count(*) FILTER (outcome <> 'skipped_existing'), 0), 0.0), 4) AS drop_rate FROM s GROUP BY scope_key")
def synthesis_report(spark, d):
    i = F.col("doc_id") % 4
    return reports.synthesis_report(_outcomes(spark, d).select("outcome", F.when(i == 0, "India").when(i == 1, "World").alias("scope"), F.when(i == 2, "Tamil Nadu").alias("assigned_scope")))


def _tagged(spark, d):
    i = F.col("article_id")
    image = F.when(i % 3 == 0, F.concat(F.lit("https://img.example.com/"), i.cast("string")))
    source = F.when(i % 5 == 0, "The Hindu").when(i % 5 == 1, "TOI").when(i % 5 == 2, "Indian Express").otherwise("other")
    tags = F.array(F.concat(F.lit("t"), (i % 3).cast("string")), F.lit(" "), F.concat(F.lit(" u"), (i % 2).cast("string")))
    return A.articles(spark, d).select((i % 40).alias("cluster_id"), "article_id", "url", source.alias("source"), image.alias("image"), tags.alias("tags"), "published_at", "created_at", (i < 40).alias("is_representative"))


TAGGED = f"{A.ARTICLES}, m AS (SELECT article_id % 40 AS cluster_id, article_id, url, published_at AS p, created_at AS c, CASE article_id % 5 WHEN 0 THEN 'The Hindu' WHEN 1 THEN 'TOI' WHEN 2 THEN 'Indian Express' ELSE 'other' END AS source, CASE article_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS rank, CASE WHEN article_id % 3 = 0 THEN 'https://img.example.com/' || article_id END AS image FROM articles)"


@query(
    f"""WITH {TAGGED}, t AS (SELECT cluster_id, unnest(['t' || (article_id % 3), 'u' || (article_id % 2)]) AS tag, row_number() OVER (PARTITION BY cluster_id ORDER BY p NULLS FIRST, article_id) * 2 AS o, unnest([0, 1]) AS q FROM m), f AS (SELECT cluster_id, tag, min(o + q) AS o FROM t GROUP BY cluster_id, tag)
SELECT cluster_id, string_agg(tag, '|' ORDER BY o) AS tags FROM f GROUP BY cluster_id"""
)
def tag_union(spark, d):
    return handoff.story_aggregates(_tagged(spark, d)).select("cluster_id", "tags")


@query(f"WITH {TAGGED} SELECT cluster_id, coalesce(arg_max(image, (rank, -epoch(coalesce(p, TIMESTAMP '1970-01-01')), -article_id)) FILTER (image IS NOT NULL), max(image) FILTER (article_id < 40)) AS image, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources FROM m GROUP BY cluster_id")
def hero_image(spark, d):
    return handoff.story_aggregates(_tagged(spark, d)).select("cluster_id", "image", "sources")


@query(f"WITH {TAGGED}, r AS (SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN max(article_id) ELSE -1 END AS rep FROM m GROUP BY cluster_id) SELECT cluster_id, first(article_id ORDER BY article_id <> rep, p NULLS LAST, c, article_id) AS article_id FROM m JOIN r USING (cluster_id) GROUP BY cluster_id")
def representative(spark, d):
    m = _tagged(spark, d)
    c = m.groupBy("cluster_id").agg(F.when(F.col("cluster_id") % 2 == 0, F.max("article_id")).otherwise(-1).alias("representative_id"))
    return handoff.representative(c, m)


@query("SELECT count(*) AS items, count(*) FILTER (event_id % 7 = 0) AS drops, round(100.0 * count(*) FILTER (event_id % 7 = 0) / count(*), 2) AS drop_percent, round(count(*) / date_diff('second', CAST(min(ts) AS TIMESTAMP), CAST(max(ts) AS TIMESTAMP)), 4) AS items_per_second, round(sum(length(props)) / 1048576, 4) AS megabytes, count(*) FILTER (event_id % 4 = 0) AS responses_2xx, count(*) FILTER (event_id % 4 = 1) AS responses_3xx, count(*) FILTER (event_id % 4 = 2) AS responses_4xx, count(*) FILTER (event_id % 4 = 3) AS responses_5xx FROM events")
def crawl_report(spark, d):
    e = table(spark, d, "events")
    return reports.crawl_report(e.select((F.col("event_id") % 4 * 100 + 200).alias("status_code"), F.length("props").alias("bytes"), (F.col("event_id") % 7 == 0).alias("dropped"), F.col("ts").alias("at")))


# ---- pages

MARKUP = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"
PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {PLAIN.format(f"regexp_extract({MARKUP}, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {PLAIN.format(f"regexp_extract({MARKUP}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1 FROM pages")
def page_title_h1(spark, d):
    return extract.title_and_h1(table(spark, d, "pages"))


@query(f"WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_extract({MARKUP}, '(?is)<article[^>]*>(.*?)</article>', 1), '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: {PLAIN.format('x')}), lambda x: x <> '') AS b FROM pages) SELECT page_id, CAST(len(b) AS INTEGER) AS n, array_to_string(b, chr(10)) AS body FROM p")
def page_paragraphs(spark, d):
    return extract.paragraphs(table(spark, d, "pages"))


LINKS = f"links AS (SELECT DISTINCT page_id, CASE WHEN link LIKE '/%' THEN 'https://x.example.com' || link ELSE link END AS link FROM (SELECT page_id, unnest(regexp_extract_all({MARKUP}, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS link FROM pages) WHERE regexp_matches(link, '^(/|http)'))"


@query(f"WITH {LINKS} SELECT page_id, link FROM links")
def page_links(spark, d):
    return extract.page_links(table(spark, d, "pages"), base="https://x.example.com")


@query(f"WITH {LINKS} SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY link) AS INTEGER) AS rank FROM links WHERE link NOT LIKE '%the%' QUALIFY rank <= 3")
def bounded_links(spark, d):
    return extract.bounded_links(extract.page_links(table(spark, d, "pages"), base="https://x.example.com"), 3, ~F.contains("link", F.lit("the")))


@query(f"WITH {LINKS}, s AS (SELECT DISTINCT 'scope' || page_id % 3 AS scope, link FROM links), n AS (SELECT * FROM s WHERE link NOT IN (SELECT link FROM links WHERE page_id % 5 = 0)) SELECT scope, link, CAST(row_number() OVER (PARTITION BY scope ORDER BY link) AS INTEGER) AS rank FROM n QUALIFY rank <= 40")
def scheduled_links(spark, d):
    links = written(extract.page_links(table(spark, d, "pages"), base="https://x.example.com"), "links")
    scope = F.concat(F.lit("scope"), (F.col("page_id") % 3).cast("string"))
    scopes = links.select(scope.alias("scope")).distinct()
    every = F.array(*[F.lit(f"scope{i}") for i in range(3)])
    seen = links.where("page_id % 5 = 0").select("link").distinct().withColumn("scope", F.explode(every))
    return extract.schedule_links(links.select(scope.alias("scope"), "link", F.lit(None).cast("string").alias("self")), seen, scopes.withColumn("remaining", F.lit(40)))


@query("SELECT page_id, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang, nullif(regexp_extract(html, 'charset=\"([^\"]+)\"', 1), '') AS charset FROM pages")
def page_meta(spark, d):
    return extract.extract_meta(table(spark, d, "pages"), {"lang": ['<html lang="([a-z]+)"'], "charset": ['name="charset" content="([^"]+)"', 'charset="([^"]+)"']})


@query(
    f"""WITH l AS (SELECT page_id, regexp_extract_all({MARKUP}, '(?is)<li>(.*?)</li>', 1) AS x FROM pages), e AS (SELECT page_id, unnest(x) AS html, CAST(unnest(range(len(x))) AS INTEGER) AS pos FROM l),
v AS (SELECT page_id, pos, nullif({PLAIN.format("regexp_extract(html, 'href=\"([^\"]*)\"', 1)")}, '') AS url, nullif({PLAIN.format("regexp_extract(html, '(?is)<a[^>]*>(.*?)</a>', 1)")}, '') AS title FROM e) SELECT * FROM v WHERE contains(url, '/')"""
)
def page_listing(spark, d):
    """Menu entries of every page as listing records."""
    return extract.extract_listing(table(spark, d, "pages"), r"(?is)<li>(.*?)</li>", {"url": [r'href="([^"]*)"'], "title": [r"(?is)<a[^>]*>(.*?)</a>"]}, must="/")


@query("SELECT source, count(*) AS n, count(summary) AS with_summary FROM (SELECT 'pages' AS source, NULL AS summary FROM pages UNION ALL SELECT 'documents', nullif(split_part(text, chr(10), 2), '') FROM documents) GROUP BY source")
def all_sources(spark, d):
    a = table(spark, d, "pages").select(F.lit("pages").alias("source"), "url")
    b = A.articles(spark, d).select(F.lit("documents").alias("source"), "summary")
    return union_sources(a, b).groupBy("source").agg(F.count("*").alias("n"), F.count("summary").alias("with_summary"))
