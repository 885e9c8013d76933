"""Queries of readers, extractors, model hand-off and streams. Payloads, dumps and markup are
made by Spark from the given tables, written to the shared folder and read by the operators."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import labels, text, times, urls
from ..functions.markup import Step
from ..operators import clusters, extract, feeds, handoff, quota, reports, retention, similarity, upsert
from ..sources import readers
from ..sources.tables import new_path, table, written
from ..streaming import streams
from . import adapters as A
from .queries import FOLD, LIVE, MERGE, NOW_SQL, ORDER, PAIRS, PATH, QUOTA, RULES, SCORES, TOKENS, TURNS, _members, _outcomes, _turns, now, query

LINE = "split_part(text, chr(10), 1)"


def _line():
    return F.split_part("text", F.lit("\n"), F.lit(1))


def _filed(df, one_each: bool = False):
    """Rows of one column ``value`` as text files; with ``one_each`` a file for each row."""
    path = new_path(df.sparkSession, "payloads")
    df.write.option("maxRecordsPerFile", 1 if one_each else 0).text(path)
    return path


# ---- readers


@query(f"SELECT doc_id AS article_id, {LINE} AS title, CASE WHEN doc_id % 3 = 0 THEN 't' || doc_id WHEN doc_id % 3 = 1 THEN 'a|b' END AS tags FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0")
def article_dump(spark, d):
    """A dump in JSON Lines with broken records, records without address and tags of two kinds."""
    i = F.col("doc_id")
    url = F.when(i % 7 != 0, F.concat(F.lit("https://x.example.com/"), i.cast("string")))
    tags = F.when(i % 3 == 0, F.to_json(F.struct(url.alias("url"), _line().alias("title"), F.concat(F.lit("t"), i.cast("string")).alias("tags")))).otherwise(F.to_json(F.struct(url.alias("url"), _line().alias("title"), F.when(i % 3 == 1, F.array(F.lit("a"), F.lit("b"))).alias("tags"))))
    path = _filed(table(spark, d, "documents").select(F.when(i % 11 == 0, F.lit('[1, "x"')).otherwise(tags).alias("value")))
    good, _ = readers.read_articles(spark, path, multiline=False)
    return good.select(F.regexp_extract("url", r"/(\d+)$", 1).cast("long").alias("article_id"), "title", F.array_join("tags", "|").alias("tags"))


@query("SELECT count(*) AS rejected, count(*) FILTER (doc_id % 11 = 0) AS broken FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def article_dump_rejects(spark, d):
    i = F.col("doc_id")
    line = F.to_json(F.struct(F.when(i % 7 != 0, F.lit("https://x")).alias("url"), _line().alias("title")))
    path = _filed(table(spark, d, "documents").select(F.when(i % 11 == 0, F.lit("{oops")).otherwise(line).alias("value")))
    _, bad = readers.read_articles(spark, path, multiline=False)
    return bad.agg(F.count("*").alias("rejected"), F.count("_corrupt_record").alias("broken"))


@query(f"WITH {A.ARTICLES} SELECT count(*) AS n, count(summary) AS n_summary, count(published_at) AS n_dated FROM articles")
def article_export(spark, d):
    """Articles exported as JSON Lines and read back."""
    path = new_path(spark, "export")
    a = A.articles(spark, d).select("url", "title", "summary", "body", "source", "scope", "language", times.ist_iso(F.col("published_at")).alias("published_at"))
    readers.write_articles(a, path)
    good, _ = readers.read_articles(spark, path, multiline=False)
    return good.agg(F.count("*").alias("n"), F.count("summary").alias("n_summary"), F.count(times.parse_datetime(F.col("published_at"))).alias("n_dated"))


@query("SELECT DISTINCT 'https://x.example.com/articleshow/' || doc_id // 2 AS url, 'h' || doc_id // 2 AS title, 'India' AS scope FROM documents WHERE doc_id % 3 <> 0")
def flat_feed(spark, d):
    """Feed payloads of fifty entries each, with repeated and foreign links."""
    i, half = F.col("doc_id"), F.floor(F.col("doc_id") / 2).cast("string")
    entry = F.struct(F.concat(F.lit(" h"), half).alias("hl"), F.lit("d").alias("des"), F.concat(F.lit("https://x.example.com"), F.when(i % 3 == 0, "/video/").otherwise("/articleshow/"), half).alias("wu"))
    pages = table(spark, d, "documents").select(F.floor(i / 50).alias("page"), entry.alias("e")).groupBy("page").agg(F.to_json(F.collect_list("e")).alias("value"))
    return readers.read_feed(spark, _filed(pages.select("value"), one_each=True), "India").select("url", "title", "scope")


@query(
    f"""SELECT 'https://x.example.com/' || doc_id AS url, trim({LINE}) AS title, '<' || doc_id || '>' || chr(10) || 'second' AS body, CASE WHEN doc_id % 4 = 0 THEN 'India' ELSE 's' || doc_id % 4 END AS scope, 'a' || doc_id AS author, 'x|y' || doc_id AS tags,
strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id) + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS published_at, CASE WHEN doc_id % 2 = 0 THEN 'https://img/' || doc_id ELSE 'k/' || doc_id END AS image FROM documents"""
)
def story_pages(spark, d):
    """Paged collection payloads of twenty stories each, read and flattened to articles."""
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    meta = lambda link: F.struct(F.lit(False).alias("promotional-message"), link.alias("linked-story-id"))
    element = lambda kind, sub, t, m: F.struct(F.lit(kind).alias("type"), F.lit(sub).alias("subtype"), t.alias("text"), m.alias("metadata"))
    none = F.lit(None).cast("string")
    cards = F.array(
        F.struct(F.array(element("text", None, F.concat(F.lit("<p>&lt;"), s, F.lit("&gt;</p><p> </p>")), meta(none)), element("text", "also-read", F.lit("<p>also</p>"), meta(none))).alias("story-elements")),
        F.struct(F.array(element("image", None, F.lit("<p>no</p>"), meta(none)), element("text", None, F.lit("<p>linked</p>"), meta(s)), element("text", None, F.lit("<p class='x'>sec<b>ond</b></p>"), meta(none))).alias("story-elements")),
    )
    story = F.struct(
        F.concat(F.lit(" "), _line()).alias("headline"), F.concat(F.lit("https://x.example.com/"), s).alias("url"), F.concat(F.lit("a"), s).alias("author-name"), (F.lit(1704067200000) + i * 60000).alias("published-at"),
        F.struct(F.when(i % 2 == 0, F.concat(F.lit("https://img/"), s)).alias("original-url")).alias("hero-image-metadata"), F.concat(F.lit("k/"), s).alias("hero-image-s3-key"),
        F.array(F.struct(F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("s"), (i % 4).cast("string"))).alias("display-name"))).alias("sections"), F.array(F.struct(F.lit(" x").alias("name")), F.struct(F.lit(" ").alias("name")), F.struct(F.concat(F.lit("y"), s).alias("name"))).alias("tags"), cards.alias("cards"),
    )
    pages = table(spark, d, "documents").select(F.floor(i / 20).alias("page"), F.struct(story.alias("story")).alias("x")).groupBy("page").agg(F.to_json(F.struct(F.collect_list("x").alias("items"))).alias("value"))
    flat = extract.flatten_stories(readers.read_story_pages(spark, _filed(pages.select("value"), one_each=True)), "paper", "India")
    return flat.select("url", "title", "body", "scope", "author", F.array_join("tags", "|").alias("tags"), "published_at", "image")


def _linked_pages(spark, d):
    """Pages with a block that doesn't parse, one of another type, and an article alone, listed or in a graph."""
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    author = F.when(i % 3 == 0, F.to_json(F.struct(F.lit("A").alias("name")))).when(i % 3 == 1, F.lit('[{"name": "A"}, {"name": "B"}]')).otherwise(F.lit('"C"'))
    image = F.when(i % 4 == 0, F.lit('{"url": "https://i/0"}')).when(i % 4 == 1, F.lit('[{"url": "https://i/1"}]')).when(i % 4 == 2, F.lit('["https://i/2"]')).otherwise(F.lit('"https://i/3"'))
    words = F.when(i % 2 == 0, F.lit('" p, q ,, r"')).otherwise(F.lit('["p", " ", "q"]'))
    fields = F.regexp_replace(F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), _line().alias("headline"), F.concat(F.lit("d"), s).alias("description"), F.lit("2024-01-02T03:04:05Z").alias("datePublished"))), r"\}$", "")
    one = F.concat(fields, F.lit(', "author": '), author, F.lit(', "image": '), image, F.lit(', "keywords": '), words, F.lit("}"))
    held = F.when(i % 5 == 0, one).when(i % 5 == 1, F.concat(F.lit('[{"@type": "WebPage"}, '), one, F.lit("]"))).otherwise(F.concat(F.lit('{"@graph": ['), one, F.lit("]}")))
    block = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    html = F.concat(F.lit("<html>"), block(F.lit("{broken")), block(F.lit('{"@type": "Organization"}')), F.when(i % 6 == 0, F.lit("")).otherwise(block(held)), F.lit("</html>"))
    return table(spark, d, "documents").select(i.alias("page_id"), html.alias("html"))


LINKED = f"""SELECT doc_id AS page_id, trim({LINE}) AS title, 'd' || doc_id AS summary, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A, B' ELSE 'C' END AS author, 'https://i/' || doc_id % 4 AS image,
CASE WHEN doc_id % 2 = 0 THEN 'p|q|r' ELSE 'p|q' END AS tags, '2024-01-02T08:34:05+05:30' AS published_at FROM documents WHERE doc_id % 6 <> 0"""


@query(LINKED)
def json_ld_articles(spark, d):
    found = extract.articles_of_json_ld(extract.json_ld(_linked_pages(spark, d)), "paper", "India")
    return found.select("page_id", "title", "summary", "author", "image", F.array_join("tags", "|").alias("tags"), "published_at")


@query(f"SELECT d.doc_id AS page_id, CASE WHEN doc_id % 2 = 0 THEN 'listed' ELSE title END AS title, CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE summary END AS summary, 'https://x/' || doc_id AS url, author FROM documents d LEFT JOIN ({LINKED}) l ON l.page_id = d.doc_id")
def listing_completed(spark, d):
    i = F.col("doc_id")
    listed = table(spark, d, "documents").select(i.alias("page_id"), F.when(i % 2 == 0, "listed").otherwise("").alias("title"), F.when(i % 3 == 0, "short").alias("summary"), F.concat(F.lit("https://x/"), i.cast("string")).alias("url"))
    found = extract.articles_of_json_ld(extract.json_ld(_linked_pages(spark, d)), "paper", "India")
    return extract.fill_from_json_ld(listed, found).select("page_id", "title", "summary", "url", "author")


@query(
    """SELECT doc_id AS page_id, 'first ' || doc_id || chr(10) || 'quoted > ' || doc_id || chr(10) || 'second' || chr(10) || 'last & least' AS body, CASE doc_id % 4 WHEN 0 THEN 'https://i/large/og' WHEN 1 THEN 'https://i/name' WHEN 2 THEN 'https://i/link' END AS image, CASE WHEN doc_id % 3 <> 0 THEN 's' || doc_id END AS summary,
'2024-01-02T08:34:05+05:30' AS published_at, 'a|b' AS tags, CASE doc_id % 3 WHEN 0 THEN 'Linked Name' WHEN 1 THEN 'Meta Name' END AS author FROM documents"""
)
def microdata_articles(spark, d):
    """Bodies in nested containers, with others of their kind inside and beside, end tags in comments and open paragraphs."""
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    image = F.when(i % 4 == 0, F.lit('<meta content="https://i/small/og" property="og:image"><meta itemprop="image" content="https://i/later">')).when(i % 4 == 1, F.lit("<meta name='og:image' content='https://i/name'>")).when(i % 4 == 2, F.lit('<link href="https://i/link" rel="image_src">')).otherwise(F.lit(""))
    who = F.when(i % 3 == 0, F.lit('<div class="author-name top"><a href="/x"> Linked  Name </a></div>')).when(i % 3 == 1, F.lit('<span itemprop="author"><meta itemprop="name" content="Meta Name"></span>')).otherwise(F.lit(""))
    about = F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('<meta itemprop="description" content="s'), s, F.lit('">')))
    inner = F.concat(F.lit("<p>first "), s, F.lit('</p><div class="x"><div data-t="a > b"><p title="</div>">quoted &gt; '), s, F.lit("</p></div><!-- </div></div> --></div><p> </p><p>sec<b>ond</b><p>last &amp; <script>'</div>'</script>least</div>"))
    body = F.concat(F.lit('<div itemprop="articleBody" class="schema"><p>alone</p></div><div class="wide body"><p>before</p><div class="schema big" itemprop="articleBody">'), inner, F.lit("<p>after</p></div><p>outside</p>"))
    html = F.concat(F.lit("<html><head>"), image, about, F.lit('<meta itemprop="datePublished" content="2024-01-02T03:04:05Z"><meta itemprop="keywords" content="a, ,b"></head><body>'), who, body, F.lit("</body></html>"))
    container = (Step("div", ("body",)), Step("div", ("schema",), (("itemprop", "articleBody"),)))
    out = extract.microdata_articles(table(spark, d, "documents").select(i.alias("page_id"), html.alias("html")), container=container, small="/small/", large="/large/")
    return out.withColumn("tags", F.array_join("tags", "|"))


@query("SELECT doc_id AS page_id, CAST(k AS INTEGER) AS pos, CASE k WHEN 0 THEN '/news/' || doc_id ELSE '/news/b' END AS url, CASE k WHEN 0 THEN 'T ' || doc_id ELSE 'B' END AS title, CASE k WHEN 0 THEN 'big.jpg' ELSE 'small.jpg' END AS image FROM documents, (VALUES (0), (2)) v(k)")
def nested_listing(spark, d):
    """Listing blocks with blocks' elements inside them, the middle one without a link that counts."""
    s = F.col("doc_id").cast("string")
    block = lambda url, title, image: F.concat(F.lit('<div class="item"><div class="picture"><div>'), F.lit(image), F.lit('</div></div><h3 class="title"><a href="'), url, F.lit('">'), title, F.lit("</a></h3></div>"))
    html = F.concat(F.lit("<main>"), block(F.concat(F.lit("/news/"), s), F.concat(F.lit("T <i>"), s, F.lit("</i>")), '<img data-original="big.jpg" src="x.jpg">'), block(F.lit("/video/1"), F.lit("A"), ""), block(F.lit("/news/b"), F.lit(" B "), "<img data-original='' src=small.jpg>"), F.lit("</main>"))
    picture = (Step("", ("picture",)), Step("img"))
    fields = {"url": [((Step("h3", ("title",)), Step("a")), "href")], "title": [((Step("h3", ("title",)), Step("a")), "text")], "image": [(picture, "data-original"), (picture, "src")]}
    return extract.listing_records(table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html")), (Step("div", ("item",)),), fields)


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://img.example.com/' || page_id || '.jpg?w=1200&auto=format%2Ccompress&fit=max' WHEN 1 THEN 'https://cdn.example.com/a%2Fb' || page_id || '.jpg?w=1200&auto=format%2Ccompress&fit=max'
WHEN 2 THEN 'https://other.example.com/x.jpg' WHEN 3 THEN NULL ELSE 'https://cdn.example.com/c%20d.jpg?w=1200&auto=format%2Ccompress&fit=max' END AS image FROM pages"""
)
def hero_addresses(spark, d):
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    original = F.when(i % 5 == 0, F.concat(F.lit("//img.example.com/"), s, F.lit(".jpg"))).when(i % 5 == 1, "https://old.example.com/y.jpg").when(i % 5 == 2, " //other.example.com/x.jpg").when(i % 5 == 3, "https://old.example.com/z.jpg")
    key = F.when(i % 5 == 1, F.concat(F.lit("/a/b"), s, F.lit(".jpg"))).when(i % 5 == 4, " c d.jpg ")
    image = urls.hero_address(original, key, image_host="img.example.com", old_host="old.example.com", base="https://cdn.example.com/")
    return table(spark, d, "pages").select("page_id", image.alias("image"))


# ---- expressions


@query("SELECT event_id, CASE WHEN event_id % 8 = 0 THEN DATE '2024-02-28' WHEN event_id % 4 = 0 THEN DATE '2024-02-29' END AS day FROM events")
def valid_dates(spark, d):
    i = F.col("event_id")
    given = F.when(i % 4 == 0, F.when(i % 8 == 0, "2024-02-28").otherwise("2024-02-29")).when(i % 4 == 1, "2023-02-29").when(i % 4 == 2, "2024-2-3").otherwise("2024-01-01x")
    return table(spark, d, "events").select("event_id", times.valid_date(given).alias("day"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'tech,crime' WHEN 1 THEN '' ELSE 'sports' END AS categories, CASE event_id % 3 WHEN 0 THEN 'India' WHEN 1 THEN 'Tamil Nadu' END AS scope FROM events")
def category_filter(spark, d):
    i = F.col("event_id")
    asked = F.when(i % 3 == 0, F.array(*map(F.lit, ("tech", "gossip", "crime", "tech")))).when(i % 3 == 1, F.array(F.lit("Tech"))).otherwise(F.array(F.lit("sports"), F.lit("sports")))
    path = F.when(i % 3 == 0, "india").when(i % 3 == 1, "tamil-nadu").otherwise("goa")
    return table(spark, d, "events").select("event_id", F.array_join(labels.category_params(asked), ",").alias("categories"), labels.scope_label(path).alias("scope"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text || chr(10) || chr(10) || ' end ', '\\n{2,}'), lambda x: trim(x, ' ')), lambda x: x <> ''), '¶') AS parts, CASE WHEN doc_id % 3 <> 0 THEN 'a, b' || doc_id END AS keywords FROM documents")
def paragraphs_keywords(spark, d):
    i = F.col("doc_id")
    tags = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.concat(F.lit("b"), i.cast("string"))))
    parts = text.paragraphs(F.concat("text", F.lit("\n\n end ")))
    return table(spark, d, "documents").select("doc_id", F.array_join(parts, "¶").alias("parts"), text.keywords(tags).alias("keywords"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN TIMESTAMP '1970-01-01' + to_milliseconds(1700000000000 + event_id * 1001) END AS at FROM events")
def epoch_times(spark, d):
    i = F.col("event_id")
    ms = F.when(i % 3 != 2, F.lit(1700000000000) + i * 1001).otherwise(F.lit(999999999999999))
    return table(spark, d, "events").select("event_id", times.from_epoch_ms(ms).alias("at"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE CAST(TIMESTAMP '2024-03-01 10:00:00' - to_minutes(CASE event_id % 6 WHEN 1 THEN 330 WHEN 2 THEN 330 WHEN 3 THEN -150 ELSE 0 END) AS TIMESTAMP) END AS at FROM events")
def parsed_times(spark, d):
    """Dates with Z, without a zone, with offsets of both forms and signs, and one that is none."""
    i = F.col("event_id")
    given = F.when(i % 6 == 0, "2024-03-01T10:00:00Z").when(i % 6 == 1, "2024-03-01T10:00:00").when(i % 6 == 2, "2024-03-01T10:00:00+05:30").when(i % 6 == 3, "2024-03-01 10:00:00-0230").when(i % 6 == 4, " 2024-03-01T10:00:00z ").otherwise("soon")
    return table(spark, d, "events").select("event_id", times.parse_datetime(given).alias("at"))


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN nullif(trim({LINE}), '') WHEN 1 THEN 'thought' WHEN 2 THEN 'x' || chr(10) || 'y' END AS answer FROM documents")
def message_texts(spark, d):
    i = F.col("doc_id")
    detail = F.array(F.struct(F.lit("reasoning.text").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("other").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("reasoning.text").alias("type"), F.lit("y").alias("text")))
    message = F.when(i % 4 == 0, F.to_json(F.struct(_line().alias("content")))).when(i % 4 == 1, F.lit('{"content": " ", "reasoning": "thought"}')).when(i % 4 == 2, F.to_json(F.struct(detail.alias("reasoning_details")))).otherwise(F.lit("{}"))
    return table(spark, d, "documents").select("doc_id", text.message_text(message).alias("answer"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS rank, CASE page_id % 4 WHEN 0 THEN 'indian-express' WHEN 1 THEN 'hindu' WHEN 2 THEN 'times-of-india' END AS publisher FROM pages")
def publisher_hosts(spark, d):
    """Publishers known by the host alone: a subdomain, a port, a user."""
    i = F.col("page_id")
    url = F.when(i % 4 == 0, "https://www.indianexpress.com/a").when(i % 4 == 1, "http://sport.thehindu.com:8080/b").when(i % 4 == 2, "https://me@timesofindia.indiatimes.com/c").otherwise("https://notthehindu.com/d")
    return table(spark, d, "pages").select("page_id", urls.publisher_rank(F.lit("somebody"), url).alias("rank"), urls.publisher_of_url(url).alias("publisher"))


# ---- feeds


@query(f"{LIVE} SELECT id, title, slug, priority, strftime(published_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS published_at, '/' || {PATH} || '/' || slug AS url, 2 AS page, greatest(1, CAST(ceil((SELECT count(*) FROM live WHERE scope = 'India') / 20.0) AS BIGINT)) AS total_pages FROM (SELECT * FROM live WHERE scope = 'India' ORDER BY {ORDER} LIMIT 20 OFFSET 20) ORDER BY {ORDER} LIMIT 7")
def feed_api(spark, d):
    return feeds.api_list(A.stories(spark, d), page=2, limit=7, scope="india").select("id", "title", "slug", "priority", "published_at", "url", "page", "total_pages")


@query(f"{LIVE} SELECT id FROM (SELECT * FROM live ORDER BY {ORDER} LIMIT 20) ORDER BY {ORDER} LIMIT 1")
def feed_api_least(spark, d):
    """A limit of nothing is one, a page before the first is the first."""
    return feeds.api_list(A.stories(spark, d), page=-3, limit=0).select("id")


@query(f"{LIVE} SELECT DISTINCT CAST(eff + INTERVAL 330 MINUTE AS DATE) AS day FROM live WHERE CAST(eff + INTERVAL 330 MINUTE AS DATE) = DATE '2024-01-12'")
def feed_chosen_date(spark, d):
    return feeds.chosen_date(A.stories(spark, d), "2024-01-12", now())


@query(f"{LIVE} SELECT id, priority FROM live ORDER BY priority DESC, published_at DESC NULLS LAST, id LIMIT 20")
def feed_dated_first(spark, d):
    return feeds.feed(A.stories(spark, d), nulls="last").select("id", "priority")


# ---- clusters


@query(f"WITH RECURSIVE {SCORES}, lk AS (SELECT a, b FROM edge WHERE r1 OR r2 OR r3 UNION SELECT b, a FROM edge WHERE r1 OR r2 OR r3), reach(id, other) AS (SELECT cluster_id, cluster_id FROM clusters UNION SELECT r.id, lk.b FROM reach r JOIN lk ON lk.a = r.other), comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id) SELECT (SELECT count(*) FROM cp) AS examined_pairs, count(*) - count(DISTINCT component) AS merged_clusters, count(DISTINCT component) AS components FROM comp")
def merge_run(spark, d):
    m = _members(spark, d)
    c = clusters.cluster_attributes(m)
    merged, _, _ = clusters.merge_clusters(c, m, MERGE)
    return clusters.merge_statistics(c, merged, similarity.overlapping_pairs(c, hours=MERGE.hours))


@query(f"WITH RECURSIVE {FOLD} SELECT 'pair' AS type, b AS from_cluster_id, a AS to_cluster_id, round(cs, 4) AS centroid_sim, round(mpv, 4) AS max_pair, round(j, 4) AS jaccard, CAST(shared AS INTEGER) AS shared_tokens, concat_ws(',', CASE WHEN r1 THEN 'centroid' END, CASE WHEN r2 THEN 'pairwise' END, CASE WHEN r3 THEN 'title_soft' END) AS reasons FROM edge WHERE r1 OR r2 OR r3 UNION ALL SELECT 'merge', id, survivor, NULL, NULL, NULL, NULL, NULL FROM surv WHERE id <> survivor")
def merge_lines(spark, d):
    """The log of a merge run: each pair that merged with its scores, each cluster that was taken in."""
    m = _members(spark, d)
    c = clusters.cluster_attributes(m)
    scores = written(clusters.merge_scores(c, m, MERGE), "scores")
    return clusters.merge_log(scores, clusters.merge_targets(c, scores), now()).drop("timestamp")


COLLAPSE = f"""{A.VEC_ARTICLES}, s AS (SELECT article_id AS id, title, scope, published_at AS p, article_id * 7 % 101 AS priority, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u, {{tokens}} AS t FROM vec_articles),
sp AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.u, b.u) AS sim, len(list_intersect(a.t, b.t)) AS shared, CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) ELSE 0 END AS j
  FROM s a JOIN s b ON a.id < b.id AND a.scope = b.scope AND abs(date_diff('second', a.p, b.p)) <= 96 * 3600),
lk AS (SELECT a, b FROM sp WHERE sim >= 0.40 OR (sim >= 0.35 AND j >= 0.35 AND shared >= 2)), le AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
reach(id, other) AS (SELECT id, id FROM s UNION SELECT r.id, le.b FROM reach r JOIN le ON le.a = r.other), comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
surv AS (SELECT comp.id, first_value(comp.id) OVER (PARTITION BY component ORDER BY priority DESC, p DESC NULLS LAST, comp.id) AS survivor FROM comp JOIN s ON s.id = comp.id)"""


def _collapse_sql(rest: str) -> str:
    return "WITH RECURSIVE " + COLLAPSE.replace("{tokens}", TOKENS.format("title")) + rest


def _vec_stories(spark, d):
    return A.vec_articles(spark, d).select(F.col("article_id").alias("id"), "title", "scope", "published_at", "embedding", (F.col("article_id") * 7 % 101).alias("priority"))


STORY_RULES = clusters.MergeRules(centroid=0.40, pair=0.40, soft=0.35)


@query(_collapse_sql(" SELECT id, nullif(survivor, id) AS canonical_story_id FROM surv"))
def story_collapse(spark, d):
    return clusters.collapse_stories(_vec_stories(spark, d), STORY_RULES)


FOLDED = """, moves AS (SELECT DISTINCT id // 2 AS a, survivor // 2 AS b FROM surv WHERE id // 2 <> survivor // 2), ml AS (SELECT a, b FROM moves UNION SELECT b, a FROM moves),
mreach(id, other) AS (SELECT a, a FROM ml UNION SELECT r.id, ml.b FROM mreach r JOIN ml ON ml.a = r.other), mc AS (SELECT id, min(other) AS component FROM mreach GROUP BY id), mt AS (SELECT component, min(b) AS target FROM moves JOIN mc ON mc.id = b GROUP BY component),
m AS (SELECT article_id, coalesce(target, article_id // 2) AS cluster_id, target IS NOT NULL AS again FROM vec_articles LEFT JOIN mc ON mc.id = article_id // 2 LEFT JOIN mt USING (component)) SELECT cluster_id, count(*) AS article_count, CASE WHEN bool_or(again) THEN 'ready_for_llm' ELSE 'open' END AS status FROM m GROUP BY cluster_id"""


@query(_collapse_sql(FOLDED))
def collapse_folded(spark, d):
    """Clusters of two articles each, after their collapsed stories' clusters were folded, by groups that share one."""
    stories = _vec_stories(spark, d).select("id", F.floor(F.col("id") / 2).alias("cluster_id"))
    members = A.vec_articles(spark, d).withColumn("cluster_id", F.floor(F.col("article_id") / 2))
    found = written(clusters.collapse_stories(_vec_stories(spark, d), STORY_RULES), "collapsed")
    return clusters.fold_for_rewriting(found, stories, members)[0].select("cluster_id", "article_count", "status")


# ---- runs one after the other

TWO_RUNS = PAIRS.replace("pairs AS (", "firsts AS (SELECT article_id FROM vec_articles WHERE article_id % 3 <> 2), pairs AS (") + """,
need AS (SELECT *, sim >= CASE WHEN s1 = s2 THEN 0.32 ELSE 0.25 END AS good FROM pairs),
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY sim DESC, neighbour_id) AS r FROM need WHERE article_id IN (FROM firsts) AND neighbour_id IN (FROM firsts)) WHERE r <= 5),
n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY sim DESC, neighbour_id) AS r FROM need WHERE article_id NOT IN (FROM firsts)) WHERE r <= 5),
best AS (SELECT article_id, arg_min(neighbour_id, r) AS parent FROM n1 WHERE good AND (p2, c2, neighbour_id) < (p1, c1, article_id) GROUP BY article_id
  UNION ALL SELECT article_id, arg_min(neighbour_id, r) FROM n2 WHERE good AND (neighbour_id IN (FROM firsts) OR (p2, c2, neighbour_id) < (p1, c1, article_id)) GROUP BY article_id),
up AS (SELECT article_id, parent FROM vec_articles LEFT JOIN best USING (article_id)),
walk(article_id, cluster_id) AS (SELECT article_id, article_id FROM up UNION ALL SELECT w.article_id, u.parent FROM walk w JOIN up u ON u.article_id = w.cluster_id WHERE u.parent IS NOT NULL)
SELECT w.article_id, w.cluster_id FROM walk w JOIN up u ON u.article_id = w.cluster_id WHERE u.parent IS NULL"""


@query(f"WITH RECURSIVE {TWO_RUNS}")
def assign_in_two_runs(spark, d):
    """Two thirds of the articles, then the rest, which is compared with the stored vectors of the first run."""
    a = A.vec_articles(spark, d)
    index = new_path(spark, "vectors")
    old = a.where("article_id % 3 <> 2")
    similarity.store_vectors(old, index, "1")
    first = written(clusters.assign(old, **RULES), "first")
    second = clusters.assign_new(a.join(first, "article_id", "left"), index, "2", **RULES)
    return first.unionByName(second)


@query()
def neighbors_listed(spark, d):
    """Pairs of similar articles by a stored index of lists, blocked by scope and time."""
    a, root = A.vec_articles(spark, d), new_path(spark, "lists")
    similarity.store_lists(a, root, lists=12, copies=3)
    return similarity.listed_neighbours(a, root, least=0.35, probes=6).select("a", "b", F.round("similarity", 4).alias("similarity"))


# ---- hand-off


@query(f"WITH {TURNS} SELECT cluster_id, CAST(to_json({{'cluster_id': cluster_id, 'scope': 'India', 'status': 'open', 'article_count': count(*), 'articles': list({{'source': source, 'title': title, 'url': url, 'summary': CAST(NULL AS VARCHAR), 'body': body, 'published_at': strftime(published_at, '%Y-%m-%dT%H:%M:%S.%g')}} ORDER BY published_at, article_id)}}) AS VARCHAR) AS payload FROM turns GROUP BY cluster_id")
def payload_cluster(spark, d):
    t = _turns(spark, d)
    return handoff.cluster_payload(clusters.cluster_attributes(t.withColumn("scope", F.lit("India"))), t)


def _first(batch):
    return [f'```json\n{{"publish": {"true" if "the" in x else "false"}, "reason": "dull"}}\n```' for x in batch]


def _second(batch):
    return ['{"action": "drop", "reason": "short"}' if len(x) < 400 else '{"action": "rewrite", "title": "T", "summary": "S", "body": "B", "scope": "India", "category": "tech", "priority": 7}' if len(x) % 2 else "sorry" for x in batch]


STAGED = f"""{TURNS}, c AS (SELECT cluster_id, cluster_id % 6 <> 0 AS ready FROM turns GROUP BY cluster_id), seen AS (SELECT * FROM turns WHERE article_id % 5 <> 0 AND cluster_id % 7 <> 0),
one AS (SELECT cluster_id, CAST(to_json({{'titles': coalesce(list(trim(title) ORDER BY published_at, article_id) FILTER (trim(title) <> ''), [])}}) AS VARCHAR) AS p FROM seen GROUP BY cluster_id),
two AS (SELECT cluster_id, length(CAST(to_json({{'assigned_scope': 'India', 'articles': list({{'title': title, 'summary': CAST(NULL AS VARCHAR), 'body': substr(body, 1, 800)}} ORDER BY published_at, article_id)}}) AS VARCHAR)) AS n FROM seen GROUP BY cluster_id),
staged AS (SELECT cluster_id, CASE WHEN NOT ready OR p IS NULL THEN 'skipped_existing' WHEN NOT contains(p, 'the') OR n < 400 THEN 'dropped' WHEN n % 2 = 1 THEN 'rewritten' ELSE 'failed' END AS outcome, CASE WHEN ready AND NOT contains(p, 'the') THEN 'dull' WHEN ready AND n < 400 THEN 'short' END AS drop_reason FROM c LEFT JOIN one USING (cluster_id) LEFT JOIN two USING (cluster_id))"""


def _staged(spark, d):
    t = _turns(spark, d)
    c = t.select("cluster_id").distinct().select("cluster_id", F.lit("India").alias("scope"), F.when(F.col("cluster_id") % 6 != 0, "ready_for_llm").otherwise("open").alias("status"))
    known = t.where((F.col("article_id") % 5 == 0) | (F.col("cluster_id") % 7 == 0)).select("url")
    return c, handoff.two_stages(c, t, known, _first, _second)


@query(f"WITH {STAGED} SELECT cluster_id, outcome, drop_reason FROM staged")
def two_stage_run(spark, d):
    return _staged(spark, d)[1].select("cluster_id", "outcome", "drop_reason")


@query(f"WITH {STAGED} SELECT count(*) AS examined, count(*) FILTER (outcome = 'rewritten') AS rewritten, count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped_existing') AS skipped_existing FROM staged")
def run_counters(spark, d):
    """Counters of a model run, taken by the write of its results."""
    seen = Observation("run")
    written(reports.observed_outcomes(_staged(spark, d)[1].select("cluster_id", "outcome"), seen), "results")
    names = ("examined", "rewritten", "dropped", "failed", "skipped_existing")
    return spark.createDataFrame([tuple(int(seen.get[n]) for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"WITH {STAGED} SELECT cluster_id, CASE WHEN outcome <> 'failed' THEN 'synthesized' ELSE 'ready_for_llm' END AS status FROM staged")
def settled_clusters(spark, d):
    return handoff.settle(*_staged(spark, d)).select("cluster_id", "status")


@query("WITH o AS (SELECT {0} AS outcome FROM labels) SELECT count(*) AS examined, count(*) FILTER (outcome = 'rewritten') AS rewritten, count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped_existing') AS skipped_existing, round(100.0 * count(*) FILTER (outcome = 'dropped') / count(*) FILTER (outcome <> 'skipped_existing'), 2) AS drop_percent, round(count(*) / 32.0, 2) AS per_second FROM o".replace("{0}", "CASE WHEN doc_id % 9 = 0 THEN 'skipped_existing' WHEN quality = 0 OR toxic = 1 THEN CASE WHEN doc_id % 2 = 1 THEN 'failed' ELSE 'dropped' END WHEN doc_id % 3 = 2 OR 1 + doc_id % 120 > 100 THEN 'failed' ELSE 'rewritten' END"))
def synthesis_totals(spark, d):
    return reports.synthesis_totals(_outcomes(spark, d), 32)


@query(
    f"""WITH {TURNS}, rep AS (SELECT cluster_id, first(url ORDER BY published_at, article_id) AS url, first(source ORDER BY published_at, article_id) AS source, string_agg(url, '|' ORDER BY published_at, article_id) AS source_urls, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources FROM turns GROUP BY cluster_id)
SELECT cluster_id, 'Title ' || cluster_id AS title, 'title-' || cluster_id || '-' || substr(md5(CAST(cluster_id AS VARCHAR)), 1, 6) AS slug, url, source, source_urls, sources, 'India' AS scope, CAST(cluster_id % 100 + 1 AS INTEGER) AS priority FROM rep WHERE cluster_id % 3 <> 0"""
)
def story_rows(spark, d):
    t = _turns(spark, d).withColumn("tags", F.array(F.lit("t"))).withColumn("image", F.lit(None).cast("string"))
    c = clusters.cluster_attributes(t.withColumn("scope", F.lit("India")))
    i = F.col("cluster_id")
    answer = F.when(i % 3 == 0, F.lit('{"action": "drop", "reason": "x"}')).otherwise(F.concat(F.lit('{"action": "rewrite", "title": "Title '), i.cast("string"), F.lit('", "summary": "S", "body": "B", "scope": "india", "category": "tech", "priority": '), (i % 100 + 1).cast("string"), F.lit("}")))
    answers = c.select("cluster_id", handoff.coerce_rewrite(answer).alias("r"))
    return handoff.story_rows(c, t, answers, F.md5(F.col("cluster_id").cast("string")), now()).select("cluster_id", "title", "slug", "url", "source", "source_urls", "sources", "scope", "priority")


# ---- retention, upserts, streams


@query("SELECT 'documents' AS store, round(sum(length(text)) / 1048576, 4) AS size_mb, round(sum(length(text)) / 1048576, 4) >= 0.5 AS due FROM documents")
def prune_gate(spark, d):
    """The size of a store and whether it is to be pruned."""
    size = table(spark, d, "documents").agg(F.round(F.sum(F.length("text")) / 1048576, 4).alias("size_mb"))
    due = retention.should_prune(size.first()["size_mb"] or 0.0, 0.5)
    return size.select(F.lit("documents").alias("store"), "size_mb", F.lit(due).alias("due"))


@query(
    f"""WITH {A.ENCOUNTERS}, classed AS (SELECT scope, pos, pos % 2 = 0 OR scope IN ('view', 'purchase') AS fresh FROM encounters), run AS (SELECT *, count(*) FILTER (fresh) OVER w AS n, count(*) OVER w AS seen FROM classed WINDOW w AS (PARTITION BY scope ORDER BY pos)),
stop AS (SELECT scope, min(pos) AS stop FROM run WHERE n >= 150 OR (seen >= 60 AND (seen - n) / seen > 0.45) GROUP BY scope) SELECT scope, pos FROM run LEFT JOIN stop USING (scope) WHERE fresh AND (stop IS NULL OR pos <= stop)"""
)
def quota_stream(spark, d):
    """The quota rule with counts kept as a stream's state."""
    source, sink = new_path(spark, "encounters"), new_path(spark, "kept")
    fresh = (F.col("pos") % 2 == 0) | F.col("scope").isin("view", "purchase")
    rows = A.encounters(spark, d).select("scope", "pos", F.when(fresh, "fresh").otherwise("stale").alias("class"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    out = streams.quota_stream(stream, max_total=150, min_check=60, max_ratio=0.45)
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query(f"WITH {QUOTA.removeprefix('WITH ').replace('(seen - fresh) / seen > 0.75', 'old / seen > 0.75').replace('count(*) OVER w AS seen', 'count(*) OVER w AS seen, count(*) FILTER (old24) OVER w AS old').replace('SELECT *, CASE WHEN published_at IS NULL', f'SELECT *, coalesce({NOW_SQL} - published_at > INTERVAL 24 HOUR, false) AS old24, CASE WHEN true THEN {chr(39)}fresh{chr(39)} WHEN published_at IS NULL')} SELECT scope, pos, stop_reason FROM why LEFT JOIN stop USING (scope) WHERE stop IS NULL OR pos <= stop")
def quota_cutoff_old(spark, d):
    """The stop rule where all count as fresh and old ones are only marked."""
    marked = quota.classify(A.encounters(spark, d), "published_at", now(), 0)
    return quota.quota_cutoff(marked, ["scope"], "pos", max_total=300, min_check=100, max_ratio=0.75).select("scope", "pos", "stop_reason")


@query(f"WITH {A.ARTICLES} SELECT source, count(*) AS n, max(title) AS title FROM articles GROUP BY source")
def stream_ingest(spark, d):
    """JSON Lines files taken up by micro-batches into a table."""
    source, sink = new_path(spark, "dump"), new_path(spark, "articles")
    readers.write_articles(A.articles(spark, d).select("url", "title", "source").repartition(3), source)
    query_ = streams.ingest_stream(streams.article_stream(spark, source), lambda batch, _: batch.select("url", "title", "source").write.mode("append").parquet(sink), new_path(spark, "state"))
    query_.awaitTermination()
    return spark.read.schema("url string, title string, source string").parquet(sink).groupBy("source").agg(F.count("*").alias("n"), F.max("title").alias("title"))


@query(f"WITH {A.ARTICLES} SELECT article_id % 50 AS k, max(article_id) AS v FROM articles GROUP BY 1")
def versioned_table(spark, d):
    """Two versions of a keyed table, the second merged from the first and what came later."""
    a = A.articles(spark, d).select((F.col("article_id") % 50).alias("k"), F.col("article_id").alias("v"))
    root = new_path(spark, "table")
    one = spark.read.parquet(readers.replace_versioned(a.where("v % 3 = 0").groupBy("k").agg(F.max("v").alias("v")), root, "1"))
    late = a.groupBy("k").agg(F.max("v").alias("v"))
    return spark.read.parquet(readers.replace_versioned(upsert.merge_keyed(one, late, "k"), root, "2")).select("k", "v")
