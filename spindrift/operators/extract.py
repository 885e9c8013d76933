"""Extraction from captured pages and publisher payloads: expressions, and one pass over balanced tags."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import Step, select, text_of
from ..functions.text import normalize_whitespace
from ..functions.times import from_epoch_ms, ist_iso, parse_datetime
from .ordering import positions


def markup_only(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def plain(fragment: Column) -> Column:
    """A fragment's text: tags off, the common character references decoded, white space collapsed."""
    text = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return normalize_whitespace(text)


def title_and_h1(pages: DataFrame) -> DataFrame:
    m = markup_only(F.col("html"))
    return pages.select("page_id", plain(F.regexp_extract(m, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), plain(F.regexp_extract(m, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("h1"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, n, body: closed paragraphs inside the article, one line each."""
    article = F.regexp_extract(markup_only(F.col("html")), r"(?is)<article[^>]*>(.*?)</article>", 1)
    found = F.transform(F.regexp_extract_all(article, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), plain)
    kept = F.filter(found, lambda x: x != "")
    return pages.select("page_id", F.size(kept).alias("n"), F.array_join(kept, "\n").alias("body"))


def page_links(pages: DataFrame, part: str | None = None, base: str = "") -> DataFrame:
    """page_id, link: distinct absolute links (of those that contain ``part``)."""
    hrefs = F.regexp_extract_all(markup_only(F.col("html")), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    each = pages.select("page_id", F.explode(F.array_distinct(hrefs)).alias("link")).where(F.col("link").rlike("^(/|http)"))
    if part:
        each = each.where(F.contains("link", F.lit(part)))
    return each.select("page_id", F.when(F.startswith("link", F.lit("/")), F.concat(F.lit(base), "link")).otherwise(F.col("link")).alias("link")).distinct()


def bounded_links(links: DataFrame, cap: int = 15, predicate: Column | None = None) -> DataFrame:
    """The first ``cap`` links of each page in ascending order, of those that ``predicate`` admits."""
    rows = links.where(F.col("link") != "").distinct()
    rows = rows.where(predicate) if predicate is not None else rows
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("link"))).where(F.col("rank") <= cap)


def schedule_links(links: DataFrame, seen: DataFrame, budget: DataFrame) -> DataFrame:
    """New links of each scope within its remaining budget: links (scope, link, self), seen
    (scope, link), budget (scope, remaining).

    Ranks come from a range sort (written to the shared folder), so a scope may hold any share
    of the links."""
    new = links.where(F.col("link") != F.coalesce("self", F.lit(""))).select("scope", "link").distinct().join(seen, ["scope", "link"], "left_anti")
    ranked = positions(new.where("scope IS NOT NULL"), ["scope"], [F.col("link")], "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked.join(budget, "scope").where(F.col("rank") <= F.col("remaining")).select("scope", "link", "rank")


def json_ld(pages: DataFrame) -> DataFrame:
    """page_id, ld: the first article object of a page's linked-data blocks (alone, in a list or a
    graph) whose type ends with Article; blocks that don't parse are passed over."""
    blocks = F.regexp_extract_all(F.col("html"), F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    each = pages.select("page_id", F.posexplode(blocks).alias("pos", "text")).withColumn("v", F.try_parse_json(F.trim("text"))).where("v IS NOT NULL")
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", '$["@graph"]', "array<variant>"), F.array("v"))
    one = each.select("page_id", "pos", F.posexplode(items).alias("i", "x"))
    kinds = F.coalesce(F.try_variant_get("x", '$["@type"]', "array<string>"), F.array(F.try_variant_get("x", '$["@type"]', "string")))
    good = one.where(F.exists(kinds, lambda k: F.coalesce(F.endswith(k, F.lit("Article")), F.lit(False))))
    return good.groupBy("page_id").agg(F.min_by(F.to_json("x"), F.struct("pos", "i")).alias("ld"))


def articles_of_json_ld(found: DataFrame, source: str, scope: str) -> DataFrame:
    """Article records of linked-data objects: keywords a string or a list, image and author an
    object, a list or a string; the date in IST."""
    v = F.parse_json("ld")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    names = lambda p: F.array_join(F.transform(get(p, "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$", "string"))), ", ")
    listed = F.coalesce(get("$.keywords", "array<string>"), F.split(get("$.keywords"), ","))
    tags = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")
    image = F.coalesce(get("$.image.url"), get("$.image[0].url"), get("$.image[0]"), get("$.image"))
    return found.select(
        "page_id", F.trim(get("$.headline")).alias("title"), F.trim(get("$.description")).alias("summary"), get("$.articleBody").alias("body"), tags.alias("tags"), image.alias("image"),
        F.coalesce(get("$.author.name"), names("$.author"), get("$.author")).alias("author"), ist_iso(parse_datetime(get("$.datePublished"))).alias("published_at"), F.lit(source).alias("source"), F.lit(scope).alias("scope"),
    )


def fill_from_json_ld(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Listing records (page_id, title, summary, url ...) completed by their pages' article records.

    The listing's title, summary and address stay where they aren't empty; the rest is the page's.
    """
    page = found.withColumnsRenamed({"title": "__title", "summary": "__summary"})
    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    mine = [c for c in listed.columns if c not in ("page_id", "title", "summary") and c not in page.columns]
    out = listed.select("page_id", "title", "summary", *mine).join(page, "page_id", "left")
    return out.withColumn("title", given("title", F.col("__title"))).withColumn("summary", given("summary", F.col("__summary"))).drop("__title", "__summary")


def story_body(cards: Column) -> Column:
    """Paragraph texts of a story's text elements, one line each, without links to other stories and promotions."""
    elements = F.flatten(F.transform(cards, lambda c: c["story-elements"]))
    linked = lambda m: F.coalesce(m["promotional-message"], F.lit(False)) | m["linked-story-id"].isNotNull() | m["linked-story"]["id"].isNotNull()
    texts = F.filter(elements, lambda e: (e["type"] == "text") & F.coalesce(e["subtype"] != "also-read", F.lit(True)) & ~F.coalesce(linked(e["metadata"]), F.lit(False)))
    found = F.flatten(F.transform(texts, lambda e: F.transform(F.regexp_extract_all(e["text"], F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), plain)))
    return F.array_join(F.filter(found, lambda x: x != ""), "\n")


def flatten_stories(stories: DataFrame, source: str, default_scope: str) -> DataFrame:
    """Article records of collection-API stories."""
    section = F.nullif(F.trim(F.get(F.col("sections"), 0)["display-name"]), F.lit(""))
    tags = F.filter(F.transform("tags", lambda t: F.trim(t["name"])), lambda x: x != "")
    return stories.select(
        "url", F.trim("headline").alias("title"), F.trim("subheadline").alias("summary"), story_body(F.col("cards")).alias("body"), F.lit(source).alias("source"), F.coalesce(section, F.lit(default_scope)).alias("scope"),
        F.col("`author-name`").alias("author"), tags.alias("tags"), ist_iso(from_epoch_ms(F.col("`published-at`"))).alias("published_at"), F.coalesce(F.col("`hero-image-metadata`.`original-url`"), F.col("`hero-image-s3-key`")).alias("image"),
    )


def extract_meta(pages: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """page_id and one column per field: the first of its patterns (group 1) that finds something."""
    html = F.col("html")
    return pages.select("page_id", *[F.coalesce(*[F.nullif(plain(F.regexp_extract(html, p, 1)), F.lit("")) for p in patterns]).alias(name) for name, patterns in fields.items()])


#: Where pages name their main image, in order of preference (element, attributes, value).
IMAGE_PLACES = (("meta", {"property": "og:image"}, "content"), ("meta", {"property": "og:image:url"}, "content"), ("meta", {"name": "og:image"}, "content"), ("meta", {"itemprop": "image"}, "content"), ("link", {"rel": "image_src"}, "href"))


def select_fields(pages: DataFrame, fields: dict[str, tuple[tuple[Step, ...], str]]) -> DataFrame:
    """page_id and one list column per field: what its elements hold, in order, blanks left out.

    A field is a path of steps and what to take of each element: ``text``, ``html`` (as it
    stands) or the name of an attribute. Tags are balanced, so an element with others of its
    kind inside is whole. Pages are read once for all fields.
    """
    paths = [path for path, _ in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            for x in batch.column(1):
                page = x.as_py() or ""
                texts, found = select(page, paths)
                for out, elements, (_, what) in zip(columns, found, fields.values(), strict=True):
                    values = (text_of(texts, f) if what == "text" else page[f.begin : f.end] if what == "html" else f.attributes.get(what, "").strip() for f in elements)
                    out.append([v for v in values if v])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.list_(pa.string())) for c in columns]], ["page_id", *fields])

    source = pages.select("page_id", "html")
    return source.mapInArrow(run, ", ".join([f"page_id {source.schema[0].dataType.simpleString()}", *[f"{n} array<string>" for n in fields]]))


def microdata_articles(pages: DataFrame, *, container: tuple[Step, ...], author_class: str = "author-name", small: str = "", large: str = "") -> DataFrame:
    """page_id, body, image, summary, published_at (IST), tags, author of pages with microdata.

    The body is the paragraphs within the element that the path ``container`` selects, however
    it is nested; the image the first of IMAGE_PLACES, with ``small`` in its path replaced by
    ``large``; the author a link of ``author_class``, else the name within the author's microdata.
    """
    places = {f"image{i}": ((Step(name, (), tuple(marks.items())),), value) for i, (name, marks, value) in enumerate(IMAGE_PLACES)}
    meta = lambda prop: ((Step("meta", (), (("itemprop", prop),)),), "content")
    found = select_fields(pages, {
        "body": ((*container, Step("p")), "text"), **places, "summary": meta("description"), "published": meta("datePublished"), "words": meta("keywords"),
        "linked": ((Step("", (author_class,)), Step("a")), "text"), "named": ((Step("span", (), (("itemprop", "author"),)), Step("meta", (), (("itemprop", "name"),))), "content"),
    })
    first = lambda c: F.get(F.col(c), 0)
    image = F.coalesce(*[first(c) for c in places])
    return found.select(
        "page_id", F.array_join("body", "\n").alias("body"), (F.replace(image, F.lit(small), F.lit(large)) if small else image).alias("image"), first("summary").alias("summary"), ist_iso(parse_datetime(first("published"))).alias("published_at"),
        F.filter(F.transform(F.split(first("words"), ","), lambda x: F.trim(x)), lambda x: x != "").alias("tags"), F.coalesce(first("linked"), first("named")).alias("author"),
    )


def listing_records(pages: DataFrame, block: tuple[Step, ...], fields: dict[str, list[tuple[tuple[Step, ...], str]]], must: str = "/news/") -> DataFrame:
    """One row per block of a listing, by balanced tags: page_id, pos, and for each field the first
    of its places that holds something. Kept are blocks whose ``url`` contains ``must``."""
    blocks = select_fields(pages, {"block": (block, "html")}).select("page_id", F.posexplode("block").alias("pos", "html"))
    flat = {f"{n}_{i}": place for n, places in fields.items() for i, place in enumerate(places)}
    found = select_fields(blocks.select(F.struct("page_id", "pos").alias("page_id"), "html"), flat)
    one = found.select("page_id.*", *[F.coalesce(*[F.get(F.col(f"{n}_{i}"), 0) for i in range(len(places))]).alias(n) for n, places in fields.items()])
    return one.where(F.contains("url", F.lit(must)))


def extract_listing(pages: DataFrame, block: str, fields: dict[str, list[str]], must: str = "/news/") -> DataFrame:
    """One row per listing block whose ``url`` field contains ``must``."""
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all(markup_only(F.col("html")), F.lit(block), F.lit(1))).alias("pos", "html"))
    value = lambda ps: F.coalesce(*[F.nullif(plain(F.regexp_extract("html", p, 1)), F.lit("")) for p in ps])
    return blocks.select("page_id", "pos", *[value(p).alias(n) for n, p in fields.items()]).where(F.contains("url", F.lit(must)))
