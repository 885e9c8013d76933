"""Text expressions: cleaning, hashing, slugs, title tokens, escaping, JSON out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic in a title.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the to was were will with".split()
#: Where a publisher's promotion begins at the end of a body.
PROMO_MARKERS = ("You Can Also Check:", "Stay updated with the latest", "Download the TOI App")
BODY_LIMIT = 800


def normalize_whitespace(c: Column) -> Column:
    """Any white space run to one blank, trimmed; Unicode white space counts."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_body(c: Column) -> Column:
    """Each line's white space collapsed, empty lines dropped."""
    lines = F.transform(F.split(c, r"\R"), normalize_whitespace)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_tags(tags: Column) -> Column:
    """Trimmed, not empty, each once in first order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != ""))


def tag_list(c: Column) -> Column:
    """A single tag as a list of one; null stays null."""
    return F.when(c.isNotNull(), F.array(c))


def embedding_text(title: Column, summary: Column, body: Column, limit: int = BODY_LIMIT) -> Column:
    """Title, summary and the start of the body, one line each; absent parts are skipped."""

    def part(c: Column, most: int = 0) -> Column:
        text = normalize_whitespace(c)
        return F.when(c != "", F.substring(text, 1, most) if most else text)

    return F.concat_ws("\n", part(title), part(summary), part(body, limit))


def content_hash(title: Column, summary: Column, body: Column, limit: int = BODY_LIMIT) -> Column:
    return F.sha2(embedding_text(title, summary, body, limit), 256)


def slugify(title: Column, most: int = 80) -> Column:
    """Lower case, only word characters and single hyphens, at most ``most`` long; ``story`` if nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(title)), r"(?U)[^\w\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(joined, 1, most), "-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("story"))


def story_slug(title: Column, story_id: Column) -> Column:
    """The slug with the first six hex digits of the story's id."""
    return F.concat(slugify(title), F.lit("-"), F.substring(F.regexp_replace(story_id, "-", ""), 1, 6))


def title_tokens(title: Column) -> Column:
    """Distinct tokens of a-z and 0-9, longer than two, no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~x.isin(STOP_WORDS)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens, 0 where either side has none."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def truncate(c: Column, most: int = 160) -> Column:
    """At most ``most`` characters, the last one an ellipsis where something was cut."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n{2,}"), lambda x: F.trim(x)), lambda x: x != "")


def escape_xml(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def keywords(tags: Column) -> Column:
    return F.nullif(F.array_join(tags, ", "), F.lit(""))


def trim_promo(body: Column, markers: tuple[str, ...]) -> Column:
    """The body up to the first of the markers, trimmed at its end; null is empty."""
    text = F.coalesce(body, F.lit(""))
    places = [F.nullif(F.instr(text, m), F.lit(0)) for m in markers]
    cut = F.least(*places) if len(places) > 1 else places[0]
    return F.regexp_replace(F.when(cut.isNotNull(), F.left(text, cut - 1)).otherwise(text), r"(?U)\s+$", "")


def message_text(message: Column) -> Column:
    """Text of a model's message (JSON): content, else reasoning, else the joined reasoning details."""
    field = lambda name: F.nullif(F.trim(F.get_json_object(message, f"$.{name}")), F.lit(""))
    details = F.from_json(F.get_json_object(message, "$.reasoning_details"), "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(details, lambda x: x["type"] == "reasoning.text"), lambda x: x["text"])
    return F.coalesce(field("content"), field("reasoning"), F.nullif(F.trim(F.array_join(texts, "\n")), F.lit("")))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: the whole text, a fenced block, or the last suffix
    from an opening brace that parses; null if there is none."""
    stripped = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")

    def parsed(c: Column) -> Column:
        # inside brackets, as Spark's parser alone passes over what follows a value
        alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")) == 1
        return F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT") & alone, F.trim(c))

    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    # suffixes from each opening brace, the latest first
    opened = F.filter(F.sequence(F.lit(1), F.length(stripped)), lambda i: F.substr(stripped, i, F.lit(1)) == "{")
    suffixes = F.transform(F.reverse(opened), lambda i: F.substr(stripped, i))
    tail = F.get(F.filter(F.transform(suffixes, parsed), lambda x: x.isNotNull()), 0)
    return F.when(F.length(stripped) > 0, F.coalesce(parsed(stripped), parsed(fenced), tail))
