"""Golden facts of the scalar functions."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from spindrift.functions import labels, text, times, urls


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    r = one(
        spark,
        norm=text.normalize_whitespace(F.lit(" a  b\n\tc ")), body=text.clean_body(F.lit("a  b\r\n\n  c ")), tags=text.clean_tags(F.array(F.lit(" x"), F.lit(""), F.lit("y"), F.lit("x "))),
        emb=text.embedding_text(F.lit("T  1"), F.lit(None).cast("string"), F.lit("b" * 900)), slug=text.slugify(F.lit("  Élan & Co: the_end -- now! ")), empty=text.slugify(F.lit("!!!")),
        tokens=text.title_tokens(F.lit("The Budget of 2024: the budget, and tax")), none=text.title_tokens(F.lit(None).cast("string")), short=text.truncate(F.lit("abc def ghi"), 9), xml=text.escape_xml(F.lit("<a & 'b'>")),
        paras=text.paragraphs(F.lit(" a\n\n\n b \n\n")), promo=text.trim_promo(F.lit("News. \nDownload the TOI App now"), ("You Can Also Check:", "Download the TOI App")), kw=text.keywords(F.array(F.lit("a"), F.lit("b"))),
    )
    assert r.norm == "a b c" and r.body == "a b\nc" and r.tags == ["x", "y"]
    assert r.emb == "T 1\n" + "b" * 800
    assert r.slug == "élan-co-the-end-now" and r.empty == "story"
    assert r.tokens == ["budget", "2024", "tax"] and r.none == []
    assert r.short == "abc def…" and r.xml == "&lt;a &amp; &apos;b&apos;&gt;" and r.paras == ["a", "b"]
    assert r.promo == "News." and r.kw == "a, b"


def test_json_from_answers(spark):
    answers = ['{"a": 1}', 'text ```json\n{"a": 2}\n``` end', 'so {x} is {"a": {"b": 3}}', "no", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in answers], "t string").select(text.json_object(F.col("t"))).collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": {"b": 3}}', None, None, None]
    r = one(spark, a=text.message_text(F.lit('{"content": " ", "reasoning": "why"}')), b=text.message_text(F.lit('{"reasoning_details": [{"type": "reasoning.text", "text": "x"}, {"type": "other", "text": "y"}]}')))
    assert (r.a, r.b) == ("why", "x")


def test_urls(spark):
    r = one(
        spark,
        n=urls.normalize_url(F.lit("HTTPS://Ex.com/A/?q=1#f")), c=urls.canonical_url(F.lit(" HTTP://Ex.com/Path/?utm_source=a&b=2&a=x%20y&fbclid=z#frag")), bare=urls.canonical_url(F.lit("ex.com/p")), empty=urls.canonical_url(F.lit(" ")),
        u=urls.url_id(F.lit("https://ex.com/a")), host=urls.host(F.lit("https://www.Ex.com:80/x")), rank=urls.publisher_rank(F.lit("x"), F.lit("https://m.indianexpress.com/a")), name=urls.publisher_rank(F.lit(" TOI "), F.lit(None).cast("string")),
        src=urls.best_of_srcset(F.lit("//a/1.jpg 320w, //a/2.jpg 2x, //a/3.jpg 2000w, //a/4.jpg")), img=urls.upgrade_image(F.lit("//images.ex.net/a.jpg?w=300&x=1"), "images.ex.net"), other=urls.upgrade_image(F.lit("https://o/a.jpg"), "images.ex.net"), pub=urls.publisher_of(F.lit("The Hindu")),
    )
    assert r.n == "https://ex.com/A" and r.c == "http://ex.com/Path?a=x+y&b=2" and r.bare == "https://ex.com/p" and r.empty is None
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://ex.com/a")) and r.host == "ex.com" and (r.rank, r.name) == (3, 2)
    assert r.src == "https://a/2.jpg" and r.img == "https://images.ex.net/a.jpg?w=1200&x=1&auto=format%2Ccompress&fit=max" and r.other == "https://o/a.jpg" and r.pub == "hindu"


def test_times(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T05:30:00+05:30", "2024-01-01T05:30:00", "2024-01-01 05:30:00", "bad", "", None, "2024-01-01T00:00:00-01:00"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(times.parse_datetime(F.col("t"))).collect()]
    t = datetime(2024, 1, 1)
    assert got == [t, t, t, t, None, None, None, datetime(2024, 1, 1, 1)]
    now = F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))
    at = lambda s: F.to_timestamp_ntz(F.lit(s))
    r = one(spark, iso=times.ist_iso(at("2024-01-01 20:00:00.9")), fresh=times.is_fresh(at("2024-01-01 00:00:00"), now, 24), old=times.is_old(at("2023-12-31 23:59:59"), now, 24), none=times.is_fresh(at("x") if False else F.lit(None).cast("timestamp_ntz"), now, 24), day=times.valid_date(F.lit("2024-02-30")), ok=times.valid_date(F.lit("2024-02-29")), ms=times.from_epoch_ms(F.lit(1704067200500)), bad=times.from_epoch_ms(F.lit(10**17)), label=times.relative_label(at("2024-01-01 20:30:00"), now))
    assert r.iso == "2024-01-02T01:30:00+05:30" and r.fresh and r.old and not r.none and r.day is None and str(r.ok) == "2024-02-29"
    assert r.ms == datetime(2024, 1, 1, 0, 0, 0, 500000) and r.bad is None and r.label == "3h ago"


def test_labels(spark):
    r = one(spark, a=labels.normalize_scope(F.lit("TAMIL_NADU")), b=labels.normalize_category(F.lit("Science and Tech")), c=labels.normalize_category(F.lit("x")), d=labels.scope_label(F.lit("india")), e=labels.category_params(F.array(F.lit("tech"), F.lit("x"), F.lit("tech"))))
    assert (r.a, r.b, r.c, r.d, r.e) == ("Tamil Nadu", "tech", None, "India", ["tech"])
