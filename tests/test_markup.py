"""Elements by descendant steps over balanced tags."""

import time

import pytest
from pyspark.sql import functions as F

from spindrift.functions.markup import Step, attributes_of, select, text_of
from spindrift.operators.extract import select_fields


def texts(page, *path):
    words, found = select(page, [path])
    return [text_of(words, f) for f in found[0]]


def test_nested_and_unclosed():
    div, p = Step("div", ("a",)), Step("p")
    assert texts('<div class="x a"><div><p>1</div><p>2<p>3</div><p>4', div, p) == ["1", "2", "3"]
    assert texts("<div class=a>1<div class=a>2</div>3</div>4", div) == ["123", "2"]
    assert texts("<p>1<b>2<p>3</b>4", p) == ["12", "34"]
    assert texts("<ul><li>1<ul><li>2<li>3</ul><li>4</ul>", Step("li")) == ["123", "2", "3", "4"]
    assert texts("<table><tr><td>1<td>2<tr><td><table><tr><td>3</table></table>", Step("td")) == ["1", "2", "3", "3"]
    assert texts("</div></p>1<p>2</x></p>3", p) == ["2"]
    assert texts("<p>a<br/>b<img src=x>c</p>d", p) == ["abc"]
    assert texts("<button><p>1<button>2</button>3</p></button>", p) == ["123"]


def test_what_is_no_markup():
    p = Step("p")
    assert texts("<!-- <p>no</p> --><p>yes <script>'<p>no</p>'</script><style>p{}</style>x</p>", p) == ["yes x"]
    assert texts("<p title=\"a > b </p>\">1 &lt; 2 &amp;amp; &#233;</p><!-- open <p>", p) == ["1 < 2 &amp; é"]
    assert texts("a < b <p>c < d</p> <", p) == ["c < d"]
    assert texts("", p) == [] and texts("<P CLASS='B c'>x</P>", Step("p", ("c",))) == ["x"]


def test_attributes():
    assert attributes_of(' A=1 b="x &amp; y" c=\'z\' d a=2 data-x = "q" /') == {"a": "1", "b": "x & y", "c": "z", "d": "", "data-x": "q"}
    meta = Step("meta", (), (("itemprop", "name"),))
    words, found = select('<meta itemprop="names" content="no"><meta content="yes" itemprop="name">', [(meta,)])
    assert [f.attributes["content"] for f in found[0]] == ["yes"]


def test_fields_of_pages(spark):
    pages = spark.createDataFrame([(1, "<div class=b><a href=' /x '>T</a><i> </i><a href=''>U</a></div>"), (2, None), (3, "")], "page_id long, html string").withColumn("b", F.lit("b"))
    link = (Step("div", ("b",)), Step("a"))
    got = {r.page_id: (r.href, r.text, r.inner) for r in select_fields(pages, {"href": (link, "href"), "text": (link, "text"), "inner": ((Step("div"),), "html")}).collect()}
    assert got == {1: (["/x"], ["T", "U"], ["<a href=' /x '>T</a><i> </i><a href=''>U</a>"]), 2: ([], [], []), 3: ([], [], [])}


@pytest.mark.parametrize("page", ["<div>" * 50_000, "<div>" * 20_000 + "</x>" * 20_000, "<p>" * 50_000, "<p><b>" * 20_000 + "<div>" * 20_000, "<" * 200_000, "<a " * 50_000, "<!--" * 50_000, "<p title=\"" * 20_000, "<li>" * 30_000])
def test_odd_pages_take_linear_time(page):
    started = time.time()
    select(page, [(Step("div", ("a",)), Step("p")), (Step("li"),)])
    assert time.time() - started < 5
