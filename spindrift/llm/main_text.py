"""Main text of HTML pages by composite text density.

For every block node of the page's tree: characters per tag, adjusted by the share of
link characters and link tags in the node and in the body.  A node's density sum is the
sum of its children's densities.  The node with the largest sum holds the content; the
smallest density on its path to the body is the threshold, and other subtrees at or
above it that the path leaves are content too, and so are the blocks of the article (or,
without one, of the main element) that holds it, unless they are mostly links.  Elements
that are never article text (menus, forms, scripts, adverts, reader comments ...) leave the
tree first.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
#: Elements that begin and end a block of text, and are nodes of the tree.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "header footer nav aside address form fieldset details summary dialog center hr hgroup menu search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; all but the last two are dropped with it.
RAW = frozenset("script style noscript iframe noembed noframes template xmp textarea title".split())
DROPPED = frozenset("head nav footer aside form fieldset button select option datalist dialog menu search svg canvas object audio video".split())
#: Class names and ids that mark what is not the article: whole ones, or their last part.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments "
    "disqus respond replies share sharing social related recommended recommendation recommendations trending widget toolbar pagination pager search skip hidden".split()
)
#: Parts that only say how something is laid out: the part before them is the last one.
LAYOUT = frozenset("count counts counter box bar container wrapper wrap inner outer block section area panel slot unit row column col list item items links link buttons button left right top bottom".split())
#: Words that begin so tell what stands beside or within an element, or that it's absent.
BESIDE = frozenset("no not has have with without".split())
#: Words that may be the subject of an article's section; there its id is the slug of its heading.
SUBJECTS = frozenset("search alert notice banner menu header navigation promotion advertising advertisement login signup pagination widget toolbar modal popup overlay cookie cookies consent gdpr hidden skip sponsor breadcrumb breadcrumbs trending sharing".split())
#: In an article these are no reader's comments, whatever their class says.
QUOTED = frozenset("blockquote p pre code span q cite em i b".split())
#: The last part of a class or id of what holds an article without being one.
CONTENT = frozenset("content article post entry story".split())
_CONTENT = re.compile("content|article|post|entry|story", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
KEPT = frozenset("html body main article".split())
#: An opening tag of the key closes an open element of the value, up to the nearest container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def _listed(word: str) -> str:
    """The name in NOT_ARTICLE by which a class or id marks its element, or an empty string."""
    if word.lower() in NOT_ARTICLE:
        return word.lower()
    parts = [x.lower() for x in _PART.findall(word)]
    if not parts or parts[0] in BESIDE:
        return ""
    while len(parts) > 1 and parts[-1] in LAYOUT:
        parts.pop()
    return parts[-1] if parts[-1] in NOT_ARTICLE else ""


def _holds_content(tag: str, attributes: str) -> bool:
    """Whether a class or id names the element as what holds the content."""
    if tag not in ("div", "section") or not _CONTENT.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for word in (m[2] or m[3] or m[4] or "").split():
                parts = [x.lower() for x in _PART.findall(word)]
                while len(parts) > 1 and parts[-1] in LAYOUT:
                    parts.pop()
                if parts and parts[-1] in CONTENT:
                    return True
    return False


def _not_article(tag: str, attributes: str, inside_article: bool, inside_content: bool) -> int:
    """2 for what is never article text, 1 for what a class or id in NOT_ARTICLE marks, else 0."""
    if tag in DROPPED or tag == "header" and not inside_article and not inside_content:
        return 2
    if not attributes or tag in KEPT:
        return 0
    marked = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if name == "class" or name == "id" and tag not in HEADINGS:  # ids of headings are slugs of their text
            for word in value.split():
                if found := _listed(word):
                    if inside_article and (name == "id" and tag == "section" and found in SUBJECTS or tag in QUOTED and found in ("comment", "comments")):
                        continue
                    if found in ("header", "banner") and (inside_article or {x.lower() for x in _PART.findall(word)} & {"article", "post", "entry", "story"}):
                        continue
                    marked = 1
    return marked


class _Page:
    """The block tree of a page as parallel lists in page order, and its text runs.

    An element that only its class or id marks stays if it holds the page's article or main:
    the places of such elements are known after one reading, and the page is read again.
    """

    def __init__(self, source: str):
        self.holders: set[int] = set()
        self._start()
        self._read(source)
        if self.holders:
            self._start()
            self._read(source)

    def _start(self) -> None:
        self.parent, self.chars, self.tags, self.link_chars, self.link_tags = [-1], [0], [0], [0], [0]
        self.names, self.body = [""], 0
        self.runs: list[tuple[int, int, str]] = []  # node, block number, text

    def _text(self, text: str, node: int, block: int, link: bool) -> None:
        text = html.unescape(text)
        self.runs.append((node, block, text))
        n = len("".join(text.split()))
        self.chars[node] += n
        if link:
            self.link_chars[node] += n

    def _read(self, s: str) -> None:
        # tag, node, whether it is dropped, place of an element that stays if it holds the article
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]
        at, block, links, articles, seen = 0, 0, 0, 0, False
        # depths of the open elements of each tag, and of all block elements
        depths: dict[str, list[int]] = {}
        open_blocks: list[int] = []
        marked: list[int] = []  # those that stay if they hold the article
        contents: list[int] = []  # those that hold the content by their class or id
        tags_end = s.rfind(">") + 1  # a "<" beyond begins no tag

        def deepest(*tags: str) -> int:
            return max((depths[x][-1] for x in tags if depths.get(x)), default=0)

        def close(depth: int) -> None:
            nonlocal links, articles, block
            while len(stack) > depth:
                tag = stack.pop()[0]
                depths[tag].pop()
                links -= tag == "a"
                articles -= tag in ("article", "main")
                for places in (marked, contents):
                    if places and places[-1] == len(stack):
                        places.pop()
                if tag in BLOCKS:
                    block += 1
                    open_blocks.pop()

        while at < len(s):
            m = _TAG.search(s, at, tags_end) if at < tags_end else None
            end = m.start() if m else len(s)
            if end > at and not stack[-1][2]:
                self._text(s[at:end], stack[-1][1], block, links > 0)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            attributes = m[3] or m[6] or ""
            if m[1] or m[4]:
                depth = deepest(tag)
                if depth and (tag in BLOCKS or depth >= deepest("td", "th", "table", "article")):
                    close(depth)
                if tag in BLOCKS:
                    block += 1
                continue
            if tag in RAW:
                close_at = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(s, at)
                at = close_at.end() if close_at else len(s)
                continue
            _, node, dropped, _ = stack[-1]
            if tag in VOID:
                if tag == "hr":
                    block += 1
                elif not dropped:
                    self.tags[node] += tag != "br"
                    if tag == "br":
                        self.runs.append((node, block, " "))
                continue
            if tag in BLOCKS and open_blocks and stack[open_blocks[-1]][0] == "p":
                close(open_blocks[-1])
            if tag in CLOSES:
                shut, until = CLOSES[tag]
                depth = deepest(*shut)
                if depth > deepest(*until):
                    close(depth)
            if tag == "a":
                depth = deepest("a")
                if depth > (open_blocks[-1] if open_blocks else 0):
                    close(depth)
            _, node, dropped, _ = stack[-1]
            why = _not_article(tag, attributes, articles > 0, bool(contents))
            # within an article or main, what follows an article holds comments or teasers
            holder = m.start() if why == 1 and not (articles and seen) else -1
            dropped = dropped or why > 0 and m.start() not in self.holders
            if tag in ("article", "main"):
                self.holders.update(stack[d][3] for d in marked)
                seen = seen or tag == "article"
            if tag in BLOCKS:
                block += 1
                if not dropped:
                    self.parent.append(node)
                    self.names.append(tag)
                    for x in (self.chars, self.tags, self.link_chars, self.link_tags):
                        x.append(0)
                    node = len(self.parent) - 1
                    if tag == "body" and self.body == 0:
                        self.body = node
            elif tag == "a" and not dropped:
                self.tags[node] += 1
                self.link_tags[node] += 1
            links += tag == "a"
            articles += tag in ("article", "main")
            if not attributes.endswith("/") or tag in BLOCKS:
                depths.setdefault(tag, []).append(len(stack))
                if tag in BLOCKS:
                    open_blocks.append(len(stack))
                if holder >= 0:
                    marked.append(len(stack))
                if _holds_content(tag, attributes):
                    contents.append(len(stack))
                stack.append((tag, node, dropped, holder))
            else:
                links -= tag == "a"

    def text(self) -> str:
        n = len(self.parent)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.chars[p] += self.chars[i]
            self.tags[p] += self.tags[i] + 1
            self.link_chars[p] += self.link_chars[i]
            self.link_tags[p] += self.link_tags[i]
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[self.parent[i]].append(i)
        body = self.body
        share = self.link_chars[body] / max(1, self.chars[body])
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            c, t, lc, lt = self.chars[i], max(1, self.tags[i]), max(1, self.link_chars[i]), max(1, self.link_tags[i])
            if c:
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                density[i] = c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9) / math.log(base)
        for i in range(1, n):
            sums[self.parent[i]] += density[i]
        # the node with the largest sum in each node's subtree, the first of equal ones
        top = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            top[p] = max(top[p], top[i], key=lambda j: (sums[j], -j))
        best = top[body] if sums[top[body]] else body
        threshold, i = density[best], best
        while i > body:
            i = self.parent[i]
            threshold = min(threshold, density[i])
        marked, todo = [False] * n, [body]
        while todo:
            i = todo.pop()
            if density[i] < threshold:
                continue
            chosen = top[i] if sums[top[i]] else i
            marked[chosen] = True
            if chosen != i:  # what holds it comes again, for the others beside the path to it
                todo += [j for j in children[i] if j != chosen]
        for i in range(body + 1, n):
            marked[i] = marked[i] or marked[self.parent[i]]
        own = self._rest_of_article(best, children)
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.runs:
            if marked[node] or node in own:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(x).split()) for x in blocks.values())
        return "\n".join(x for x in lines if x)


    def _rest_of_article(self, best: int, children: list[list[int]]) -> set[int]:
        """The nodes of the article that holds ``best`` (else of the main element) whose own text
        stays: those within no block that is mostly links."""
        held, i = -1, best
        while i > 0:
            if self.names[i] == "article":
                held = i
                break
            if self.names[i] == "main" and held < 0:
                held = i
            i = self.parent[i]
        out: set[int] = set()
        todo = [held] if held > 0 else []
        while todo:
            i = todo.pop()
            if 2 * self.link_chars[i] <= self.chars[i]:
                out.add(i)
                todo += children[i]
        return out


def main_text(source: str | None) -> str:
    """The article's text of one page: its blocks in page order, one line each."""
    return _Page(source).text() if source else ""


def extract_main_text(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the article text in ``out_col`` and its code points in ``n_chars``.

    Null and empty pages, and pages without any text, give an empty string. Every row is
    kept, repeated ones too; all other columns stay, and columns named like the two new
    ones are replaced. Bytes that are no UTF-8 become the replacement character.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html_col, out_col, "n_chars")]
    schema = T.StructType([*kept, T.StructField(out_col, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                texts = [main_text(x.decode("utf-8", "replace")) if x else "" for x in batch.column(batch.num_columns - 1).to_pylist()]
                columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(html_col).cast("binary").alias("__source")).mapInArrow(run, schema)
