"""Operators that SQL can't express against plain versions of their methods, and large or odd inputs."""

import collections
import html.parser
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import archives, column_suffixes, language, main_text, near_dedup, packing, passage_dedup, quality, topk_search


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# ---- suffixes


@pytest.mark.parametrize(("length", "width", "letters"), [(8, 4, 2), (8, 8, 2), (9, 1, 2), (100, 10, 1), (20, 10, 2), (10, 5, 3), (9, 9, 2)])
def test_suffix_order(length, width, letters):
    rng = np.random.default_rng(length + width)
    counts = rng.integers(1, 30, 150)
    bounds = np.concatenate([[0], np.cumsum(counts + length - 1)])
    data = rng.integers(97, 97 + letters, bounds[-1]).astype(np.uint8)
    place, same = column_suffixes.suffix_order(data, bounds, counts, length, width)
    group = dict(zip(place.tolist(), np.cumsum(~same).tolist(), strict=True))
    starts = [int(a + i) for a, n in zip(bounds[:-1], counts, strict=True) for i in range(n)]
    strings = [data[s : s + length].tobytes() for s in starts]
    assert len(place) == len(group) and len(set(strings)) == len({group[s] for s in starts}) == len({(x, group[s]) for x, s in zip(strings, starts, strict=True)})


def test_suffix_order_is_the_order_of_the_symbols():
    data = np.frombuffer(b"banana" + b"bandana", np.uint8)
    place, same = column_suffixes.suffix_order(data, np.array([0, 6, 13]), np.array([6, 7]), 3, 1)
    suffixes = [(data[p:6] if p < 6 else data[p:]).tobytes() for p in place]
    assert suffixes == sorted(suffixes) and len(suffixes) == 13
    assert [bool(s) for s in same] == [i > 0 and suffixes[i][:3] == suffixes[i - 1][:3] and len(suffixes[i]) >= 3 for i in range(13)]


def test_ties_at_the_last_neighbour_go_by_the_samples_order():
    terms = np.zeros((40, quality.TERMS), np.float32)
    terms[:, 0] = 1
    terms[:5, 1] = np.arange(5)
    labels = np.array([i % 2 for i in range(40)])
    model = quality.Neighbours(terms, labels, (1.0, 1.0))
    sims = np.round(quality._unit((terms[30:31] - model.mean) @ model.projection) @ model.vectors.T, 6)[0]
    near = sorted(range(40), key=lambda i: (-sims[i], i))[: model.k]
    votes = np.maximum(sims[near], 1e-6) ** 4
    assert sims[near[-1]] == sims[39] and len(near) < 36
    assert np.isclose(model.score(terms[30:31])[0], (votes * labels[near]).sum() / votes.sum(), atol=1e-4)


def test_an_anchor_with_very_many_surroundings(spark):
    rng = random.Random(21)
    phrase = "this phrase of forty bytes is everywhere "
    rows = [(i, sentence(rng, 30) + phrase + sentence(rng, 30)) for i in range(300)] + [(900, None), (901, sentence(rng, 30) + phrase)]
    rows += [(1000 + i, rows[i][1][40:260]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in passage_dedup.remove_repeats(df).collect()}
    seen = set()
    for i, t in rows:
        data, gone = (t or "").encode(), set()
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone.update(range(s, s + 100))
            seen.add(data[s : s + 100])
        assert got[i] == len(gone)


# ---- main text


class _Tree(html.parser.HTMLParser):
    """The block tree of well-formed pages, as nested lists."""

    def __init__(self, page):
        super().__init__()
        self.root = {"text": [], "children": [], "links": 0, "in_links": 0}
        self.stack, self.link, self.lines = [self.root], False, []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            self.stack[-1]["links"] += 1
            return
        node = {"text": [], "children": [], "links": 0, "in_links": 0}
        self.stack[-1]["children"].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        else:
            self.stack.pop()

    def handle_data(self, data):
        self.stack[-1]["text"].append(data)
        self.lines.append((self.stack[-1], data))
        self.stack[-1]["in_links"] += len("".join(data.split())) * self.link


def composite_density(page):
    """Lines of text that the method keeps, by its formulas over a tree."""
    tree = _Tree(page)
    body = tree.root["children"][0]

    def count(n):
        for c in n["children"]:
            count(c)
        n["c"] = len("".join("".join(n["text"]).split())) + sum(x["c"] for x in n["children"])
        n["t"] = n["links"] + sum(x["t"] + 1 for x in n["children"])
        n["lc"] = n["in_links"] + sum(x["lc"] for x in n["children"])
        n["lt"] = n["links"] + sum(x["lt"] for x in n["children"])

    def nodes(n):
        return [n, *[y for x in n["children"] for y in nodes(x)]]

    count(body)
    for n in nodes(body):
        c, t, lc, lt = n["c"], max(1, n["t"]), max(1, n["lc"]), max(1, n["lt"])
        n["d"] = c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9) / math.log(math.log(c / max(1, c - lc) * lc + body["lc"] / max(1, body["c"]) * c + math.e)) if c else 0.0
    for n in nodes(body):
        n["s"] = sum(x["d"] for x in n["children"])
    best = max(nodes(body), key=lambda n: n["s"])
    path = [n for n in nodes(body) if any(x is best for x in nodes(n))]
    threshold = min(n["d"] for n in path)
    kept = set()

    def mark(n):
        if n["d"] < threshold:
            return
        top = max(nodes(n), key=lambda x: x["s"])
        top = top if top["s"] else n
        kept.update(id(x) for x in nodes(top))
        for c in n["children"] if top is not n else []:
            if c is not top:
                mark(c)

    mark(body)
    return [x.strip() for n, x in tree.lines if id(n) in kept and x.strip()]


def test_main_text_by_density_of_random_trees():
    rng = random.Random(31)

    def node(depth):
        kids = [node(depth + 1) for _ in range(rng.randrange(0, 4 if depth < 4 else 1))]
        texts = [sentence(rng, rng.choice([1, 3, 20, 60])) for _ in range(len(kids) + 1)] if rng.random() < 0.7 else [""] * (len(kids) + 1)
        texts = [f"<a href=x>{t}</a>" if t and rng.random() < 0.25 else t for t in texts]
        return "<div>" + texts[0] + "".join(k + t for k, t in zip(kids, texts[1:], strict=True)) + "</div>"

    for _ in range(200):
        page = "<body>" + "".join(node(0) for _ in range(rng.randrange(1, 4))) + "</body>"
        assert main_text.main_text(page).split("\n") == (composite_density(page) or [""])


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<div><p>a b</p>" * 50_000 + "x", "<b>" * 100_000 + "x" + "</i>" * 100_000, "<a " * 200_000, '<a href="' * 100_000, "<td><i>" * 50_000 + "x" + "</u>" * 50_000, "<!--" * 100_000, "<li>" * 100_000 + "x"])
def test_main_text_of_large_odd_pages_takes_linear_time(page):
    began = time.process_time()
    main_text.main_text(page)
    assert time.process_time() - began < 4


def test_main_text_of_repeated_rows_and_kept_parts(spark):
    body = "<p>A paragraph of the article that is long enough, <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in it.</p><div class='share-price'><p>The share price rose by a tenth.</p></div><div class='alert-story'><p>An alert was raised at noon.</p></div>"
    pages = spark.createDataFrame([(1, "u", f"<article>{body}</article>")] * 3 + [(2, "u", "<p>" + "long " * 200_000 + "</p>")], "page_id long, url string, html string")
    rows = main_text.extract_main_text(pages).orderBy("page_id").collect()
    assert [r.text for r in rows[:3]] == ["A paragraph of the article that is long enough, E=m in it.\nThe share price rose by a tenth.\nAn alert was raised at noon."] * 3
    assert rows[3].n_chars == 5 * 200_000 - 1


# ---- near duplicates


def test_near_copies_that_are_just_too_different(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(len(words)), 200):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    began = time.time()
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(r.kept for r in out) and len(out) == 60 and time.time() - began < 90


# ---- classifier


def test_quality_votes_as_all_pairs_do():
    rng = np.random.default_rng(3)
    terms, labels = rng.standard_normal((90, quality.TERMS)).astype(np.float32), rng.integers(0, 2, 90)
    terms[5] = terms[6] = terms[7]  # ties
    model = quality.Neighbours(terms, labels, (0.7, 1.2), dimensions=8, k=7)
    asked = np.concatenate([terms[:20], rng.standard_normal((30, quality.TERMS)).astype(np.float32)])
    for got, x in zip(model.score(asked), asked, strict=True):
        v = (x - terms.mean(0)) @ model.projection
        sims = model.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-sims, kind="stable")[:7]
        votes = np.maximum(sims[near], 1e-6) ** 4 * np.where(labels[near] == 1, 1.2, 0.7)
        assert abs(got - (votes * labels[near]).sum() / votes.sum()) < 1e-3


def test_quality_of_long_and_repeated_rows(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 30)) for i in range(60)] + [(100, sentence(rng, 120_000)), (3, "other"), (3, "other")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    out = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(rows) and len({r.score for r in out if r.doc_id == 3}) == 2


# ---- language


def kneser_ney(texts):
    """A plain interpolated Kneser-Ney model of order 4: probability of a character after a context."""
    grams = collections.Counter()
    for t in texts:
        s = "   " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        for i in range(3, len(s)):
            grams[s[i - 3 : i + 1]] += 1
    levels = {4: grams}
    for n in (3, 2, 1):
        levels[n] = collections.Counter()
        for g in levels[n + 1]:
            levels[n][g[1:]] += 1
    letters = len(levels[1])

    def p(c, context, n):
        if n == 0:
            return 1 / (letters + 1)
        context = context[len(context) - n + 1 :]
        seen = {g: k for g, k in levels[n].items() if g[:-1] == context}
        total = sum(seen.values())
        if not total:
            return p(c, context, n - 1)
        d = language.DISCOUNT
        return max(seen.get(context + c, 0) - d, 0) / total + d * len(seen) / total * p(c, context, n - 1)

    return p, levels[1]


def test_kneser_ney():
    texts = ["abra cadabra", "banana, bandana", "𝒳𝒴 Ärger"]
    alphabet = np.array(sorted({ord(c) for t in texts for c in t.lower() if c.isalpha()}))
    numbers = language.numbering(alphabet)
    keys, _ = language.characters(texts, numbers)
    grams, counts = np.unique(keys, return_counts=True)
    model = language.Model(["x"], [grams], [counts], alphabet)
    p, letters = kneser_ney(texts)
    names = {" ": 0, "?": language.UNSEEN} | {chr(a): int(numbers[a]) for a in alphabet}
    for context in ("   ", "abr", "ana", " ba", "zab", "𝒳𝒴 ", "n  "):
        number = 0
        for c in context:
            number = number << 16 | names.get(c, language.UNSEEN)
        every = [*letters, "?"]
        got = np.exp(model._log(np.array([number << 16 | names[c] for c in every], np.uint64), language.ORDER)[:, 0].astype(float))
        assert np.allclose(got, [p(c, context, 4) for c in every], rtol=1e-4) and abs(got.sum() - 1) < 1e-4


def test_language_by_rare_scripts_ties_and_repeated_rows(spark):
    rng = random.Random(2)
    gothic = "".join(chr(0x10330 + i) for i in range(20))
    rows = [(i, " ".join("".join(rng.choice(x) for _ in range(5)) for _ in range(20)), n) for i, (n, x) in enumerate([("zz", gothic), ("aa", "abcdefgh")] * 60)]
    df = spark.createDataFrame(rows + rows[:4], "doc_id long, text string, lang string")
    model = language.fit(df)
    more = spark.createDataFrame([(1, gothic), (2, "x" * 3_000_000), (3, "漢字")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(more, model).collect()}
    assert got[1].lang_pred == "zz" and got[2].lang_pred in ("aa", "zz") and got[2].rejected and got[3].lang_pred in ("aa", "zz")
    names = {i: n for i, _, n in rows}
    assert all(r.lang_pred == names[r.doc_id] for r in language.identify(df, model).collect())
    one = df.where("lang = 'aa'")
    same = language.fit(one.unionByName(one.withColumn("lang", F.lit("bb"))))
    assert {r.lang_pred for r in language.identify(one, same).collect()} == {"aa"}  # equal models: the first name


def test_language_sample_is_bounded_and_drawn_from_all(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("abc def "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 50 == 0, "bb").otherwise("aa").alias("lang"))
    model = language.fit(df, sample_per_language=30)
    assert model.languages == ["aa", "bb"]


# ---- packing


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(fit)] = fit - n
    return len(rooms)


def test_plan_needs_no_more_than_plain_best_fit():
    rng = random.Random(17)
    for most in (30, 100, 64):
        lengths = [rng.randrange(1, most + 1) for _ in range(1500)]
        out = packing.plan(dict(collections.Counter(lengths)), 100)
        used = {first + i for _, _, n, first, _ in out for i in range(n)}
        assert len(used) <= best_fit(lengths, 100) + 1


def test_tokens_of_odd_white_space():
    import public_tokenizers

    tokens = packing.Tokens(str(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(11)
    marks = [" ", "  ", "\n", " \n", "\u00a0", "\u2003", "\t\t", "\x85", "\x1c", "'s", "é", "12", "?!", "word", "The", "_", "漢", "😀", "\u200b", "\0", "\ud7ff", "\uffff", "e\u0301", "<|endoftext|>", "<|end"]
    assert tokens.fast is not None
    for _ in range(2000):
        t = "".join(rng.choice(marks) for _ in range(rng.randrange(0, 30)))
        assert tokens.ids(t).tolist() == tokens.encode(t).tolist(), repr(t)
    for i in range(0, 0x110000, 97):  # characters of every kind, beside letters and blanks
        if not 0xD800 <= i < 0xE000:
            t = f"a{chr(i)}b {chr(i)} 1{chr(i)}"
            assert tokens.ids(t).tolist() == tokens.encode(t).tolist(), i
    for t in (" " * 1_500_000 + "x", "." * 200_000, "ab" * 200_000):
        assert np.array_equal(tokens.ids(t), tokens.encode(t))
    other = packing.Tokens(str(public_tokenizers.path("word_bpe_49k.json")))
    assert other.fast is None and other.ids("Two words").tolist() == other.encode("Two words").tolist()


# ---- archives


def test_archive_is_read_as_a_stream_by_declared_lengths(spark, tmp_path):
    odd = ["x\r\n", "\r\n\r\n", "\r\n\r\nWARC/1.0\r\n\r\n", "", "y\r", "z" * 300_000, "\n", "a\r\n\r\n\r\n\r\n\r\nb\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://a/{i}", odd[i % len(odd)] + (str(i) if i % 3 else "")) for i in range(64)], "page_id long, url string, html string")
    got = archives.archive_pages(pages.repartition(1), str(tmp_path / "w"))
    want = {r.page_id: len((r.html or "").encode()) for r in pages.collect()}
    assert {r.page_id: r.payload_bytes for r in got.collect()} == want
    bodies = {r.target_uri: bytes(r.payload) for r in archives.read_warc(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()}
    texts = {r.url: r.html.encode() for r in pages.collect()}
    assert all(texts[u] == b for u, b in bodies.items()) and len(bodies) == len(set(texts.values()))
    with pytest.raises(ValueError, match="declared length"):
        list(archives.warc_records([b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50", b"short"]))


# ---- search


def test_top_k_tiles_are_spread_over_tasks_without_broadcast(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(2000)], "vec_id long, embedding array<double>").repartition(8)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    was = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        run = topk_search._tiles

        def marked(k):
            def of(batches):
                from pyspark import TaskContext

                for b in run(k)(batches):
                    yield b.set_column(3, "shard", [TaskContext.get().partitionId()] * b.num_rows) if b.num_rows else b

            return of

        topk_search._tiles = marked
        try:
            plan = topk_search.top_k(df, df.where("vec_id % 20 = 0"), 5, shard_rows=25, block_rows=100)
            assert plan.count() == 500
        finally:
            topk_search._tiles = run
        keys = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "part#" in keys and "block#" in keys
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
