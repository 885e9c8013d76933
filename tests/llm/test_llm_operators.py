"""Each operator against brute force on small tables with nulls, empty and long texts, ties,
repeated rows, empty tables and columns with clashing names."""

import base64
import binascii
import gzip
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spindrift.llm import archives, decontamination, language, licenses, main_text, near_dedup, packing, passage_dedup, quality, topk_search
from spindrift.operators.components import linked_components

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))
VOCABULARY = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text) with copies, near copies, shared passages, odd and missing texts."""
    rng = random.Random(5)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    rows = [sentence(rng, rng.randrange(1, 200)) for _ in range(30)] + [base] * 6
    for i in range(30):
        w = base.split()
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    rows += [f"{sentence(rng, 5 + i)} {passage} {sentence(rng, i * 3)}" for i in range(30)]
    rows += [None, "", "  \n ", "one", "Two words", "É é É", "x" * 5000, "ab " * 4000, "MIT License. mit license", "a\n\n\nb   c", "the GNU General Public License, version 3. Apache License 2.0"]
    return list(enumerate(rows))


def frame(spark, rows):
    """Documents with extra columns that clash with names used inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "bucket", "n_words", "score", "rep", "value", "word", "n", "sketch", "held_out", "piece"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


# ---- near duplicates


def linked(texts, size=5):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, texts):
    expected = linked(texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(9)
    base = sentence(rng, 80).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == linked(rows)


def test_near_duplicates_edges(spark):
    rows = near_dedup.near_duplicates(frame(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, "A  B")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_union_sketch_keeps_pairs_from_18_of_48(spark):
    rows = [(10 * n + x, [*range(n), *range(100 + x, 100 + x + 2 * (48 - n), 2)]) for n in (17, 18, 20) for x in (0, 1)]
    classes = spark.createDataFrame(rows, "rep long, sketch array<long>")
    pairs = spark.createDataFrame([(10 * n, 10 * n + 1) for n in (17, 18, 20)], "a long, b long")
    assert sorted(r.a for r in near_dedup._estimated(pairs, classes, 48).collect()) == [180, 200]


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (8, 2)]
    got = {r.node: r.component for r in linked_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 2: 2, 8: 2, 9: 2}


# ---- decontamination


def contaminated(texts, items, window=13):
    out = {}
    for i, t in texts:
        w = words(t)
        hit, found = set(), set()
        for key, item in items:
            x = words(item)
            n = min(window, len(x))
            for s in range(len(x) - n + 1) if x else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit.update(range(p, p + n))
                        if key is not None:
                            found.add(str(key))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark, texts):
    rng = random.Random(2)
    long = texts[70][1].split()
    items = [(1, " ".join(long[3:30])), (2, "Two  WORDS"), (3, None), (4, ""), (10, " ".join(long[3:30])), (11, sentence(rng, 20)), (12, " ".join(["ab"] * 13)), (13, "é"), (14, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("k"))
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.decontaminate(frame(spark, texts), bench).collect()}
    assert got == contaminated(texts, items)
    assert sum(x[4] for x in got.values()) > 3


def test_decontamination_of_one_word_over_and_over(spark):
    bench = spark.createDataFrame([("x", "a " * 10000), ("y", "b c " * 4000), ("z", "a b")], "item_id string, text string")
    started = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.decontaminate(frame(spark, [(1, "a " * 20000), (2, "c " + "b c " * 9000), (3, "A b")]), bench).collect()}
    assert got == {1: (20000, 20000, 1), 2: (18001, 18001, 1), 3: (2, 2, 1)} and time.time() - started < 60


def test_places_of_windows(spark):
    docs = frame(spark, [(1, "q a b c d e f g h i j k l m n"), (2, "x y x y")]).withColumn("key", F.lit(0).cast("long"))
    items = spark.createDataFrame([("x", "a b c d e f g h i j k l m n"), ("y", "A b c d e f g h i j k l m"), ("z", "X y")], "item_id string, text string")
    got = sorted(tuple(r) for r in decontamination.find_hits(docs, items).select("doc_id", "item_id", "start", "length").collect())
    assert got == [(1, "x", 1, 13), (1, "x", 2, 13), (1, "y", 1, 13), (2, "z", 0, 2), (2, "z", 2, 2)]


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    rows = decontamination.decontaminate(frame(spark, [(1, "a b"), (1, "a b"), (1, "c"), (None, "A")]), bench).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in rows) == [(0, 1, 1), (1, 1, 0), (1, 2, 1), (1, 2, 1)]
    assert decontamination.decontaminate(frame(spark, [(1, "a")]), bench.where("false")).first().n_hit == 0


LONG = "<p>" + "A long paragraph of the article with many plain words in it. " * 6 + "</p>"


@pytest.mark.parametrize(
    ("page", "there", "gone"),
    [
        (f"<article>{LONG}<section id='search'><h2>Search</h2><p>Search text.</p></section></article>", ["Search", "Search text."], []),
        (f"<article>{LONG}<section id='comments'><p>Reader text.</p></section></article>", [], ["Reader text."]),
        (f"<main><section><h2>A</h2>{LONG}{LONG}</section><section><h2>B</h2><p>gamma delta.</p></section></main>", ["A", "B", "gamma delta."], []),
        (f"<header><h1>Site</h1></header><div class='content'><header><h1>Title</h1></header>{LONG}{LONG}</div>", ["Title"], ["Site"]),
        (f"<article>{LONG}<blockquote class='comment'>A quote.</blockquote><pre>x <span class='comment'># why</span></pre><div class='article-comment-count'>5</div></article>", ["A quote.", "x # why"], ["5"]),
        (f"<article>{LONG}<p>Short.</p><p><a href=x>Only a link to elsewhere</a></p></article><article><p>teaser</p></article>", ["Short."], []),
    ],
)
def test_article_text_that_marks_and_density_must_not_lose(page, there, gone):
    lines = main_text.main_text(f"<html><body>{page}</body></html>").split("\n")
    assert set(there) <= set(lines) and not set(gone) & set(lines)


# ---- licenses


def test_licenses(spark, texts):
    more = texts + [(1000 + i, t) for i, t in enumerate(["General public license general PUBLIC license", "Licensed under the Apache License, Version 2.0.", "mit-license", "permit license", "Licensed under CC BY-NC 4.0", "no license here"])]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, more)).collect()}
    for i, t in more:
        w = words(t)
        places = sorted((p, label) for phrase, label, _ in licenses.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)), t
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[1001].labels == "Apache-2.0,apache" and got[1004].labels == "CC-BY-NC-4.0" and got[1005].labels == ""
    assert licenses.scan_licenses(empty(spark)).count() == 0
    assert len(licenses.rules()) > 200 and all(re.compile(x[3]) for x in licenses.rules())


def examples(pattern, rng):
    """A text that the pattern matches, its alternatives and optional parts taken by chance."""

    def of(tree):
        out = ""
        for op, x in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(x)
            elif name == "IN":
                kind, y = rng.choice(x)
                out += "3" if str(kind) == "CATEGORY" else chr(rng.randint(*y)) if str(kind) == "RANGE" else chr(y)
            elif name == "BRANCH":
                out += of(rng.choice(x[1]))
            elif name == "SUBPATTERN":
                out += of(x[3])
            elif name == "MAX_REPEAT":
                out += "".join(of(x[2]) for _ in range(x[0] + (rng.random() < 0.5 and x[1] > x[0])))
            elif name == "CATEGORY":
                out += "3"
            else:
                assert name == "ASSERT_NOT"
        return out

    return of(re._parser.parse(pattern))


def test_every_license_rule_fires_alone(spark):
    rng = random.Random(6)
    rows, rule = [], {}
    for number, _, _, pattern, *_ in licenses.rules():
        for phrase in {examples(pattern, rng) for _ in range(12)}:
            assert re.fullmatch(pattern, phrase)
            rule[len(rows)] = number
            rows.append((len(rows), "".join(x if x != " " else rng.choice(["\n", "-", " ", ", "]) for x in rng.choice([phrase, phrase.upper(), phrase.title()]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0).cast("long"))
    fired = {(r.doc_id, r.rule) for r in licenses.detect(docs).select("doc_id", "rule").collect()}
    assert [(rows[i], n) for i, n in rule.items() if (i, n) not in fired] == []
    lost = ["Released under the MPL 2.0", "EPL-2.0", "CDDL 1.1", "CeCILL 2.1", "under the WTFPL", "0BSD", "Proprietary and confidential", "public\ndomain", "CC\nBY-SA 4.0", "all-rights-reserved", "the Expat licence"]
    labels = [r.labels for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(lost)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert labels == ["MPL-2.0", "EPL-2.0", "CDDL-1.1", "CeCILL-2.1", "WTFPL", "0BSD", "proprietary", "public-domain", "CC-BY-SA-4.0", "all-rights-reserved", "MIT"]


def test_ordinary_license_forms(spark):
    forms = {
        "GPLv3": "GPL-3.0", "under LGPLv2.1 or so": "LGPL-2.1", "GNU GPL v3+": "GPL-3.0-or-later", "GPLv2+": "GPL-2.0-or-later", "lgpl2.1+": "LGPL-2.1-or-later", "GPL3 or later": "GPL-3.0-or-later", "AGPLv3": "AGPL-3.0", "MPLv2.0": "MPL-2.0",
        "Apache 2.0": "Apache-2.0", "apache-2.0": "Apache-2.0", "Apache v2": "Apache-2.0", "MIT-licensed code": "MIT", "BSD licensed": "BSD", "GPL v2 licensed": "GPL-2.0",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-or-later": "BSD-3-Clause,GPL-2.0-or-later,MIT", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0",
        "SPDX-License-Identifier: GPL-2.0+ OR MIT": "GPL-2.0-or-later,MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "dual licensed under MIT and GPL": "GPL,MIT", "licensed under the GPL or the MIT": "GPL,MIT", "licensed under Apache 2.0 or MIT": "Apache-2.0,MIT", "the MIT License": "mit",
        "mit dem Hund": "", "apache 3 helicopters": "", "3+4 and 2+ apples": "", "general+ public": "",
    }
    rows = list(enumerate(forms))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: ",".join(x for x in got[i].labels.split(",") if x != "Apache") for i, t in rows} == forms
    assert got[[t for _, t in rows].index("3+4 and 2+ apples")].n_words == 5


def test_suppression_is_by_containment_and_priority(spark, monkeypatch):
    """Detections of random places and priorities against a plain version of the rule."""
    rng = random.Random(12)
    priority = {x[0]: x[4] for x in licenses.rules()}
    levels = sorted(set(priority.values()))
    rows = [(d, 0, n, f"L{n}", rng.choice(levels), 0.5, rng.random() < 0.2, a, a + rng.randrange(6)) for d in range(60) for n in range(rng.randrange(9)) for a in [rng.randrange(8)]]
    found = spark.createDataFrame(rows, "doc_id long, key long, rule int, label string, priority int, confidence double, base boolean, first long, last long")
    docs = spark.createDataFrame([(d, "x") for d in range(60)], "doc_id long, text string")
    monkeypatch.setattr(licenses, "text_key", lambda text: F.lit(0).cast("long"))
    monkeypatch.setattr(licenses, "detect", lambda documents: found)
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}

    def order(x):
        return (x[7], -x[8], -x[4], x[2])

    for d in range(60):
        mine = [x for x in rows if x[0] == d]
        kept = {x[3] for x in mine if x[6] or not any(y is not x and not y[6] and order(y) < order(x) and y[4] >= x[4] and y[7] <= x[7] and y[8] >= x[8] for y in mine)}
        assert got[d] == ",".join(sorted(kept))


# ---- passages


def repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            x = data[s : s + length]
            if x in seen:
                gone[s : s + length] = True
            seen.add(x)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_passages(spark, texts):
    df = frame(spark, texts)
    rows = passage_dedup.remove_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == repeats(texts)
    assert rows[0].key == "key" and set(df.columns) <= set(rows[0].asDict())


def test_long_texts_in_segments(spark, monkeypatch):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefghij ") for _ in range(9000))
    rows = [(1, body), (2, "zz" + body[4000:4400] + body + body[100:300]), (3, "é" * 200 + body[:150])]
    segment = 1000
    ids = np.array([2])
    data = np.frombuffer(rows[1][1].encode(), np.uint8)
    whole = passage_dedup.anchor_runs(data, np.array([0, len(data)]), ids)
    starts = np.zeros(len(data), int)
    for begin in range(0, len(data), segment):
        a, b = max(0, begin - 100), min(len(data), begin + segment + 200)
        r = passage_dedup.anchor_runs(data[a:b], np.array([0, b - a]), ids, a, begin - a, begin - a + segment)
        for lo, n in zip(r["lo"], r["n"], strict=True):
            starts[lo : lo + n] += 1
    assert whole["n"].sum() == len(data) - 99 and (starts[: len(data) - 99] == 1).all()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passage_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == repeats(rows)


def test_passages_edges(spark):
    assert passage_dedup.remove_repeats(empty(spark)).count() == 0
    rows = passage_dedup.remove_repeats(frame(spark, [(1, "q" * 120), (1, "q" * 120), (None, "q" * 101), (0, "q" * 99)])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(99, 0), (101, 101), (120, 119), (120, 119)]


def test_passages_of_rows_with_one_id(spark):
    rng = random.Random(14)
    texts = []
    for n in (0, 30, 200, 400):
        x = sentence(rng, 60)
        texts.append(sentence(rng, n) + x + sentence(rng, 40) + x)
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (1, texts[0])]
    got = passage_dedup.remove_repeats(frame(spark, rows)).collect()
    expected = [(i, *repeats([(0, t)])[0]) for i, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(expected, key=str)
    rows = [(None, texts[0]), (None, texts[0] + "x"), (3, texts[0])]
    got = sorted((r.doc_id or 9, r.n_bytes - r.n_removed) for r in passage_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [(3, len(texts[0]) - repeats([(0, texts[0])])[0][1]), (9, 0), (9, 1)]  # the last string of the longer one is new


# ---- packing


def test_packing(spark, texts):
    rows = texts + [(500, "<|endoftext|> it's  'll\n\n\n x"), (501, sentence(random.Random(1), 9000))]
    out = packing.best_fit_packing(frame(spark, rows), TOKENIZER).collect()
    tokens = packing.Tokens(TOKENIZER)
    by_doc, places = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.concatenate([tokens.encode(t or ""), np.zeros(1, "<u4")]).astype("<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048)))
        for r in parts:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert sum(r.length for r in parts) == len(ids)
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(places) <= -(-total // 2048) + 1
    assert packing.best_fit_packing(empty(spark), TOKENIZER).count() == 0


def test_tokens_of_texts_with_added_tokens(spark):
    plain = packing.Tokens(TOKENIZER).tokenizer.__class__.from_file(TOKENIZER)
    rows = [(0, "x <|endoftext|> y"), (1, "<|endoftext|>"), (2, "a<|endoftext|><|endoftext|>b  c"), (3, "<|endoftext |> it's <|endoftext"), (4, "plain words only")]
    assert 50256 in plain.encode(rows[0][1], add_special_tokens=False).ids
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.token_pieces(frame(spark, rows), TOKENIZER).collect()}
    for i, t in rows:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_only_the_first_piece_of_a_document_is_shorter(spark):
    rows = [(n, " word" * (n - 1)) for n in (1, 2047, 2048, 2049, 4096, 5000, 6145)]  # a token each, and the closing one
    got = {}
    for r in packing.token_pieces(frame(spark, rows), TOKENIZER).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert {i: sorted(x) for i, x in got.items()} == {
        1: [(0, 0, 1)], 2047: [(0, 0, 2047)], 2048: [(0, 0, 2048)], 2049: [(0, 0, 1), (1, 1, 2048)], 4096: [(0, 0, 2048), (1, 2048, 2048)],
        5000: [(0, 0, 904), (1, 904, 2048), (2, 2952, 2048)], 6145: [(0, 0, 1), (1, 1, 2048), (2, 2049, 2048), (3, 4097, 2048)],
    }


def test_plan_places_every_piece_once():
    rng = random.Random(3)
    histogram = {rng.randrange(1, 700): rng.randrange(1, 5000) for _ in range(300)} | {2048: 7, 2000: 3}
    room, seen = {}, {x: set() for x in histogram}
    for length, rank, n, first, offset in packing.plan(histogram):
        for i in range(n):
            assert room.get(first + i, 0) == offset
            room[first + i] = offset + length
            seen[length].add(rank + i)
    assert max(room.values()) <= 2048 and all(seen[x] == set(range(c)) for x, c in histogram.items())
    assert len(room) <= sum(x * c for x, c in histogram.items()) / 2048 * 1.02 + 1


# ---- archives


def test_archives(spark, tmp_path):
    pages = [(1, "http://a/x y", "<p>1</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c", "<p>1</p>"), (None, "http://d", "<p>1</p>"), (6, "http://e", "WARC/1.0\r\n\r\n é"), (7, "http://f", "z" * 100_000), (4, "http://c", "<p>1</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_type", F.lit("x"))
    got = archives.archive_pages(df, str(tmp_path / "w")).collect()
    assert len(got) == len(pages)
    for r in got:
        html = {p: (h or "").encode() for p, _, h in pages}[r.page_id]
        assert r.payload_bytes == len(html) and r.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode()
    assert sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in got), key=str) == sorted([(1, "revisit", 4), (2, "revisit", 3), (3, "response", None), (4, "response", None), (4, "response", None), (0, "revisit", 4), (6, "response", None), (7, "response", None)], key=str)
    files = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert len(list(archives.warc_records(files.split(b"\r\n\r\n")[:-1]))) == len(pages)
    assert archives.archive_pages(df.where("false"), str(tmp_path / "e")).count() == 0


def test_arc_versions(spark, tmp_path):
    def arc(version, fields, lines):
        head = f"{version} 0 Test\n{fields}\n"
        out = f"filedesc://x.arc 0.0.0.0 19960923142103 text/plain {'200 - - 0 x.arc ' if version == 2 else ''}{len(head)}\n{head}\n".encode()
        return out + b"\n".join(f"{line} {len(block)}\n".encode() + block for line, block in lines) + b"\n"

    one = arc(1, "URL IP-address Archive-date Content-type Archive-length", [("http://a/ 1.2.3.4 19970101 text/html; charset=x", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello"), ("dns:a 1.2.3.4 19970101120000 text/dns", b"record")])
    two = arc(2, "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length", [("http://b/ 1.2.3.4 20010203040506 text/html 200 c - 7 f", b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\nx")])
    (tmp_path / "1.arc").write_bytes(one)
    (tmp_path / "2.arc.gz").write_bytes(gzip.compress(two[:40]) + gzip.compress(two[40:]))
    got = {r.target_uri: r for r in archives.read_arc(spark, str(tmp_path / "*.arc*")).collect()}
    assert bytes(got["http://a/"].payload) == b"hello" and got["http://a/"].date == "1997-01-01T00:00:00Z" and got["http://a/"].record_type == "response"
    assert got["dns:a"].record_type == "resource" and got["http://b/"].date == "2001-02-03T04:05:06Z" and bytes(got["http://b/"].payload) == b"\r\n\r\nx"
    with pytest.raises(ValueError, match="declares"):
        list(archives.arc_records(one[:-3]))


def test_arc_files_are_read_as_streams(spark, tmp_path):
    """Plain files that Spark cuts into many parts, and a file of many gzip members; any bytes in blocks."""
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 256, int(n), np.uint8).tobytes() for n in rng.integers(0, 4000, 300)] + [b"", b"\n", b"\r\n\r\n", b"x" * 300_000]
    records = [f"dns:h{i} 1.2.3.4 19970101120000 text/dns {len(b)}\n".encode() + b + b"\n" for i, b in enumerate(blocks)]
    (tmp_path / "a.arc").write_bytes(b"".join(records[:150]))
    (tmp_path / "b.arc").write_bytes(b"".join(records[150:200]).rstrip(b"\n") + b"\n" if records[199][-2:] != b"\n\n" else b"".join(records[150:200]))
    (tmp_path / "c.arc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[200:]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.target_uri: bytes(r.payload) for r in archives.read_arc(spark, str(tmp_path / "*.arc*")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {f"dns:h{i}": b for i, b in enumerate(blocks)}
    lines = [(1, x) for x in (records[0] + records[3]).split(b"\n")]
    assert [r["block"] for r in archives.arc_stream(lines)] == [blocks[0], blocks[3]]
    with pytest.raises(ValueError, match="declares"):
        list(archives.arc_stream([(1, b"dns:h 1.2.3.4 19970101120000 text/dns 50"), (1, b"short"), (2, b"")]))
    with pytest.raises(ValueError, match="contradicts"):
        list(archives.arc_stream([(1, b"dns:h 1.2.3.4 19970101120000 text/dns 5"), (1, b"much longer")]))
    (tmp_path / "e.arc").write_bytes(b"")
    assert archives.read_arc(spark, str(tmp_path / "e.arc")).count() == 0


# ---- main text


PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><a href=/>Site</a> Banner text</header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav><div id="cookie-notice"><p>We use cookies and this is a rather long notice about it.</p></div>
<div class="wrap"><article><header><h1>A &amp; B</h1></header><p>First   paragraph with <b>bold</b> and <a href=x>a link</a>.<br>Same one.<p>Second &eacute; paragraph<div class="share-box">Share this</div><blockquote>Quoted text here.</blockquote>
<form><p>Subscribe</p><input></form><ul><li>Item one of the list</li><li>Item two of the list</ul><aside>Related things</aside></article><div class="sidebar"><p>Side text that is quite long as well, to be sure.</p></div><section id="comments"><p>A reader's comment that is long enough.</p></section></div><footer>&copy; x</footer>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "plain &lt;text&gt;"), (5, None, "<p>" * 3000 + "x")], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = {r.page_id: r for r in main_text.extract_main_text(pages).collect()}
    assert got[1].text.split("\n") == ["A & B", "First paragraph with bold and a link. Same one.", "Second é paragraph", "Quoted text here.", "Item one of the list", "Item two of the list"]
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("", "", "plain <text>", "x")
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[1].url == "u"
    assert main_text.extract_main_text(pages.where("false")).count() == 0


def test_main_text_keeps_what_only_sounds_like_a_menu():
    body = "<h2 id='related-work'>Related work</h2><p>A paragraph of the article that is long enough.</p><h2 id=comments>Comments on it</h2><figure><img src=x><figcaption>What the picture shows.</figcaption></figure><p id='search-for-survivors'>Another one.</p>"
    lines = ["Related work", "A paragraph of the article that is long enough.", "Comments on it", "What the picture shows.", "Another one."]
    for name in ("has-sidebar", "with-sidebar", "no-sidebar", "withSidebar", "share-prices", "comments-on-the-bill", "sidebar", "page popup", "ad"):
        assert main_text.main_text(f"<body><div class='{name}'><article>{body}</article></div></body>").split("\n") == lines, name
    for name in ("sidebar", "share-box", "post-comments", "no-menu sidebar", "relatedLinks"):
        assert main_text.main_text(f"<body><article>{body}</article><div class='{name}'><p>Something else that isn't of the article at all.</p></div></body>").split("\n") == lines, name
    comments = "<section id=comments><article><p>A reader's comment that is rather long, as some are.</p></article></section>"
    assert main_text.main_text(f"<main><article>{body}</article>{comments}</main>").split("\n") == lines
    assert main_text.main_text(f"<div id=skip><div class=overlay><main>{body}</main></div></div>").split("\n") == lines
    for hidden in ("<nav>{}</nav>", "<div hidden>{}</div>", "<div style='display:none'>{}</div>"):
        assert main_text.main_text(f"<body>{hidden.format('<article><p>A teaser.</p></article>')}<article>{body}</article></body>").split("\n") == lines


# ---- classifier and language


def test_quality(spark):
    rng = random.Random(7)
    good = [(i, sentence(rng, 40).capitalize() + ".") for i in range(300)]
    bad = [(1000 + i, " ".join(x.upper() + "!!" for x in sentence(rng, 40).split())) for i in range(300)]
    docs = frame(spark, good + bad + [(5000, None), (5001, ""), (None, "x"), (1, good[1][1])])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is None or binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    tested = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert np.mean([r.predicted == int(r.doc_id < 1000) for r in tested]) > 0.95
    assert quality.classify(docs, quality.fit(docs, labels.where("false"))).where("predicted = 0").count() == 0
    assert quality.classify(empty(spark), quality.fit(empty(spark), labels)).count() == 0
    assert quality.keep_good(docs, quality.fit(docs, labels)).columns == docs.columns


def test_quality_sample_has_one_row_of_each_id(spark):
    rng = random.Random(12)
    good = [(i, sentence(rng, 30).capitalize() + ".") for i in range(40)]
    bad = [(100 + i, " ".join(x.upper() + "!!" for x in sentence(rng, 30).split())) for i in range(40)]
    docs = frame(spark, good + bad * 8 + [(i, bad[0][1]) for i, _ in bad])
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample_per_label=20)
    assert np.bincount(model.labels).tolist() == [20, 20]
    out = {r.doc_id: r.predicted for r in quality.classify(docs, model).collect()}
    assert np.mean([out[i] == 1 for i, _ in good]) > 0.9 and np.mean([out[i] == 0 for i, _ in bad]) > 0.9


def test_language(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ño", "ción", "os", "la"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(rng.randrange(3, 30))), x) for i, x in enumerate(rng.choices(list(syllables), k=600))]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 ... 😀", "aa"), (902, "", None), (903, "balo", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(3))
    out = {r.doc_id: r for r in language.identify(df, language.fit(df)).collect()}
    assert np.mean([out[i].lang_pred == x for i, _, x in rows if out[i].held_out]) > 0.98
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and all(0 <= r.score <= 1 for r in out.values())
    assert language.identify(df, language.fit(df.where("false"))).where("lang_pred <> 'und'").count() == 0
    strange = spark.createDataFrame([(1, "zzzz qqqq xxxx wwww jjjj")], "doc_id long, text string")
    assert language.identify(strange, language.fit(df)).first().rejected


# ---- search


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.round(rng.standard_normal(6), 2)]) for i in range(120)] + [(200 + i, [0.5] * 6) for i in range(60)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [1.0, 2.0]), (320, [3.0, 1.0]), (None, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(4)
    got = {}
    for r in topk_search.top_k(df, df.where("vec_id % 20 = 0"), 20, shard_rows=32, block_rows=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in good if i % 20 == 0]:
        scores = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:20]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert topk_search.top_k(df.where("false"), df.where("false")).count() == 0
    assert topk_search.top_k(df, df.where("false")).count() == 0
