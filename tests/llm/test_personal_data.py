"""Personal data: the plain patterns against regular expressions over whole texts, the best
segmentation against all segmentations, and the model on lines that it hasn't seen."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import personal_data as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def card(x):
        d = [int(c) for c in re.sub("[^0-9]", "", x)]
        return 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(reversed(d))) % 10 == 0

    tests = (lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")), card, lambda x: 10 <= len(re.sub("[^0-9]", "", x)) <= 15)
    return sorted((m.start(), k, m.end()) for k, (pattern, good) in enumerate(zip((EMAIL, IP, CARD, PHONE), tests, strict=True)) for m in pattern.finditer(text) if good(m.group()))


def odd_texts(n):
    rng = random.Random(5)
    pieces = ["a@b.c", "x.y@", "@", "b.com", "1.2.3.4", "256.1.1.1", ".", "..", "-", "+", "(", ")", " ", "4111111111111111", "4111 1111 1111 1111", "+1 (743) 555-3824", "é", "٣", "007", "_", "%", "[at]", " [dot] ", "a", "0000000001.2.3.4", "+", "12", "\n"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_plain_patterns():
    for text in odd_texts(6000):
        assert P.plain_spans(text, P.regions(text)) == plain(text), text


@pytest.fixture(scope="module")
def model():
    return P.train(P.generated(P.GENERATED))


def test_best_segmentation_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        scored = [(i, j, k, float(rng.normal())) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) for k in range(4) if rng.random() < 0.4]
        t = rng.normal(size=(5, 5))

        def every(at, scored=scored, n=n):
            if at == n:
                yield []
                return
            for x in [(at, at + 1, None, 0.0), *(c for c in scored if c[0] == at)]:
                yield from ([x, *rest] for rest in every(x[1]))

        def value(path, t=t):
            labels = [0, *(0 if x[2] is None else x[2] + 1 for x in path)]
            return sum(x[3] for x in path) + sum(t[a, b] for a, b in itertools.pairwise(labels))

        paths = list(every(0))
        best = [(i, j, k) for i, j, k, _ in max(paths, key=value) if k is not None]
        assert P.best_segments(n, scored, t) == best
        p, pairs = P._expectations(n, [x[:3] for x in scored], np.array([x[3] for x in scored]), t)
        weight = np.exp([value(x) for x in paths])
        weight /= weight.sum()
        assert np.allclose(p, [sum(w for w, x in zip(weight, paths, strict=True) if c in x) for c in scored])
        assert np.isclose(pairs.sum(), sum(w * len(x) for w, x in zip(weight, paths, strict=True)))


def test_unseen_lines(model):
    right = found = true = 0
    for text, spans in P.generated(800, seed=99):
        got = set(model.spans(text, P.regions(text)))
        right, found, true = right + len(got & set(spans)), found + len(got), true + len(spans)
    assert right / found > 0.98 and right / true > 0.97


def test_neighbours_that_the_patterns_run_together(spark, model):
    rows = [(1, "on 4465758382889437 4465758382889437 go"), (2, "by +1 (826) 555-4081 190.137.223.204."), (3, "4. 1990-1995, 2024-01-31 and 44657 or 9807915762804490"), (4, "bob.ray [at] example [dot] com"), (5, "x@y.org 10.0.0.1")]
    got = {r.doc_id: r for r in P.digests(P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), model)).collect()}
    assert got[1].spans == "card:3:19,card:20:36" and got[1].n_card == 0
    assert got[2].spans == "phone:3:20,ip:21:36" and (got[2].n_phone, got[2].n_ip) == (0, 1)
    assert got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].spans == "email:0:30" and got[5].spans == "email:0:7,ip:8:16"
    assert got[5].base_sha256 == hashlib.sha256(b"email:0:7,ip:8:16").hexdigest()


def test_personal_data_on_tables(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(200))] + [(500, None), (501, ""), (502, "a b@c.de"), (502, "a b@c.de"), (None, "+1 (743) 555-3824")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("spans", "base", "kind", "start", "line")}).repartition(3)
    model = P.fit(df)
    found = P.find_personal_data(df, model)
    got = sorted((tuple(r) for r in P.digests(found).collect()), key=repr)
    assert len(got) == len(rows)
    want = sorted(((i, *(sum(k == n for _, k, _ in plain(t or "")) for n in range(4)), hashlib.sha256(",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in plain(t or "")).encode()).hexdigest()) for i, t in rows), key=repr)
    assert [r[:6] for r in got] == want
    for r in got:
        kept = {x for x in r[6].split(",") if x}
        assert {f"{P.KINDS[k]}:{s}:{e}" for s, k, e in plain(dict(rows).get(r[0]) or "")} <= kept or r[0] is None
    out = P.masked(df.where("doc_id = 502").limit(1), found.where("doc_id = 502").limit(1)).first()
    assert out.text == "a <email>"
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.digests(P.find_personal_data(none, P.fit(none))).count() == 0


@pytest.mark.parametrize("text", ["1" * 300_000, "1 " * 50_000, "(" * 300_000, "@" * 300_000, "a" * 300_000 + "@b", "1." * 30_000, "a@" * 50_000, "+1" * 50_000, "1-2." * 20_000])
def test_endless_texts(model, text):
    started = time.time()
    found = P.regions(text)
    assert P.plain_spans(text, found) is not None and model.spans(text, found) is not None and time.time() - started < 20
