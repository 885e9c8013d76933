"""Importance resampling against a plain version that hashes every n-gram by itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, *, grams, buckets, percent=10, least=20):
    def features(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    rows = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in features(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets)))) for b in range(buckets)]
    out, able = {}, []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(f), w, score, None]
        able += [(-score, i)] if n >= least else []
    for r, (_, i) in enumerate(sorted(able)[: len(able) * percent // 100], 1):
        out[i][3] = r
    return {i: tuple(x) for i, x in out.items()}


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "café", "x9", "日本", "a" * 40, f"w{rng.randrange(50)}"])
    return [(i, rng.choice([None, "", "!!"]) if i % 9 == 0 else rng.choice([" ", "-- ", "\n"]).join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize(("grams", "buckets"), [(1, 10_000), (3, 257), (2, 100_000)])
def test_resampling_is_the_plain_one(spark, grams, buckets):
    rows, target = texts(grams, 150), [t for _, t in texts(7, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("score", "weight", "n_words", "features", "bucket", "position", "n")}).repartition(3)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), grams=grams, buckets=buckets)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == plain(rows, target, grams=grams, buckets=buckets)


def test_crcs_of_a_text_longer_than_a_chunk():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"abcdef\xc3", k=rng.choice([1, 2, 5, 300]))) for _ in range(resampling._CHUNK + 500)]
    data = b"  ".join(words)
    end = np.cumsum([len(w) + 2 for w in words]) - 2
    begin = end - np.array([len(w) for w in words])
    got = Counter(np.concatenate(list(resampling.document_crcs(data, begin, end, 3))).tolist())
    assert got == Counter(zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    few = list(resampling.document_crcs(b"x", np.array([0]), np.array([1]), 4))
    assert np.concatenate(few).tolist() == [zlib.crc32(b"x")]


def test_resampling_edges(spark):
    target = spark.createDataFrame([("a b",), (None,)], "text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, target).count() == 0
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long)] * 15 + [(2, long), (None, long), (None, None), (3, "a")] + [(i, long) for i in range(10, 23)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), target.where("false")).collect()
    assert len(got) == len(rows) and sorted(r.rank for r in got if r.rank) == [1, 2, 3] and {r.n_features for r in got if r.doc_id == 1} == {30}
    best = sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.n_features >= 20)[:3]
    assert best == sorted((-r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank)
    assert [r.weight for r in got if r.n_features == 0] == [0]
