"""The join of token sets: candidates and copies aren't shuffled, and every pair is found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import text_join

SCHEMA = "id long, g string, t array<string>"


def brute(rows, least, shared):
    out = {}
    for i, (a, g, s) in enumerate(rows):
        for b, h, t in rows[i + 1 :]:
            n = len(set(s) & set(t))
            if g is not None and g == h and n >= shared and n / len(set(s) | set(t)) >= least:
                out[min(a, b), max(a, b)] = (n, n / len(set(s) | set(t)))
    return out


def random_rows(rng, n):
    """Sets of frequent and rare tokens, near copies and copies, in two groups and none."""
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            old = rng.choice(rows)[2]
            t = [x for x in old if rng.random() < 0.85] + [f"r{rng.randrange(400)}" for _ in range(rng.randrange(3))] if rng.random() < 0.7 else old
        else:
            t = [f"f{min(int(rng.expovariate(0.4)), 12)}" for _ in range(rng.randrange(8))] + [f"r{rng.randrange(400)}" for _ in range(rng.randrange(9))]
        rows.append((i, rng.choice(["g", "g", "h", None]), sorted(set(t))))
    rng.shuffle(rows)
    return rows


def shuffled(spark):
    """Rows that were written to shuffles so far."""
    empty = spark._jvm.java.util.ArrayList
    stages = spark._jsc.sc().statusStore().stageList(empty(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), empty())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_candidates_are_not_shuffled(spark):
    """Sets that share a token of what was their prefix, but too little after it."""
    rows = [(i, "g", [f"u{i}-{k}" for k in range(6)] + ["a", "b", "c", "d"]) for i in range(600)] + [(1000, "g", ["u7-0", "u7-1", "u7-2", "u7-3", "a", "b"])]
    before = shuffled(spark)
    got = text_join.similar_token_sets(spark.createDataFrame(rows, SCHEMA), "id", "g", "t", least=0.35, shared=2).collect()
    assert [(r.a, r.b, r.shared, r.jaccard) for r in got] == [(7, 1000, 6, 0.6)]
    assert shuffled(spark) - before < 60_000  # 6,006 tokens; the sets are 179,700 pairs


def test_pairs_of_a_large_class_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(text_join, "SLICE", 16, raising=False)
    monkeypatch.setattr(text_join, "TASK_ROWS", 1000, raising=False)
    rows = [(i, "g", ["a", "b", "c"]) for i in range(300)] + [(300 + i, "g", ["a", "b", "d"]) for i in range(5)]
    out = text_join.similar_token_sets(spark.createDataFrame(rows, SCHEMA), "id", "g", "t", least=0.5, shared=2)
    counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 305 * 304 // 2 and max(counts) < 6000
    assert out.distinct().count() == sum(counts)


@pytest.mark.parametrize("least, shared", [(0.35, 2), (0.6, 1), (0.0, 1), (1.0, 1)])
def test_pairs_of_packs_against_all_pairs(spark, monkeypatch, least, shared):
    rows = random_rows(random.Random(f"{least}"), 260)
    monkeypatch.setattr(text_join, "PACK_TOKENS", 90, raising=False)
    monkeypatch.setattr(text_join, "SLICE", 3, raising=False)
    got = text_join.similar_token_sets(spark.createDataFrame(rows, SCHEMA), "id", "g", "t", least=least, shared=shared).collect()
    assert {(r.a, r.b): (r.shared, r.jaccard) for r in got} == brute(rows, least, shared) and len(got) == len(brute(rows, least, shared))


@pytest.mark.parametrize("together, flags", [(1, 1), (7, 60), (1 << 19, 8 << 20)])
def test_small_parts_of_a_pair_of_packs(monkeypatch, together, flags):
    monkeypatch.setattr(text_join, "TOGETHER", together)
    monkeypatch.setattr(text_join, "FLAGS", flags)
    rows = [r for r in random_rows(random.Random(11), 200) if r[1] == "g" and r[2]]
    names = sorted({x for *_, t in rows for x in t}, key=lambda x: (sum(x in t for *_, t in rows), x))
    packs = []
    for part in (rows[::2], rows[1::2]):
        sets = [sorted(names.index(x) for x in t) for *_, t in part]
        packs.append((np.array([i for i, *_ in part]), np.array([len(s) for s in sets]), np.concatenate(sets)))
    got = {}
    for one, two, same in ((0, 0, True), (0, 1, False), (1, 1, True)):
        for a, b, n, j in text_join._similar(packs[one], packs[two], same, 0.35, 2):
            for x, y, *found in zip(a.tolist(), b.tolist(), n.tolist(), j.tolist(), strict=True):
                assert (min(x, y), max(x, y)) not in got
                got[min(x, y), max(x, y)] = tuple(found)
    assert got == brute(rows, 0.35, 2)
