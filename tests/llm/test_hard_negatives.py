"""Hard negatives: Strassen's products against plain ones, heaps against sorting, and the whole
operator against a plain search over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import hard_negatives as H
from spindrift.llm import topk_search


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 50), (64, 64, 64), (100, 7, 300), (0, 5, 3), (5, 0, 3), (130, 64, 70)])
def test_strassen(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = rng.integers(-(1 << 20), 1 << 20, (m, k)), rng.integers(-(1 << 20), 1 << 20, (k, n))
    assert (H.strassen(a, b) == a @ b).all() and H.strassen(a, b).shape == (m, n)
    assert (H.strassen(a, b, 4) == a @ b).all()
    big = rng.integers(-(1 << 60), 1 << 60, (m, k)), np.eye(k, n, dtype=np.int64)
    assert (H.strassen(*big, 4) == big[0] @ big[1]).all()  # sums on the way wrap, the products fit


def test_products_beyond_64_bits():
    a = np.full((2, 4), 1 << 31, np.int64)
    b = np.array([[1 << 31, -(1 << 31), 1 << 31, -(1 << 31)], [1 << 29] * 4])
    for product in (H.products, topk_search._product):
        assert product(a, b).tolist() == [[0, 1 << 62], [0, 1 << 62]]
        with pytest.raises(OverflowError):
            product(a, a)


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    rows = np.stack([rng.integers(0, 4, 300), rng.integers(-5, 5, 300), rng.integers(0, 40, 300)])
    want = H.merged(*rows, 3)
    plain = [(o, s, i) for o in range(4) for s, i in sorted({(s, i) for p, s, i in rows.T.tolist() if p == o}, key=lambda x: (-x[0], x[1]))[:3]]
    assert list(zip(*(x.tolist() for x in want), strict=True)) == plain
    parts = [H.merged(*rows[:, i::7], 3) for i in range(7)]
    assert all((a == b).all() for a, b in zip(H.merged(*(np.concatenate(x) for x in zip(*parts, strict=True)), 3), want, strict=True))


def plain(rows, is_anchor, positives=5, negatives=3):
    good = sorted({(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for a, lab, v in good:
        if not is_anchor(a):
            continue
        near = sorted({(-sum(map(int.__mul__, v, w)), i, m == lab) for i, m, w in good if i != a and len(v) == len(w)})
        for s, i, _ in [x for x in near if x[2]][:positives]:
            p = -s
            hit = [x for x in near if not x[2] and 50 * p <= -100 * x[0] <= 95 * p][:negatives]
            out |= {(a, i, r, n, p, -t) for r, (t, n, _) in enumerate(hit, 1)}
    return out


@pytest.mark.parametrize(("seed", "grid"), [(1, 4), (2, 1)])
def test_hard_negatives_are_the_plain_ones(spark, monkeypatch, seed, grid):
    rng = random.Random(seed)
    monkeypatch.setattr(H, "TOGETHER", grid)
    vector = lambda: [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)]  # noqa: E731  many ties
    rows = [(i, vector(), 3 if rng.random() < 0.4 else rng.randrange(8)) for i in range(300)]
    rows += [(1000, None, 1), (1001, [1.0, None] + [0.0] * 4, 1), (1002, [float("nan")] * 6, 1), (1003, [float("inf")] * 6, 1), (1004, [1.0] * 6, None), (None, [1.0] * 6, 3), (1005, [1.0, 1.0], 3), (1006, [1.0, 1.0], 3), (1007, [0.75, 1.0], 4), (1010, [1.0, 0.5], 3), (1020, [], 3)]
    rows += [rows[7]] * 30 + [rows[20]] * 3  # copies, one of an anchor
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(c) for c in ("id", "v", "bucket", "key", "score", "owner", "rank", "a.b")}).repartition(5)
    anchor = lambda i: i % 10 == 0
    got = H.mine_hard_negatives(df, df.where("vec_id % 10 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows, anchor))


def test_hard_negatives_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    some = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert H.mine_hard_negatives(none, none).count() == 0
    assert H.mine_hard_negatives(some, none).count() == 0
    assert H.mine_hard_negatives(some, some).count() == 0  # nobody has a positive
    with pytest.raises(Exception, match="beyond"):
        topk_search.top_k(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), spark.createDataFrame([(2, [1.0])], "vec_id long, embedding array<float>"), 1).collect()
