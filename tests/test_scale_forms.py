"""The forms that large groups need, against plain ones: packs of vectors, running sums, streams."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import clusters, feeds, handoff, ordering, quota, similarity
from spindrift.sources import tables
from spindrift.streaming import streams


@pytest.mark.parametrize("together", [100, 1, 2])
def test_neighbours_of_a_hot_scope(spark, monkeypatch, together):
    monkeypatch.setattr(similarity._packs, "__defaults__", (16, ("id", "seconds"), None))
    monkeypatch.setattr(similarity, "TOGETHER", together)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 6))
    base[40] = base[41] = base[42]  # ties
    rows = [(i, None if i % 3 == 0 else "a", int(rng.integers(0, 400)), [float(x) for x in v]) for i, v in enumerate(base)] + [(200, "a", None, [1.0] * 6), (201, "a", 5, None), (202, "a", 5, [0.0] * 6)]
    df = spark.createDataFrame(rows, "article_id long, scope string, h int, embedding array<double>").withColumn("published_at", F.when(F.col("h").isNotNull(), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.col("h"))))
    got = {}
    for r in similarity.neighbours(df, k=4, hours=48).collect():
        got.setdefault(r.article_id, []).append((r.rank, r.neighbour_id, round(r.similarity, 9)))
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    for i, s, h, _ in rows[:150]:
        near = sorted((-round(float(unit[i] @ unit[j]), 12), j) for j, t, g, _ in rows[:150] if j != i and t == s and abs(h - g) <= 48)[:4]
        assert sorted(got.get(i, [])) == [(n, j, round(-x, 9)) for n, (x, j) in enumerate(near, 1)]
    assert not {200, 201, 202} & set(got)


def test_largest_similarity_of_large_clusters(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 4)), i, [float(x) for x in rng.standard_normal(5)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "cluster_id long, article_id long, embedding array<double>")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "a long, b long")
    unit = {i: np.array(v) / np.linalg.norm(v) for _, i, v in rows}
    for r in similarity.max_pair_similarity(pairs, df).collect():
        x, y = (np.array([unit[i] for c, i, _ in rows if c == k]) for k in (r.a, r.b))
        assert abs(r.max_pair - (x @ y.T).max()) < 1e-9


def vectors(rng, n, scopes="aab", hours=400, dims=6):
    v = rng.standard_normal((n, dims))
    rows = [(i, scopes[i % len(scopes)], int(rng.integers(0, hours)), [float(x) for x in v[i]], f"s{i % 4}") for i in range(n)]
    return rows, v / np.linalg.norm(v, axis=1)[:, None]


def article_frame(spark, rows):
    df = spark.createDataFrame(rows, "article_id long, scope string, h int, embedding array<double>, source string")
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.col("h"))
    return df.withColumns({"published_at": at, "created_at": at, "title": F.lit("t")})


def test_a_second_run_compares_only_new_articles(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows, unit = vectors(rng, 240)
    a, root = article_frame(spark, rows), str(tmp_path / "index")
    similarity.store_vectors(a.where("article_id < 200"), root, "1")
    similarity.store_vectors(a.where("article_id < 200"), root, "1")  # a repeated run
    new = a.where("article_id >= 200")
    got = {}
    for r in similarity.neighbours(new, k=4, index=root).collect():
        got.setdefault(r.article_id, []).append((r.rank, r.neighbour_id))
    for i, s, h, _, _ in rows:
        near = sorted((-round(float(unit[i] @ unit[j]), 12), j) for j, t, g, _, _ in rows if j != i and t == s and abs(h - g) <= 48)[:4]
        assert sorted(got.get(i, [])) == ([(n, j) for n, (_, j) in enumerate(near, 1)] if i >= 200 else [])
    packs = similarity.article_packs(new)[0]
    low, high = packs.agg(F.min("block"), F.max("block")).first()
    pairs = similarity.pack_pairs(packs, packs.unionByName(similarity.stored_vectors(spark, root, low - 1, high + 1)), False)
    compared = sum(len(r.id) * len(r.id2) // 64 for r in pairs.select("id", "id2").collect())
    assert compared <= 40 * 240  # each new article with all at most, no stored one with another
    near_only = similarity.stored_vectors(spark, root, 0, 0)
    assert near_only.inputFiles() and "PartitionFilters: [isnotnull(block" in near_only._jdf.queryExecution().executedPlan().toString()


def test_assignment_of_new_articles(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows, _ = vectors(rng, 120, scopes="a", hours=200)
    a, root = article_frame(spark, rows), str(tmp_path / "index")
    rules = {"cross": 0.6, "same": 0.7}
    similarity.store_vectors(a.where("article_id % 3 <> 2"), root, "1")
    first = tables.written(clusters.assign(a.where("article_id % 3 <> 2"), **rules), "first")
    known = a.join(first, "article_id", "left")
    whole = {r.article_id: r.cluster_id for r in clusters.assign(known, **rules).collect()}
    new = {r.article_id: r.cluster_id for r in clusters.assign_new(known, root, "2", **rules).collect()}
    assert new == {i: c for i, c in whole.items() if i % 3 == 2} and any(c != i for i, c in new.items())
    assert sum(len(r.id) // 8 for r in spark.read.parquet(root).select("id").collect()) == 120


@pytest.mark.parametrize("together", [100, 1])
def test_bounds_leave_out_only_what_cannot_merge(spark, monkeypatch, together):
    monkeypatch.setattr(similarity, "PACK_ROWS", 16)
    monkeypatch.setattr(similarity, "TOGETHER", together)
    rng = np.random.default_rng(10)
    rows, unit = vectors(rng, 160, hours=150)
    df = article_frame(spark, rows).withColumn("cluster_id", F.when(F.col("article_id") % 2 == 0, F.col("article_id")).otherwise(F.floor(F.col("article_id") / 6) * 6))
    own = {i: (i if i % 2 == 0 else i // 6 * 6) for i, *_ in rows}
    df = df.withColumn("scope", F.lit("a"))
    c = clusters.cluster_attributes(df)
    rules = clusters.MergeRules(centroid=0.7, pair=0.75, soft=0.6)
    scores = tables.written(clusters.merge_scores(c, df, rules), "scores")
    got = {(r.a, r.b): (round(r.centroid_sim, 9), round(r.max_pair, 9)) for r in scores.collect()}
    window = {r.cluster_id: (r.first_published_at, r.last_published_at) for r in c.collect()}
    members = {k: np.array([unit[i] for i in own if own[i] == k]) for k in window}
    centre = {k: v.mean(0) / np.linalg.norm(v.mean(0)) for k, v in members.items()}
    pairs = {(r.a, r.b) for r in similarity.overlapping_pairs(c).collect()}
    want = {p: (round(float(centre[p[0]] @ centre[p[1]]), 9), round(float((members[p[0]] @ members[p[1]].T).max()), 9)) for p in pairs}
    assert set(got) <= pairs and all(np.allclose(got[p], want[p], atol=1e-8) for p in got)
    left_out = [want[p] for p in pairs - set(got)]
    assert left_out and all(s < 0.6 and m < 0.75 for s, m in left_out)
    assert {(r.a, r.b) for r in scores.where("merge").collect()} >= {p for p, (s, m) in want.items() if s >= 0.7 + 1e-9 or m >= 0.75 + 1e-9}


@pytest.mark.parametrize("together", [100, 1])
def test_pairs_of_clusters_come_with_their_members_similarity(spark, monkeypatch, together):
    monkeypatch.setattr(similarity, "PACK_ROWS", 16)
    monkeypatch.setattr(similarity, "SLICE", 8)  # the large cluster is several rows of packs
    monkeypatch.setattr(similarity, "TOGETHER", together)
    rows, unit = vectors(np.random.default_rng(14), 150, hours=300)
    own = {i: 0 if i < 40 else i // 3 for i, *_ in rows}
    df = article_frame(spark, rows).withColumn("cluster_id", F.when(F.col("article_id") < 40, 0).otherwise(F.floor(F.col("article_id") / 3))).withColumn("scope", F.lit(None).cast("string"))
    c = clusters.cluster_attributes(df)
    members = {k: np.array([unit[i] for i in own if own[i] == k]) for k in set(own.values())}
    want = {(r.a, r.b): (members[r.a] @ members[r.b].T).max() for r in similarity.overlapping_pairs(c).collect()}
    got = similarity.pair_similarities(c, df).collect()
    assert len(got) == len(want) and all(abs(want[r.a, r.b] - r.max_pair) < 1e-9 for r in got)
    close = similarity.close_clusters(c, df, hours=48, centroid=2.0, pair=0.9, soft=2.0).collect()  # a row for pairs that can merge only
    assert {(r.a, r.b) for r in close} == {p for p, x in want.items() if x >= 0.9} and 0 < len(close) < len(want)
    assert all(abs(want[r.a, r.b] - r.max_pair) < 1e-9 for r in close)


def test_copies_of_packs_are_bounded():
    assert similarity._grid(0, 0) == similarity._grid(4, 90) == 1
    assert [similarity._grid(n, n) for n in (8, 32, 400, 40_000)] == [2, 8, 8, 8]  # one hot group, however large
    assert similarity._grid(40, 8000) == 2  # many groups are keys enough


def test_packs_come_to_python_in_small_batches(spark):
    rows, _ = vectors(np.random.default_rng(3), 30)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    similarity.neighbours(article_frame(spark, rows), k=2)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == similarity.BATCH_BYTES <= 8 << 20


def test_survivors(spark):
    groups = spark.createDataFrame([(1, 1, 5, None), (2, 1, 7, 1), (3, 1, 7, 2), (4, 1, 7, 2), (5, 5, 1, None)], "id long, component long, n int, day int").withColumn("at", F.timestamp_seconds(F.col("day") * 86400))
    got = clusters.survivors(groups, -F.col("n"), *clusters._latest_first("at")).collect()
    assert {(r.id, r.survivor) for r in got} == {(1, 3), (2, 3), (3, 3), (4, 3), (5, 5)}


def test_centroids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (4, [0.0, 5.0])]
    got = {r.k: r.centroid for r in similarity.centroids(spark.createDataFrame(rows, "k int, embedding array<float>"), "k").collect()}
    assert np.allclose(got[1], [0.5**0.5] * 2) and got[2] is None and 3 not in got and np.allclose(got[4], [0, 1])


def test_approximate_neighbours_find_nearly_all(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 12))
    rows = [(i, "a", [float(x) for x in base[i % 40] + 0.25 * rng.standard_normal(12)]) for i in range(200)]
    df = spark.createDataFrame(rows, "article_id long, scope string, embedding array<double>").withColumn("published_at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    unit = np.array([v for *_, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    exact = {(i, j) for i in range(200) for j in range(i + 1, 200) if unit[i] @ unit[j] >= 0.85}
    found = {(r.a, r.b) for r in similarity.approximate_neighbours(df, least=0.85).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)


def test_approximate_neighbours_meet_as_packs_of_a_time(spark):
    rows = [(i, None if i % 2 else "a", None if i == 6 else i * 30, [1.0, 0.001 * i, 0.5]) for i in range(12)]
    df = spark.createDataFrame(rows, "article_id long, scope string, h int, embedding array<float>").withColumn("published_at", F.when(F.col("h").isNotNull(), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.col("h"))))
    out = similarity.approximate_neighbours(df, least=0.85, hours=60)
    assert {(r.a, r.b) for r in out.collect()} == {(i, i + 2) for i in range(10) if 6 not in (i, i + 2)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashValue" not in plan and "MapInArrow" in plan  # no row for each pair of one bucket


@pytest.mark.parametrize("together", [100, 1])
def test_listed_neighbours(spark, monkeypatch, tmp_path, together):
    """With all lists probed nothing is missed; with some, most is found; pairs are never wrong."""
    monkeypatch.setattr(similarity, "TOGETHER", together)
    monkeypatch.setattr(similarity._packs, "__defaults__", (16, ("id", "seconds"), None))
    rng = np.random.default_rng(11)
    base = rng.standard_normal((12, 8))
    rows = [(i, None if i % 5 == 0 else "a", int(rng.integers(0, 150)), [float(x) for x in base[i % 12] + 0.4 * rng.standard_normal(8)], "s") for i in range(260)]
    df = article_frame(spark, rows)
    unit = np.array([v for _, _, _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    exact = {(i, j) for i, s, h, _, _ in rows for j, t, g, _, _ in rows if i < j and s == t and abs(h - g) <= 48 and unit[i] @ unit[j] >= 0.8}
    similarity.store_lists(df, str(tmp_path / "x"), lists=8, copies=1)
    for probes, share in ((8, 1.0), (2, 0.9)):
        got = {(r.a, r.b): r.similarity for r in similarity.listed_neighbours(df, str(tmp_path / "x"), least=0.8, probes=probes).collect()}
        assert set(got) <= exact and len(got) >= share * len(exact) > 50
    assert similarity.listed_neighbours(df.where("false"), str(tmp_path / "x"), least=0.8).count() == 0
    similarity.store_lists(df.where("false"), str(tmp_path / "none"))
    assert similarity.listed_neighbours(df, str(tmp_path / "none"), least=0.8).count() == 0


def test_lists_hold_floats_and_give_a_pair_once(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(i, "a", int(rng.integers(0, 150)), [float(x) for x in rng.standard_normal(8)], "s") for i in range(200)]
    df = article_frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    similarity.store_lists(df, str(tmp_path / "x"), lists=6, copies=3)
    stored = spark.read.parquet(str(tmp_path / "x") + "/lists").agg(F.sum(F.octet_length("vectors"))).first()[0]
    assert stored == 200 * 3 * 8 * 4  # before: unit vectors in double
    found = similarity.listed_neighbours(df.where("article_id < 100"), str(tmp_path / "x"), least=-1.0, probes=6)
    got = {(r.a, r.b): r.similarity for r in found.collect()}
    unit = np.array([v for _, _, _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    hours = [r[2] for r in rows]
    assert set(got) == {(i, j) for i in range(100) for j in range(i + 1, 200) if abs(hours[i] - hours[j]) <= 48}
    assert all(abs(unit[i] @ unit[j] - x) < 1e-6 for (i, j), x in got.items())


@pytest.mark.parametrize(("query", "most"), [("edthe", 0.4), ("election", 0.5), ("a", 0.4), ("zzzzzzzzzzzzzzzz", 0.4), ("storm", 0.75)])
def test_search_by_distinct_tokens(spark, query, most):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("adeht") for _ in range(rng.randrange(1, 8))) if rng.random() < 0.7 else rng.choice(["election", "elections", "storm", "Stormy", "a"])
    rows = [(i, f"s{i}", " ".join(word() for _ in range(rng.randrange(0, 4))) or None, rng.choice([None, "", word() + " " + word()])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, slug string, title string, summary string").withColumns({"scope": F.lit("India"), "category": F.lit("tech"), "canonical_story_id": F.lit(None).cast("long")})
    got = [(r.id, r.score) for r in feeds.search(df, query, 15, most=most).collect()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    apart = lambda text: min((distance(t, query) / max(len(t), len(query)) for t in (text or "").lower().split()), default=1.0)
    scored = sorted((round(0.7 * apart(t) + 0.3 * apart(s), 6), i) for i, _, t, s in rows)
    assert got == [(i, x) for x, i in scored if x <= most][:15]


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, pos long, x int").repartition(7)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = {(r.pos, r.s, r.n) for r in df.select("pos", F.sum("x").over(w).alias("s"), F.count("*").over(w).alias("n")).collect()}
    got = {(r.pos, r.s, r.n) for r in ordering.running_sums(df, ["k"], [F.col("pos")], s=F.col("x"), n=F.lit(1)).collect()}
    assert got == expected
    assert ordering.positions(df.where("false"), ["k"], [F.col("pos")]).count() == 0


def test_quota_of_a_stream_equals_the_batch_rule(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, 1000 * i + n, "fresh" if rng.random() < p else rng.choice(["stale", "unknown"])) for n, (s, p) in enumerate([("a", 0.9), ("b", 0.3), ("c", 0.6)]) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "scope string, pos long, class string")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # a scope's rows come in several parts
    try:
        df.repartition(3).write.parquet(str(tmp_path / "in"))
        out = streams.quota_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), max_total=120, min_check=50, max_ratio=0.5)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    kept = quota.quota_cutoff(df, ["scope"], "pos", max_total=120, min_check=50, max_ratio=0.5).where("kept").select("scope", "pos")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, kept.collect()))


def test_waiting_rows_are_held_many_in_a_value():
    class State:
        def __init__(self):
            self.values = None

        def exists(self):
            return self.values is not None

        def get(self):
            return self.values if isinstance(self.values, tuple) else iter(self.values)

        def put(self, values):
            self.values = list(values)

        def appendList(self, values):  # noqa: N802
            self.values = (self.values or []) + list(values)

        def update(self, value):
            self.values = value

        def clear(self):
            self.values = None

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getListState(self, name, schema):  # noqa: N802
            return self.states.setdefault(name, State())

        getValueState = getListState  # noqa: N815

        def listTimers(self):  # noqa: N802
            return self.timers

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    step = lambda memory, row: (((memory or (0,))[0] + 1,), [(row.i, row.name)])
    p = streams._InOrder("ts", ["ts", "i"], step, ["k", "i", "name"], ["ts", "i", "name"], "n long", None)
    handle, n, got = Handle(), 5000, []
    p.init(handle)
    rows = pd.DataFrame({"ts": [i * 7919 % n for i in range(n)], "i": range(n), "name": [None if i % 3 else f"n{i}" for i in range(n)]})
    waiting = handle.states["waiting"]
    for at, frames in ((-1, [rows[:2000], rows[2000:3000]]), (-1, [rows[3000:4000]]), (2499, [rows[4000:]])):
        got += pd.concat(p.handleInputRows(("a",), iter(frames), Now(at))).values.tolist()
        assert len(waiting.values) <= 2  # before: a value for each waiting row
    assert len(got) == 2500 and handle.timers == [2500]
    got += pd.concat(p.handleExpiredTimer(("a",), Now(n), None)).values.tolist()
    assert not waiting.exists() and handle.states["memory"].values == (n,)
    assert got == [["a", i, name] for i, name in rows.sort_values("ts")[["i", "name"]].itertuples(index=False)]


def test_two_stages(spark):
    c = spark.createDataFrame([(1, "India", "ready_for_llm"), (2, "India", "open"), (3, "World", "ready_for_llm"), (4, "World", "ready_for_llm"), (5, None, "ready_for_llm")], "cluster_id long, scope string, status string")
    m = spark.createDataFrame([(k, 10 * k + i, f"t{k}", f"u{k}{i}") for k in (1, 2, 3, 4, 5) for i in (0, 1)], "cluster_id long, article_id long, title string, url string")
    m = m.withColumns({"summary": F.lit(None).cast("string"), "body": F.lit("b"), "published_at": F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))})
    known = spark.createDataFrame([("u40",), ("u41",), ("u10",)], "url string")
    asked = spark.sparkContext.accumulator(0)

    def first(batch):
        return ['{"action": "keep"}' if "t1" in x or "t5" in x else '{"publish": "no", "reason": "dull"}' for x in batch]

    def second(batch):
        asked.add(len(batch))
        return ['{"action": "rewrite", "title": "T", "summary": "S", "body": "B", "scope": "India", "category": "tech", "priority": 3}' if "India" in x else "no json" for x in batch]

    out = {r.cluster_id: (r.outcome, r.drop_reason) for r in handoff.two_stages(c, m, known, first, second).collect()}
    assert out == {1: ("rewritten", None), 2: ("skipped_existing", None), 3: ("dropped", "dull"), 4: ("skipped_existing", None), 5: ("failed", None)}
    assert asked.value == 2  # only what the first stage kept
    done = handoff.settle(c, spark.createDataFrame(list(out.items()), "cluster_id long, o struct<outcome string, r string>").select("cluster_id", "o.outcome"))
    assert {r.cluster_id: r.status for r in done.collect()} == {1: "synthesized", 2: "synthesized", 3: "synthesized", 4: "synthesized", 5: "ready_for_llm"}


def test_collapsed_stories_fold_their_clusters(spark):
    members = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, 30)], "cluster_id long, article_id long").withColumns({"published_at": F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), "created_at": F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), "title": F.lit("t"), "scope": F.lit("India")})
    stories = spark.createDataFrame([(100, 1), (200, 2), (300, 3), (301, 3)], "id long, cluster_id long")
    collapsed = spark.createDataFrame([(100, None), (200, 100), (300, None), (301, 300)], "id long, canonical_story_id long")
    c, m = clusters.fold_for_rewriting(collapsed, stories, members)
    assert {(r.cluster_id, r.article_count, r.status) for r in c.collect()} == {(1, 3, "ready_for_llm"), (3, 1, "open")}
    assert {(r.article_id, r.cluster_id) for r in m.select("article_id", "cluster_id").collect()} == {(10, 1), (20, 1), (21, 1), (30, 3)}


def test_groups_that_share_a_cluster_fold_into_one(spark):
    """Cluster 5 has stories of two groups, cluster 2 is a survivor's that goes on itself."""
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    members = spark.createDataFrame([(k, 10 * k) for k in (1, 2, 3, 5, 7, 8)], "cluster_id long, article_id long").withColumns({"published_at": at, "created_at": at, "title": F.lit("t"), "scope": F.lit("a")})
    stories = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (51, 5), (52, 5), (7, 7), (8, 8), (9, 8)], "id long, cluster_id long")
    collapsed = spark.createDataFrame([(1, None), (51, 1), (3, None), (52, 3), (2, 51), (7, None), (8, None), (9, 8)], "id long, canonical_story_id long")
    c, m = clusters.fold_for_rewriting(collapsed, stories, members)
    assert {(r.cluster_id, r.article_count, r.status) for r in c.collect()} == {(1, 4, "ready_for_llm"), (7, 1, "open"), (8, 1, "open")}
    assert m.count() == 6


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Session())


def _by_force(rows, k, hours, least):
    """article_id, neighbour_id, rank of all pairs, ties to the smaller id."""
    v = np.array([r[3] for r in rows])
    v = v / np.sqrt((v * v).sum(axis=1))[:, None]
    s, out = np.round(v @ v.T, 12), []
    for i, (a, scope, at, _) in enumerate(rows):
        near = sorted((-s[i, j], b) for j, (b, other, time, _) in enumerate(rows) if b != a and other == scope and abs(at - time) <= hours * 3600 and s[i, j] >= least)
        out += [(a, b, r + 1) for r, (_, b) in enumerate(near[:k])]
    return sorted(out)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "article_id long, scope string, at long, embedding array<double>").withColumn("published_at", F.timestamp_seconds("at").cast("timestamp_ntz"))


def test_neighbours_of_many_packs_and_copies(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PACK_ROWS", 16)
    monkeypatch.setattr(similarity._packs, "__defaults__", (16, *similarity._packs.__defaults__[1:]))
    rng = np.random.default_rng(5)
    few = rng.normal(size=(3, 8))
    for vectors in (rng.normal(size=(300, 8)), few[rng.integers(0, 3, 300)]):  # copies: a row's k-th similarity has dozens of ties
        rows = [(i * 7 % 1000, "ab"[i % 2], int(rng.integers(0, 300)) * 3600, v.tolist()) for i, v in enumerate(vectors)]
        for least in (None, 0.3):
            got = similarity.neighbours(_vectors(spark, rows), k=5, least=least)
            assert sorted((r.article_id, r.neighbour_id, r["rank"]) for r in got.collect()) == _by_force(rows, 5, 48, -2 if least is None else least)


def test_a_vector_without_numbers_hides_no_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "a", 0, rng.normal(size=8).tolist()) for i in range(9)]
    got = similarity.neighbours(_vectors(spark, [*rows, (9, "a", 0, [float("nan")] * 8)]), k=5)
    assert sorted((r.article_id, r.neighbour_id, r["rank"]) for r in got.collect()) == _by_force(rows, 5, 48, -2)


def test_rows_before_the_shuffle_follow_packs_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity._packs, "__defaults__", (16, *similarity._packs.__defaults__[1:]))
    rng = np.random.default_rng(7)
    packs = similarity.written(similarity.article_packs(_vectors(spark, [(i, "a", 0, rng.normal(size=8).tolist()) for i in range(400)]))[0], "packs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = similarity.pack_pairs(packs, packs, 1)
        assert pairs.count() == packs.count() ** 2 > 400
        assert similarity.nearest_of_pairs(pairs, 5, 48 * 3600).count() == 400 * 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
