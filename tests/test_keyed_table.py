"""The keyed table: what an upsert leaves alone, versions, replayed batches, conflicts; streams in order; databases."""

import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spindrift.operators import upsert
from spindrift.plans.table_queries import database
from spindrift.sources import readers
from spindrift.sources.keyed_table import Conflict, KeyedTable, bucket_of
from spindrift.sources.tables import new_path
from spindrift.streaming import streams


def files(root):
    return {os.path.join(f, n): os.stat(os.path.join(f, n)).st_mtime_ns for f, _, names in os.walk(f"{root}/data") for n in names if n.startswith("part-")}


@pytest.fixture
def stored(spark):
    t = KeyedTable(spark, new_path(spark, "keyed"))
    t.create(spark.range(400).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")), "k", 16)
    return t


def put(stored, new):
    return upsert.merge_keyed(stored, new, "k")


def test_untouched_buckets_stay(spark, stored):
    new = spark.createDataFrame([("k3", -3), ("k7", -7), ("n1", 1)], "k string, v long")
    touched = {r[0] for r in new.select(bucket_of("k", 16)).collect()}
    before, old = files(stored.root), stored.version()
    v = stored.upsert(new, put)
    assert {b for b in v.writes if v.writes[b] != old.writes.get(b)} == touched and len(touched) < 16
    after = files(stored.root)
    assert before.items() <= after.items() and {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == set(map(str, touched))
    want = {f"k{i}": i for i in range(400)} | {"k3": -3, "k7": -7, "n1": 1}
    assert dict(map(tuple, stored.read().collect())) == want
    assert dict(map(tuple, stored.read(0).collect())) == {f"k{i}": i for i in range(400)}  # a reader of the version before
    assert stored.read().where("k = 'k3'").count() == 1


def test_rows_may_go_and_nothing_may_come(spark, stored):
    none = spark.createDataFrame([], "k string, v long")
    assert stored.upsert(none, put).writes == stored.version(0).writes
    gone = stored.upsert(spark.createDataFrame([("k3", 0), (None, 5)], "k string, v long"), lambda s, n: s.join(n.select("k"), "k", "left_anti").unionByName(n.where("k IS NULL")))
    assert stored.read().count() == 400 and stored.read().where("k IS NULL").first().v == 5 and gone.number == 2
    with pytest.raises(ValueError, match="buckets"):
        stored.upsert(spark.createDataFrame([("k3", 0)], "k string, v long"), lambda s, n: spark.range(50).select(F.concat(F.lit("z"), "id").alias("k"), F.col("id").alias("v")))
    assert stored.version().number == 2


def test_a_repeated_batch_changes_nothing(spark, stored):
    add = lambda s, n: s.unionByName(n).groupBy("k").agg(F.sum("v").alias("v"))
    batch = spark.createDataFrame([("k1", 100)], "k string, v long")
    once = streams.upsert_batch(stored.root, add, stream="a")
    for number in (0, 0, 1, 0, 1):
        once(batch, number)
    assert stored.read().where("k = 'k1'").first().v == 201
    streams.upsert_batch(stored.root, add, stream="b")(batch, 0)
    assert stored.read().where("k = 'k1'").first().v == 301 and stored.version().batches == {"a": 1, "b": 0}


def test_a_failed_batch_leaves_no_trace(spark, stored):
    def breaks(s, n):
        return s.unionByName(n.withColumn("v", F.raise_error(F.lit("no")).cast("long")))

    with pytest.raises(Exception, match="no"):
        streams.upsert_batch(stored.root, breaks, stream="a")(spark.createDataFrame([("k1", 1)], "k string, v long"), 0)
    assert stored.version().number == 0 and stored.version().batches == {} and stored.read().count() == 400


def test_two_writers(spark, stored):
    new = spark.createDataFrame([("k3", 1)], "k string, v long")

    def slow(s, n):
        KeyedTable(spark, stored.root).upsert(new, put)
        return put(s, n)

    with pytest.raises(Conflict):
        stored.upsert(new, slow)
    assert stored.versions() == [0, 1]


def test_vacuum(spark, stored):
    for i in range(3):
        stored.upsert(spark.createDataFrame([(f"k{i}", -1)], "k string, v long"), put)
    whole = sorted(map(tuple, stored.read().collect()))
    stored.vacuum(1)
    assert stored.versions() == [3] and sorted(map(tuple, stored.read().collect())) == whole
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, new_path(spark, "none")).version()


def test_counters_of_one_pass(spark):
    t = KeyedTable(spark, new_path(spark, "keyed"))
    t.create(spark.createDataFrame([(1, "a", "h1", None, 7), (2, "b", "h2", None, 8)], "article_id long, url string, content_hash string, scraped_at timestamp_ntz, cluster_id long"), "url", 4)
    rows = [(1, 11, "a", "h1", None), (2, 12, "a", "x", None), (3, 13, "c", "y", None), (4, 14, None, "z", None), (5, 15, "", "z", None), (6, 16, "c", "y", None)]
    seen = Observation("run")
    t.upsert(spark.createDataFrame(rows, "pos long, article_id long, url string, content_hash string, scraped_at timestamp_ntz"), upsert.counted_upsert("pos"), observation=seen, **upsert.outcome_counters())
    assert seen.get == {"created": 1, "updated": 1, "unchanged": 2, "skipped": 2}
    assert sorted((r.url, r.article_id, r.content_hash, r.cluster_id) for r in t.read().collect()) == [("a", 1, "x", 7), ("b", 2, "h2", 8), ("c", 13, "y", None)]


def test_order_across_triggers(spark):
    """The same rows in any number of triggers give the same result; late rows are dropped."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, t, rng.random() < 0.6) for i, t in enumerate(sorted(rng.randrange(10_000) for _ in range(120)))]
    want = []
    for scope in "ab":
        fresh = seen = 0
        for _, i, _, is_fresh in [r for r in rows if r[0] == scope]:
            seen, fresh = seen + 1, fresh + is_fresh
            want += [(scope, i)] if is_fresh else []
            if fresh >= 30 or (seen >= 10 and (seen - fresh) / seen > 0.6):
                break
    for parts in (1, 3):
        path, session = new_path(spark, "rows"), streams.ordered_session(spark)
        for p in range(parts):
            part = [r for r in rows if r[2] * parts // 10_000 == p]
            rng.shuffle(part)
            part += [("a", 900 + p, 0, True)] if p == 2 else []  # late by far
            part += [("z", 999, 10_000_000, False)] if p == parts - 1 else []  # moves the watermark beyond all
            spark.createDataFrame([(s, i, t * 1000, "fresh" if f else "stale") for s, i, t, f in part], "scope string, pos long, ms long, class string").select("scope", "pos", F.timestamp_millis("ms").alias("at"), "class").coalesce(1).write.mode("append").parquet(path)
        out = streams.quota_in_order(session.readStream.schema("scope string, pos long, at timestamp, class string").option("maxFilesPerTrigger", 1).parquet(path), "at", late="100 seconds", max_total=30, min_check=10, max_ratio=0.6)
        sink = new_path(spark, "out")
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(sink).collect()) == sorted(want)


def test_database_ranges(spark):
    url = database(spark)
    rows = spark.range(50).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    readers.write_jdbc(rows, url, "t", parts=2)
    for bounds in ({}, {"low": 10, "high": 20}, {"low": 5, "high": 5}):
        got = readers.read_jdbc(spark, url, "t", key="k", parts=4, **bounds)
        assert sorted(r.v for r in got.collect()) == [2 * i for i in range(50)]
        assert got.rdd.getNumPartitions() == (1 if bounds.get("low") == 5 else 4)
    plan = got.where("v > 40").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(V,40)" in plan.replace("v,", "V,") and "Filter" not in plan.split("Scan")[0]
    readers.write_jdbc(rows.where("false"), url, "vacant")
    assert readers.read_jdbc(spark, url, "vacant", key="k", parts=4).count() == 0
