"""Operators against plain sequential versions and golden facts."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import clusters, components, embedding, extract, quota, upsert
from spindrift.operators.text_join import similar_token_sets
from spindrift.sources import readers
from spindrift.streaming import streams

T0 = datetime(2024, 1, 1)


def test_components_and_roots(spark):
    rng = random.Random(1)
    n = 60
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)]
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.range(n), spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == dict(enumerate(label))
    parent = [rng.randrange(i + 1) for i in range(n)]
    root = lambda i: i if parent[i] == i else root(parent[i])
    got = components.roots(spark.createDataFrame(list(enumerate(parent)), "id long, parent long"))
    assert {r.id: r.root for r in got.collect()} == {i: root(i) for i in range(n)}


def test_assign_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    n = 60
    base = rng.standard_normal((6, 8))
    rows = []
    for i in range(n):
        v = base[i % 6] + 0.6 * rng.standard_normal(8)
        rows.append((i, ["A", "B", None][i % 3], f"s{i % 4}", f"t{i}", None if i % 17 == 0 else T0 + timedelta(hours=int(rng.integers(0, 120))), T0 + timedelta(minutes=i), [float(x) for x in v] if i % 13 else None))
    df = spark.createDataFrame(rows, "article_id long, scope string, source string, title string, published_at timestamp_ntz, created_at timestamp_ntz, embedding array<float>")
    unit = {r[0]: np.array(np.float32(r[6]), float) / np.linalg.norm(np.array(np.float32(r[6]), float)) for r in rows if r[6]}
    cluster = {}
    for r in sorted((x for x in rows if x[6]), key=lambda x: (x[4] is None, x[4] or T0, x[5], x[0])):
        near = sorted(((-float(unit[r[0]] @ unit[o[0]]), o[0]) for o in rows if o[6] and o[0] != r[0] and o[1] == r[1] and r[4] and o[4] and abs(o[4] - r[4]) <= timedelta(hours=48)))[:5]
        best = next(((o, -s) for s, o in near if o in cluster and -s >= (0.9 if rows[o][2] == r[2] else 0.8)), None)
        cluster[r[0]] = cluster[best[0]] if best else r[0]
    got = {r.article_id: r.cluster_id for r in clusters.assign(df, cross=0.8, same=0.9).collect()}
    assert got == cluster


def test_quota_golden(spark):
    rows = [(i, "s", "fresh" if i % 4 == 0 else "stale") for i in range(20)]
    df = spark.createDataFrame(rows, "pos long, scope string, class string")
    out = quota.quota_cutoff(df, ["scope"], "pos", max_total=100, min_check=6, max_ratio=0.5).collect()
    assert [r.pos for r in out] == list(range(6)) and {r.stop_reason for r in out} == {"ratio"}
    out = quota.quota_cutoff(df, ["scope"], "pos", max_total=2, min_check=100).collect()
    assert [r.pos for r in out if r.kept] == [0, 4] and max(r.pos for r in out) == 4


def test_upsert_of_two_versions(spark):
    schema = "pos long, article_id long, url string, title string, content_hash string, scraped_at timestamp_ntz"
    inc = spark.createDataFrame([(1, 7, "u", "a", "h1", T0), (2, 8, "u", "b", "h2", None)], schema)
    empty = spark.createDataFrame([], "article_id long, url string, title string, content_hash string, scraped_at timestamp_ntz, cluster_id long")
    first, marks, _ = upsert.upsert_articles(empty, inc, "pos")
    assert sorted(r.outcome for r in marks.collect()) == ["created", "updated"]
    row = first.first()
    assert (row.title, row.scraped_at, row.cluster_id) == ("b", None, None)
    stored = first.withColumn("cluster_id", F.lit(5).cast("long"))
    again, marks, stale = upsert.upsert_articles(stored, spark.createDataFrame([(1, 9, "u", "b", "h2", T0)], schema), "pos")
    row = again.first()
    assert [r.outcome for r in marks.collect()] == ["unchanged"] and row.scraped_at == T0 and row.cluster_id == 5 and stale.count() == 0


def test_read_articles(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"url": "u1", "title": "t", "tags": ["x", "y"]}, {"title": "no url"}, {"url": "u2", "tags": "one"}]))
    good, bad = readers.read_articles(spark, str(path))
    assert {r.url: r.tags for r in good.collect()} == {"u1": ["x", "y"], "u2": ["one"]} and bad.count() == 1


def test_json_ld(spark):
    ld = {"@type": ["Thing", "NewsArticle"], "headline": "H", "articleBody": "B", "keywords": "a, b,", "author": [{"name": "X"}, {"name": "Y"}], "image": {"url": "i"}, "datePublished": "2024-01-01T00:00:00Z"}
    html = f'<script type="application/ld+json">{{bad</script><script type="application/ld+json">[{{"@type": "Thing"}}, {json.dumps(ld)}]</script>'
    r = extract.articles_of_json_ld(extract.json_ld(spark.createDataFrame([(1, html), (2, "none")], "page_id long, html string")), "S", "India").collect()
    assert len(r) == 1 and (r[0].title, r[0].tags, r[0].author, r[0].image, r[0].published_at) == ("H", ["a", "b"], "X, Y", "i", "2024-01-01T05:30:00+05:30")


def test_story_payload(spark, tmp_path):
    meta = {"promotional-message": True}
    cards = [{"story-elements": [{"type": "text", "text": "<p>A  b</p><p></p>"}, {"type": "text", "text": "<p>ad</p>", "metadata": meta}, {"type": "text", "subtype": "also-read", "text": "<p>x</p>"}, {"type": "image"}]}]
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"story": {"headline": " H ", "url": "u", "published-at": 1704067200000, "sections": [{"display-name": "World"}], "tags": [{"name": "t"}], "cards": cards}}]}))
    r = extract.flatten_stories(readers.read_story_pages(spark, str(tmp_path / "p.json")), "S", "India").first()
    assert (r.title, r.body, r.scope, r.tags, r.published_at) == ("H", "A b", "World", ["t"], "2024-01-01T05:30:00+05:30")


def test_embed(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "article_id long, text string")
    rows = {r.article_id: r.embedding for r in embedding.embed(df, embedding.hashed_encoder(16), model="m", dim=16).collect()}
    assert rows[1] == rows[2] != rows[3] and abs(sum(x * x for x in rows[1]) - 1) < 1e-5


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"url": u, "published_at": "2024-01-01T00:00:00"}) for u in ("http://A/x/", "http://a/x#f", "http://a/y")))
    seen = []
    q = streams.ingest_stream(streams.article_stream(spark, str(src)), lambda df, i: seen.append(df.count()), str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert seen == [3]
    stream = streams.article_stream(spark, str(src)).withColumn("ts", F.to_timestamp("published_at"))
    q = streams.dedup_stream(stream, "url", "ts").writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dedup").count() == 2


def test_copies_of_token_sets_meet_once(spark):
    rows = [(i, "g", ["a", "b", "c"] if i % 2 else ["c", "b", "a"]) for i in range(60)] + [(60 + i, "g", ["a", "b", "d"]) for i in range(50)] + [(200, "h", ["a", "b", "c"])]
    out = similar_token_sets(spark.createDataFrame(rows, "id long, g string, t array<string>"), "id", "g", "t", least=0.5, shared=2)
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in out.collect()}
    assert got == {(a, b): (3, 1.0) if (a < 60) == (b < 60) else (2, 0.5) for a in range(110) for b in range(a + 1, 110)}
    sizes = []
    for path in {f.rpartition("/")[0] for f in out.inputFiles()}:
        if "/linked-" in path:
            sizes.append(spark.read.parquet(path.removeprefix("file://")).count())
    assert sizes == [4]  # three classes and the one pair of them, whatever the copies
