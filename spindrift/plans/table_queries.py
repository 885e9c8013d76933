"""Queries of the keyed table and of streams over several triggers with late rows."""

from __future__ import annotations

import sqlite3
from functools import partial

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import upsert
from ..sources import readers
from ..sources.keyed_table import KeyedTable
from ..sources.tables import new_path, table
from ..streaming import streams
from . import adapters as A
from .queries import INCOMING, _incoming, _stored, query

# ---- the keyed table

STORED_TENTH = """WITH s AS (SELECT 'o' || o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS price, 0 AS seen FROM orders WHERE o_orderkey % 11 <> 0),
i AS (SELECT 'o' || o_orderkey AS k, CAST(o_totalprice AS DOUBLE) * 2 AS price, 1 AS seen FROM orders WHERE o_orderkey % 10 = 0)"""


@query(f"{STORED_TENTH} SELECT k, round(coalesce(i.price, s.price), 2) AS price, coalesce(i.seen, s.seen) AS seen FROM s FULL JOIN i USING (k)")
def bucketed_upsert(spark, d):
    """A tenth of a keyed table's keys written anew, some of them for the first time."""
    i = F.col("o_orderkey")
    key = F.concat(F.lit("o"), i.cast("string")).alias("k")
    orders = table(spark, d, "orders")
    t = KeyedTable(spark, new_path(spark, "keyed"))
    t.create(orders.where(i % 11 != 0).select(key, F.col("o_totalprice").cast("double").alias("price"), F.lit(0).alias("seen")), "k", 16)
    incoming = orders.where(i % 10 == 0).select(key, (F.col("o_totalprice").cast("double") * 2).alias("price"), F.lit(1).alias("seen"))
    t.upsert(incoming, lambda stored, new: upsert.merge_keyed(stored, new, "k"))
    return t.read().select("k", F.round("price", 2).alias("price"), "seen")


@query(f"WITH {INCOMING} SELECT count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged, (SELECT count(*) FROM documents WHERE doc_id % 41 = 0) AS skipped FROM outc")
def upsert_counters(spark, d):
    """Outcomes of an article upsert, counted by the write that does it; records without address among them."""
    stored, incoming = _stored(spark, d), _incoming(spark, d)
    blank = incoming.limit(0).unionByName(A.articles(spark, d).where("article_id % 41 = 0").select((F.col("article_id") + 2_000_000_000).alias("pos"), "article_id", F.lit("").alias("url"), "title", "body", F.lit(None).cast("timestamp_ntz").alias("scraped_at"), F.lit("x").alias("content_hash")))
    t = KeyedTable(spark, new_path(spark, "keyed"))
    t.create(stored, "url", 8)
    seen = Observation("upsert")
    t.upsert(incoming.unionByName(blank), upsert.counted_upsert("pos"), observation=seen, **upsert.outcome_counters())
    return spark.createDataFrame([tuple(int(seen.get[o]) for o in upsert.OUTCOMES)], ", ".join(f"{o} long" for o in upsert.OUTCOMES))


# ---- databases


def database(spark):
    """An empty database of one machine's Spark, in a fresh folder: a stand-in for a server."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", new_path(spark, "derby").removeprefix("file:") + ".log")
    return f"jdbc:derby:{new_path(spark, 'database').removeprefix('file:')};create=true"


def shared_database(spark):
    """Connections to an empty database in the shared folder, from any process of the cluster: a
    stand-in for a server, as only one JVM can open Derby's. Writers wait for each other."""
    return partial(sqlite3.connect, new_path(spark, "database").removeprefix("file:"), timeout=3600)


@query("SELECT CASE WHEN doc_id % 13 <> 0 THEN doc_id END AS doc_key, lang, n_chars FROM documents WHERE n_chars >= 500")
def jdbc_table(spark, d):
    """A table written to a database by several tasks and read in ranges of a key that some rows lack."""
    i, connect = F.col("doc_id"), shared_database(spark)
    rows = table(spark, d, "documents").select(F.when(i % 13 != 0, i).alias("doc_key"), "lang", "n_chars")
    readers.write_database(rows, connect, "documents", parts=2)
    return readers.read_database(spark, connect, "documents", rows.schema, key="doc_key", parts=4, where="n_chars >= 500")


# ---- streams of several triggers

#: Events of a quarter of the time each come in a trigger of their own; every 23rd of the first comes with the last.
QUARTERS = """q AS (SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts, least(3, CAST(floor(4.0 * (epoch(CAST(ts AS TIMESTAMP)) - (SELECT epoch(CAST(min(ts) AS TIMESTAMP)) FROM events)) / (SELECT epoch(CAST(max(ts) AS TIMESTAMP)) - epoch(CAST(min(ts) AS TIMESTAMP)) FROM events)) AS INTEGER)) AS part FROM events),
timely AS (SELECT * FROM q WHERE NOT (part = 0 AND event_id % 23 = 0)), done AS (SELECT * FROM timely WHERE ts <= (SELECT max(ts) FROM timely) - INTERVAL 1 HOUR)"""


def _in_quarters(spark, d, *columns):
    """The events as a stream of four files, one a trigger."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = (F.unix_micros(x) / 1e6 for x in (F.lit(v) for v in e.agg(F.min("ts"), F.max("ts")).first()))
    part = F.least(F.lit(3), F.floor(4.0 * (F.unix_micros("ts") / 1e6 - low) / (high - low)).cast("int"))
    path = new_path(spark, "quarters")
    rows = e.withColumn("part", part)
    rows = rows.withColumn("part", F.when((F.col("part") == 0) & (F.col("event_id") % 23 == 0), 3).otherwise(F.col("part"))).select(*columns, "part")
    for i in range(4):  # one after the other: a stream takes files in the order of their times
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return lambda session: session.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, out):
    """What a stream gives once it has taken all there is."""
    sink = new_path(spark, "stream")
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query("SELECT 'u' || user_id AS k, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def stream_upsert(spark, d):
    """Micro-batches upserted into a keyed table, the first one given a second time."""
    stream = _in_quarters(spark, d, "event_id", "user_id", "ts")(spark)
    t = KeyedTable(spark, new_path(spark, "keyed"))
    t.create(spark.createDataFrame([], "k string, n long, last long"), "k", 8)

    def add(stored, new):
        both = stored.unionByName(new.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("k"), F.lit(1).cast("long").alias("n"), F.col("event_id").cast("long").alias("last")))
        return both.groupBy("k").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    once = streams.upsert_batch(t.root, add, stream="events")

    def twice(batch, number):
        named = batch.withColumn("k", F.concat(F.lit("u"), F.col("user_id").cast("string")))
        once(named, number)
        if number == 0:
            once(named, number)

    streams.ingest_stream(stream, twice, new_path(spark, "state")).awaitTermination()
    return t.read()


@query(
    f"""WITH {QUARTERS}, classed AS (SELECT event_type AS scope, event_id AS pos, ts, event_id % 2 = 0 OR event_type IN ('view', 'purchase') AS fresh FROM done),
run AS (SELECT *, count(*) FILTER (fresh) OVER w AS n, count(*) OVER w AS seen FROM classed WINDOW w AS (PARTITION BY scope ORDER BY ts, pos ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, count(*) FILTER (n >= 150 OR (seen >= 60 AND (seen - n) / seen > 0.45)) OVER (PARTITION BY scope ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM run)
SELECT scope, pos FROM cut WHERE fresh AND stops = 0"""
)
def stream_quota_in_order(spark, d):
    """The quota rule in the order of time over four triggers, late encounters dropped."""
    fresh = (F.col("event_id") % 2 == 0) | F.col("event_type").isin("view", "purchase")
    stream = _in_quarters(spark, d, F.col("event_type").alias("scope"), F.col("event_id").alias("pos"), F.when(fresh, "fresh").otherwise("stale").alias("class"), "ts", "event_id")
    return _run(spark, streams.quota_in_order(stream(streams.ordered_session(spark)), "ts", late="1 hour", max_total=150, min_check=60, max_ratio=0.45))


@query(
    f"""WITH RECURSIVE {QUARTERS}, r AS (SELECT 'https://x.example.com/' || event_id % 40 AS url, event_id, ts, row_number() OVER (PARTITION BY event_id % 40 ORDER BY ts, event_id) AS i FROM done),
walk AS (SELECT url, event_id, ts AS last, i FROM r WHERE i = 1 UNION ALL SELECT w.url, x.event_id, x.ts, x.i FROM walk w JOIN LATERAL (SELECT * FROM r WHERE r.url = w.url AND r.i > w.i AND r.ts >= w.last + INTERVAL 48 HOUR ORDER BY r.i LIMIT 1) x ON true)
SELECT url, event_id FROM walk"""
)
def stream_first_in_horizon(spark, d):
    """The first of each address in every 48 hours, over four triggers, late rows dropped."""
    i = F.col("event_id")
    url = F.concat(F.lit("https://X.example.com/"), (i % 40).cast("string"), F.when(i % 2 == 0, "/?utm_source=a").otherwise("")).alias("url")
    stream = _in_quarters(spark, d, url, "ts", "event_id")
    return _run(spark, streams.first_in_horizon(stream(streams.ordered_session(spark)), "url", "ts", "event_id", late="1 hour", horizon_ms=48 * 3600 * 1000))


@query(
    f"""WITH {QUARTERS}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 HOUR THEN 0 ELSE 1 END AS n FROM timely), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 10 HOUR AS ready_at, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 10 HOUR <= (SELECT max(ts) FROM timely) - INTERVAL 1 HOUR"""
)
def stream_sessions(spark, d):
    """Quiet-time sessions of a stream in append mode: those that the watermark has passed."""
    out = streams.ready_sessions(_in_quarters(spark, d, "user_id", "ts", "event_id")(spark), "user_id", "ts", quiet="10 hours", late="1 hour")
    return _run(spark, out)


@query(f"WITH {QUARTERS} SELECT DISTINCT 'https://x.example.com/' || event_id % 300 AS url FROM timely")
def stream_dedup(spark, d):
    """The first arrival of each address over four triggers. Rows of the first eighth that come
    with the last quarter, later than the horizon, are dropped."""
    i = F.col("event_id")
    e = table(spark, d, "events")
    low, high = e.agg(F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp"))).first()
    span = (high - low).total_seconds()
    stream = _in_quarters(spark, d, "event_id", "ts")(spark)
    timely = F.unix_micros("ts") / 1e6 - F.unix_micros(F.lit(low)) / 1e6
    late = (timely < span / 4) & (i % 23 == 0)
    name = F.when(late, F.concat(F.lit("late-"), i.cast("string"))).otherwise((i % 300).cast("string"))
    rows = stream.where(~late | (timely < span / 8)).select(F.concat(F.lit("https://X.example.com/"), name, F.when(i % 2 == 0, "/?utm_source=a").otherwise("")).alias("url"), "ts")
    return _run(spark, streams.dedup_stream(rows, "url", "ts", f"{int(span / 3)} seconds")).select("url")
