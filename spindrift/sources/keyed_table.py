"""A table laid out by the hash of its key, where an upsert rewrites only the buckets it touches.

    root/data/<write>/bucket=<b>/part-...     rows of one bucket, as one write left them
    root/versions/<n>.json                    for each bucket the write that holds it now

A version is one small file that names, for each bucket, the write that holds its rows.  An
upsert reads the buckets that the incoming keys fall into, writes their merged rows under a
fresh name, and commits by renaming a finished version file into place; readers open the
newest version and never see half a write.  Of two writers that start from one version the
second finds its number taken and fails, so nothing is lost.  A version also keeps the last
batch of each stream that it holds, which makes a repeated batch a no-op.

Everything goes through Spark and the file system that Spark knows, so any shared store with
an atomic rename will do.  The driver holds one number for each bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import written


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    """One state of a table: the key, the schema, the write of each bucket that has rows, and
    the last batch taken from each stream."""

    number: int
    key: str
    buckets: int
    schema: str
    writes: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class KeyedTable:
    """Rows with a unique key under ``root``. Rows with a null key are a bucket's as any other."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one of that number."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table under {self.root}")
        number = found[-1] if number is None else number
        raw = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/versions/{number}.json", wholetext=True).collect()))
        return Version(number, raw["key"], raw["buckets"], raw["schema"], {int(b): w for b, w in raw["writes"].items()}, raw["batches"])

    def _commit(self, v: Version) -> None:
        target = self._path(f"{self.root}/versions/{v.number}.json")
        draft = self._path(f"{self.root}/versions/.{v.number}-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"key": v.key, "buckets": v.buckets, "schema": v.schema, "writes": v.writes, "batches": v.batches}).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {v.number} of {self.root} was written by another job")

    # ---- reading and writing

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        return self._rows(v, list(v.writes))

    def _rows(self, v: Version, buckets: list[int]) -> DataFrame:
        schema = StructType.fromJson(json.loads(v.schema))
        paths = [f"{self.root}/data/{v.writes[b]}/bucket={b}" for b in buckets if b in v.writes]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, v: Version, observation: Observation | None = None, **counters: Column) -> tuple[str, list[int]]:
        """Rows under a fresh name, a file or a few for each bucket; the buckets that got some."""
        name = uuid.uuid4().hex
        placed = rows.withColumn("bucket", bucket_of(v.key, v.buckets)).repartition("bucket")
        if observation is not None:
            # beside the write itself, in the stage whose tasks count once each
            placed = placed.observe(observation, *[c.alias(n) for n, c in counters.items()])
        columns = [f.name for f in StructType.fromJson(json.loads(v.schema)).fields]
        placed.where("__keep" if "__keep" in rows.columns else "true").select(*[F.col(f"`{c}`") for c in columns], "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
        folder = self._path(f"{self.root}/data/{name}")
        return name, [int(s.getPath().getName().removeprefix("bucket=")) for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("bucket=")]

    def create(self, rows: DataFrame, key: str, buckets: int) -> Version:
        """The table's first version. ``key`` must be unique in ``rows``, and no column be named bucket."""
        v = Version(0, key, buckets, rows.schema.json())
        name, got = self._write(rows, v)
        v = Version(0, key, buckets, v.schema, dict.fromkeys(got, name))
        self._commit(v)
        return v

    def upsert(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], *, stream: str | None = None, batch: int | None = None, observation: Observation | None = None, **counters: Column) -> Version:
        """A new version after ``merge(stored, incoming)``, which sees the stored rows of the touched
        buckets only and returns all rows that are to be in them.

        With ``stream`` and ``batch``, a batch that the table holds already changes nothing.
        ``merge`` may add columns for ``counters``, which ``observation`` takes while the rows are
        written, and a boolean ``__keep`` for rows that are there to be counted only.
        """
        v = self.version()
        if stream is not None and batch is not None and v.batches.get(stream, -1) >= batch:
            return v
        incoming = written(incoming, "incoming")  # read twice, and a source may not say the same twice
        touched = [r.b for r in incoming.select(bucket_of(v.key, v.buckets).alias("b")).distinct().collect()]
        writes = dict(v.writes)
        if touched:
            name, got = self._write(merge(self._rows(v, touched), incoming), v, observation, **counters)
            stray = set(got) - set(touched)
            if stray:
                raise ValueError("merge returned keys of buckets that the incoming rows don't touch")
            for b in touched:
                writes.pop(b, None)
            writes |= dict.fromkeys(got, name)
        batches = v.batches | ({stream: batch} if stream is not None else {})
        new = Version(v.number + 1, v.key, v.buckets, v.schema, writes, batches)
        self._commit(new)
        return new

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove versions but the last ``keep`` and writes that none of those names; the writes removed.

        Not while a writer is at work: what it has written is in no version yet.
        """
        found = self.versions()
        kept = {w for n in found[-keep:] for w in self.version(n).writes.values()}
        for n in found[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{n}.json"), False)
        folder = self._path(f"{self.root}/data")
        gone = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName() not in kept)
        for name in gone:
            self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
        return gone
