"""Readers for article dumps, publisher payloads and tables of other databases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import closing
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: An article record as it is exchanged; time stamps are ISO strings.
ARTICLE_DDL = (
    "url string, title string, summary string, body string, source string, scope string, language string, "
    "author string, image string, tags array<string>, published_at string, scraped_at string"
)
STORY_DDL = (
    "items array<struct<story:struct<headline:string,url:string,`author-name`:string,subheadline:string,`published-at`:bigint,"
    "`hero-image-metadata`:struct<`original-url`:string>,`hero-image-s3-key`:string,sections:array<struct<`display-name`:string>>,"
    "tags:array<struct<name:string>>,cards:array<struct<`story-elements`:array<struct<type:string,subtype:string,text:string,"
    "metadata:struct<`promotional-message`:boolean,`linked-story-id`:string,`linked-story`:struct<id:string>>>>>>>>>"
)


def read_articles(spark: SparkSession, path: str, *, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) records of a dump: one JSON array, or JSON Lines with ``multiline=False``.

    Rejected are elements that are no object of the expected form and records without url.
    ``tags`` may be one string instead of a list. Any file system that Spark knows will do.
    """
    raw = spark.read.schema(ARTICLE_DDL.replace("tags array<string>", "tags string") + ", _corrupt_record string").option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)
    as_list = F.from_json(F.col("tags"), "array<string>")
    tags = F.when(F.col("tags").startswith("["), as_list).when(F.col("tags").isNotNull() & (F.col("tags") != ""), F.array("tags"))
    good = F.col("_corrupt_record").isNull() & F.coalesce(F.trim("url") != "", F.lit(False))
    # with multiLine, an array element that is no object gives a row of nulls
    return raw.where(good).withColumn("tags", tags).drop("_corrupt_record"), raw.where(~good)


def read_feed(spark: SparkSession, path: str, scope: str, *, link_part: str = "/articleshow/") -> DataFrame:
    """Flat feed payloads (hl, des, wu): rows whose link has ``link_part``, once per link."""
    feed = spark.read.schema("hl string, des string, wu string").option("multiLine", True).json(path)
    return feed.where(F.contains("wu", F.lit(link_part))).dropDuplicates(["wu"]).select(F.trim("hl").alias("title"), F.trim("des").alias("summary"), F.col("wu").alias("url"), F.lit(scope).alias("scope"))


def read_story_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per story of paged collection payloads, with the payload's file as ``page``."""
    pages = spark.read.schema(STORY_DDL).option("multiLine", True).json(path).withColumn("page", F.input_file_name())
    return pages.select("page", F.explode("items").alias("item")).select("page", "item.story.*")


def union_sources(*frames: DataFrame) -> DataFrame:
    """All publishers' records in one table; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_jdbc(spark: SparkSession, url: str, name: str, *, key: str, parts: int, low: int | None = None, high: int | None = None, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric key, by as many connections.

    Bounds that aren't given are asked of the database; they only place the cuts: rows beyond
    them are in the first and last range, rows without a key in the first. Filters and columns
    that are used later are the database's work.
    """
    if low is None or high is None:
        quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
        asked = spark.read.jdbc(url, f"(SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM {name}) bounds", properties=dict(options)).first()
        low, high = (g if g is not None else int(x or 0) for g, x in ((low, asked[0]), (high, asked[1])))
    if high <= low or parts <= 1:
        return spark.read.jdbc(url, name, properties=dict(options))
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=dict(options))


def write_jdbc(df: DataFrame, url: str, name: str, *, parts: int = 8, mode: str = "append", **options: str) -> None:
    """Rows into a database table by at most ``parts`` connections at once."""
    df.coalesce(parts).write.jdbc(url, name, mode=mode, properties=dict(options))


#: Spark's types, Arrow's, and the database's for a new table.
DATABASE_TYPES = {"bigint": (pa.int64(), "BIGINT"), "int": (pa.int32(), "INTEGER"), "double": (pa.float64(), "DOUBLE PRECISION"), "string": (pa.string(), "TEXT")}
#: Rows that a task holds of a database's at once.
DATABASE_ROWS = 10_000


def read_database(spark: SparkSession, connect: Callable, name: str, schema: StructType, *, key: str, parts: int, where: str = "1 = 1") -> DataFrame:
    """A database table's columns of ``schema`` read in ``parts`` ranges of an integer key, by as many
    connections, for databases with a Python driver: ``connect`` gives a connection (DB-API 2)
    on the driver and in every task.

    The smallest and the largest key are asked of the database and place the cuts; rows without
    a key are in the first range. ``where`` is a condition in the database's SQL.
    """
    types = [(f.name, DATABASE_TYPES[f.dataType.simpleString()][0]) for f in schema.fields]
    with closing(connect()) as c:
        cursor = c.cursor()
        cursor.execute(f"SELECT MIN({key}), MAX({key}) FROM {name} WHERE {where}")
        low, high = (int(x or 0) for x in cursor.fetchone())
    parts = max(1, min(parts, high - low + 1))
    cuts = [low + (high - low + 1) * i // parts for i in range(1, parts)]
    first = [f"({key} < {cuts[0]} OR {key} IS NULL)" if cuts else "1 = 1"]
    ranges = [*first, *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])], *[f"{key} >= {c}" for c in cuts[-1:]]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column(0).to_pylist()):
            with closing(connect()) as c:
                cursor = c.cursor()
                cursor.execute(f"SELECT {', '.join(n for n, _ in types)} FROM {name} WHERE ({where}) AND {ranges[i]}")
                while rows := cursor.fetchmany(DATABASE_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows), types)], [n for n, _ in types])

    return spark.range(0, parts, 1, parts).mapInArrow(read, schema)


def write_database(df: DataFrame, connect: Callable, name: str, *, parts: int = 8, mark: str = "?") -> None:
    """Rows added to a database table, which is made if it isn't there, by at most ``parts`` connections
    at once, for databases with a Python driver (``connect`` as in ``read_database``; ``mark``
    stands for a value in its SQL). The rows of a task are one transaction, so a task that
    failed leaves none; the driver only makes the table."""
    columns = ", ".join(f"{f.name} {DATABASE_TYPES[f.dataType.simpleString()][1]}" for f in df.schema.fields)
    with closing(connect()) as c:
        c.cursor().execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")
        c.commit()
    put = f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ({', '.join([mark] * len(df.columns))})"

    def write(rows: Iterator[Row]) -> None:
        with closing(connect()) as c:
            cursor = c.cursor()
            for some in batched(rows, DATABASE_ROWS):
                cursor.executemany(put, [tuple(r) for r in some])
            c.commit()

    df.coalesce(parts).foreachPartition(write)


def write_articles(df: DataFrame, path: str) -> None:
    """JSON Lines export."""
    df.write.mode("errorifexists").json(path)


def replace_versioned(df: DataFrame, root: str, version: str) -> str:
    """Write a new version of a table beside the old ones and return its path; readers switch
    to it when it is complete, and nothing that is being read is overwritten."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
