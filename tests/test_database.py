import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from spindrift.plans.table_queries import shared_database
from spindrift.sources import readers

REPO = Path(__file__).resolve().parent.parent
ON_CLUSTER = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
import __spark_entry__
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
print("ROWS", __spark_entry__.queries()["jdbc_table"](spark, "/root/testdata/sf0.001").count(), docs.where("n_chars >= 500").count())
spark.stop()
"""


def test_jdbc_table_on_several_executors(tmp_path):
    """Driver and executors are JVMs of their own; an embedded database can't be opened by more than one."""
    home = tmp_path / "home"
    for folder in (home / "work", tmp_path / "shared", tmp_path / "local"):
        folder.mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    ran = subprocess.run([sys.executable, "-c", ON_CLUSTER, str(tmp_path / "shared")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    rows = [line.split()[1:] for line in ran.stdout.splitlines() if line.startswith("ROWS")]
    assert rows and rows[0][0] == rows[0][1] != "0", ran.stderr[-3000:]


def test_database_by_python_driver(spark):
    connect = shared_database(spark)
    rows = spark.range(50).select(F.when(F.col("id") % 7 != 0, F.col("id") * 1000 - 9000).alias("k"), (F.col("id") * 2).cast("int").alias("v"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("'é"), "id")).alias("t"), (F.col("id") / 3).alias("x"))
    readers.write_database(rows, connect, "t", parts=3)
    want = sorted(map(repr, rows.collect()))
    for parts in (1, 2, 4, 9):
        got = readers.read_database(spark, connect, "t", rows.schema, key="k", parts=parts)
        assert got.rdd.getNumPartitions() == parts and got.schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(repr, got.collect())) == want
    spread = [n for n in readers.read_database(spark, connect, "t", rows.schema, key="k", parts=4).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]
    assert max(spread) < 25  # the cuts are placed by the keys that are there
    assert readers.read_database(spark, connect, "t", rows.schema, key="k", parts=4, where="v >= 40 OR v < 2").count() == 31
    readers.write_database(rows.limit(5), connect, "t")
    assert readers.read_database(spark, connect, "t", rows.schema, key="k", parts=4).count() == 55
    readers.write_database(rows.where("false"), connect, "vacant")
    assert readers.read_database(spark, connect, "vacant", rows.schema, key="k", parts=4).count() == 0


def test_failed_task_leaves_no_rows(spark, monkeypatch):
    monkeypatch.setattr(readers, "DATABASE_ROWS", 10)
    connect = shared_database(spark)
    bad = spark.range(0, 100, 1, 1).select(F.col("id").alias("k"), F.when(F.col("id") == 70, F.raise_error(F.lit("x"))).otherwise(F.lit("a")).alias("t"))
    with pytest.raises(Exception):
        readers.write_database(bad, connect, "t")
    assert readers.read_database(spark, connect, "t", bad.select("k", F.col("t").cast("string")).schema, key="k", parts=2).count() == 0
