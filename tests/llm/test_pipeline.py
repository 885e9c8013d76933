"""The pipeline's stages on a small folder of tables, each one's decisions checked on its own input."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import decontamination, near_dedup


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage, item = text(40), text(20)
    good = [text(60) for _ in range(160)]
    rows = good + [good[0], good[1] + " extra"] + [f"{text(40)} {passage} {text(30)}" for _ in range(10)] + [f"{text(10)} {item}" for _ in range(4)]
    junk = [" ".join(w.upper() + "!!" for w in text(60).split()) for _ in range(80)]
    out = tmp_path_factory.mktemp("tables")
    n = len(rows)
    docs = rows + junk + [None, ""]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(docs)), pa.int64()), "text": pa.array(docs, pa.string()), "lang": ["en"] * len(docs), "source": ["s"] * len(docs), "n_chars": pa.array([len(x or "") for x in docs], pa.int64())}), out / "documents.parquet")
    ids = [i for i in range(len(docs) - 2) if i % 2]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([int(i < n) for i in ids], pa.int32()), "toxic": pa.array([0] * len(ids), pa.int32())}), out / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), out / "benchmark.parquet")
    return str(out), n


def test_stages(spark, folder):
    d, n = folder
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_filter"](spark, docs, d)
    assert good.columns == columns
    ids = {r.doc_id for r in good.collect()}
    assert set(range(n)) <= ids and not ids & set(range(n, n + 80))
    once = stage["near_duplicate_filter"](spark, good, d)
    left = {r.doc_id for r in once.collect()}
    assert once.columns == columns and left == {r.doc_id for r in near_dedup.near_duplicates(good).where("kept").collect()} and not left & {160, 161}
    cut = stage["passage_removal"](spark, once, d)
    rows = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and set(rows) == left and all(r.n_chars == len(r.text) for r in rows.values())
    assert sum(len(rows[i].text) < len(r.text or "") for i, r in ((r.doc_id, r) for r in once.collect())) >= 9
    clean = stage["benchmark_filter"](spark, cut, d)
    bad = {r.doc_id for r in decontamination.decontaminate(cut, spark.read.parquet(f"{d}/benchmark.parquet")).where("contaminated").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and bad and kept == left - bad
    packed = stage["pack_sequences"](spark, clean, d).collect()
    assert {r.doc_id for r in packed} == kept


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).where("piece = 0").count() > 100


def test_stages_without_rows(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("false")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, folder[0]).count() == 0


def test_repeated_rows_stay_once(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 3")
    assert corpus_pipeline.near_duplicate_filter(spark, docs.unionByName(docs), folder[0]).count() == 3


def test_rows_with_one_id_and_different_texts(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    item = spark.read.parquet(f"{folder[0]}/benchmark.parquet").first().text
    text = {r.doc_id: r.text for r in docs.where("doc_id < 4").collect()}
    rows = [(5, text[0]), (5, text[1]), (5, text[1]), (7, text[0] + " end"), (None, item), (None, text[2]), (None, text[3])]
    some = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    once = corpus_pipeline.near_duplicate_filter(spark, some, folder[0])
    assert sorted((r.doc_id or 0, r.text) for r in once.collect()) == sorted([(5, text[0]), (5, text[1]), (0, item), (0, text[2]), (0, text[3])])
    clean = corpus_pipeline.benchmark_filter(spark, once, folder[0])
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in clean.collect()) == sorted([(5, text[0]), (5, text[1]), (0, text[2]), (0, text[3])])


def test_columns_with_clashing_names_stay(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id BETWEEN 155 AND 180")
    names = ("rep", "key", "value", "n_bytes", "n_removed", "kept_sha256", "component_id", "score", "sub", "bucket", "w", "a.b")
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, wide, folder[0])
        assert out.columns == wide.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}:{r.doc_id}" for c in names), name
    assert corpus_pipeline.pack_sequences(spark, wide, folder[0]).count() >= 20
