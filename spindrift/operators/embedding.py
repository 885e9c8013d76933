"""Vectors for articles: what is pending, running an encoder over it, dropping stale ones."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embedding_text


def pending(articles: DataFrame, vectors: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles without a vector and with some text, in work order (no date last)."""
    text = embedding_text(F.col("title"), F.col("summary"), F.col("body"))
    out = articles.join(vectors.select("article_id"), "article_id", "left_anti").withColumn("text", text).where(F.trim("text") != "")
    out = out.select("article_id", "text", "published_at", "created_at")
    return out.orderBy(F.col("published_at").asc_nulls_last(), "created_at", "article_id").limit(limit) if limit else out


def hashed_encoder(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder without a model: signed hashed tokens, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for token in text.lower().split():
                h = zlib.crc32(token.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], *, model: str, dim: int, batch: int = 32) -> DataFrame:
    """article_id, model_name, dim, text_hash, embedding for rows (article_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, batch) for i in range(0, whole.num_rows, batch)):
                v = np.ascontiguousarray(encoder(b.column(2).to_pylist()), np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["article_id", "text_hash", "embedding"])

    source = df.select("article_id", F.sha2("text", 256).alias("text_hash"), "text")
    out = source.mapInArrow(run, f"article_id {source.schema[0].dataType.simpleString()}, text_hash string, embedding array<float>")
    return out.withColumn("model_name", F.lit(model)).withColumn("dim", F.lit(dim))


def current_model(vectors: DataFrame, model: str) -> DataFrame:
    return vectors.where(F.col("model_name") == model)
