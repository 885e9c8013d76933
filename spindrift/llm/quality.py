"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A document is a vector of hashed terms (word shapes, words, repetitions).  A truncated
singular value decomposition of a bounded labelled sample gives the latent space; the
sample's vectors there are broadcast, every document is compared with all of them in
blocked matrix products, and the labels of the nearest vote by similarity.

Documents are only read and mapped: no shuffle grows with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_VALUES, LOWER, SPACE, RangeHash, flat, mix, pieces, tidied, word_bounds

#: The labelled sample: at most so many rows of each label, those with the smallest hash of their id.
SAMPLE_PER_LABEL = 3000
DIMENSIONS = 64
NEIGHBOURS = 15
SHAPES, WORDS, EXTRA = 1024, 1024, 8
TERMS = SHAPES + WORDS + EXTRA


def held_out(doc_id: Column) -> Column:
    """True for rows never learned from: crc32 of the id as text, modulo 4, is 2 (or the id is null)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def _shape_classes() -> np.ndarray:
    out = np.arange(256, dtype=np.int64) % 64
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 1
    out[[9, 11, 12, 13, 32]], out[10] = 0, 4
    for i, c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        out[c] = 5 + i
    return out


_CLASS = _shape_classes()
_SHAPE_BUCKET = (mix(np.arange(64**3, dtype=np.uint64) + np.uint64(7)) % np.uint64(SHAPES)).astype(np.int64)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Terms of each text of a flat buffer, one row a text: hashed shape trigrams, hashed
    lower-cased words, and counts of repetition. Log-scaled, each part of unit length."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(offsets))
    shape = _CLASS[data]
    code = shape[:-2] * 4096 + shape[1:-1] * 64 + shape[2:]
    inside = doc[:-2] == doc[2:]
    out[:, :SHAPES] = np.bincount((doc[:-2] * SHAPES + _SHAPE_BUCKET[code])[inside], minlength=n * SHAPES).reshape(n, SHAPES)
    starts, ends, first = word_bounds(data, offsets, SPACE)
    words, of = RangeHash(BYTE_VALUES[LOWER[data]]).of(starts, ends), np.repeat(np.arange(n), np.diff(first))
    out[:, SHAPES : SHAPES + WORDS] = np.bincount(of * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    total = np.maximum(1, np.diff(first)).astype(np.float32)
    again = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n)
    order = np.lexsort((words, of))
    w, d = words[order], of[order]
    distinct = np.bincount(d[np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])])] if len(w) else d, minlength=n)
    upper = np.bincount(doc[(data >= 65) & (data <= 90)], minlength=n)
    marks = np.bincount(doc[_CLASS[data] > 4], minlength=n)
    size = np.maximum(1, np.diff(offsets)).astype(np.float32)
    extra = out[:, SHAPES + WORDS :]
    extra[:, 0], extra[:, 1] = again / total, 1 - again / total
    extra[:, 2], extra[:, 3] = distinct / total, 1 - distinct / total
    extra[:, 4], extra[:, 5] = upper / size, 1 - upper / size
    extra[:, 6], extra[:, 7] = marks / size, 1 - marks / size
    extra[total <= 1, :4] = 0
    for a, b, weight in ((0, SHAPES, 1.0), (SHAPES, SHAPES + WORDS, 0.25), (SHAPES + WORDS, TERMS, 0.8)):
        part = out[:, a:b]
        if b <= SHAPES + WORDS:
            np.log1p(part, out=part)
        norm = np.sqrt((part * part).sum(1, keepdims=True))
        part *= weight / np.maximum(norm, 1e-12)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


class Neighbours:
    """The labelled vectors in the latent space, with the projection into it."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, weights: tuple[float, float], dimensions: int = DIMENSIONS, k: int = NEIGHBOURS):
        self.k, self.weights = k, np.array(weights, np.float32)
        self.labels = labels.astype(np.int64)
        self.mean = terms.mean(0) if len(terms) else np.zeros(TERMS, np.float32)
        centred = terms - self.mean
        rng = np.random.default_rng(0)
        d = min(dimensions, *terms.shape) if len(terms) else 0
        if d:
            q = rng.standard_normal((terms.shape[1], d + 8)).astype(np.float32)
            for _ in range(4):  # subspace iteration for the leading right singular vectors
                q, _ = np.linalg.qr(centred.T @ (centred @ q))
            _, _, vt = np.linalg.svd(centred @ q, full_matrices=False)
            self.projection = (q @ vt[:d].T).astype(np.float32)
            self.vectors = _unit(centred @ self.projection).astype(np.float32)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity and class share. Of
        those as similar as the k-th, the first in the sample's order vote; without a sample
        every score is 1."""
        if not len(self.labels):
            return np.ones(len(terms))
        out = np.empty(len(terms))
        k = min(self.k, len(self.labels))
        for i in range(0, len(terms), 256):
            sims = _unit((terms[i : i + 256] - self.mean) @ self.projection) @ self.vectors.T
            edge = np.partition(sims, -k, axis=1)[:, -k][:, None]
            above, equal = sims > edge, sims == edge
            equal &= np.cumsum(equal, axis=1) <= k - above.sum(1)[:, None]
            near = np.nonzero(above | equal)[1].reshape(len(sims), k)
            votes = np.maximum(np.take_along_axis(sims, near, 1), 1e-6) ** 4 * self.weights[self.labels[near]]
            out[i : i + 256] = (votes * self.labels[near]).sum(1) / votes.sum(1)
        return np.clip(out, 0.0, 1.0)


def fit(documents: DataFrame, labels: DataFrame, *, sample_per_label: int = SAMPLE_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Neighbours:
    """Learn from a bounded sample of the labelled rows that are not held out.

    At most ``sample_per_label`` ids of each label reach the driver, one row of each as
    TERMS numbers; of an id's rows, the one whose terms have the smallest hash. The class shares are counted over all labelled rows. Rows with a null id or
    label, and labels other than 0 and 1, are not learned from.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).distinct()
    shares = {r["__label"]: r["count"] for r in usable.groupBy("__label").count().collect()}
    chosen = [usable.where(F.col("__label") == x).orderBy(F.xxhash64("__id"), "__id").limit(sample_per_label) for x in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    texts = documents.join(F.broadcast(sample), documents[id_col] == sample["__id"]).select("__id", "__label", F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                terms = term_counts(*flat(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([x.tobytes() for x in terms], pa.binary())], ["id", "label", "terms"])

    each = texts.mapInArrow(tidied(run), "id string, label int, terms binary")
    once = each.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("terms").alias("hash"), "terms"))["terms"].alias("terms"))
    rows = sorted(once.collect(), key=lambda r: (r["label"], r["id"]))
    terms = np.array([np.frombuffer(r["terms"], np.float32) for r in rows], np.float32).reshape(len(rows), TERMS)
    y = np.array([r["label"] for r in rows], np.int64)
    got = np.bincount(y, minlength=2)
    total = max(1, sum(shares.values()))
    weights = tuple((shares.get(x, 0) / total) / max(1e-9, got[x] / max(1, len(y))) if got[x] else 1.0 for x in (0, 1))
    return Neighbours(terms, y, weights)


def classify(documents: DataFrame, model: Neighbours, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; whole texts only are scored.

    Null and empty texts get the score of a text without terms. Every row is kept,
    repeated ones too; other columns are ignored. A row with a null id counts as held out.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                scores = shipped.value.score(term_counts(*flat(batch.column(2))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = documents.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return source.mapInArrow(tidied(run), f"doc_id {source.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: Neighbours, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)
    plain = documents.toDF(*[f"_{i}" for i in range(len(documents.columns))])  # names with dots can't be mapped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, f"_{at}"):
                yield batch.filter(pa.array(shipped.value.score(term_counts(*flat(batch.column(at)))) >= threshold))

    return plain.mapInArrow(tidied(run), plain.schema).toDF(*documents.columns)
