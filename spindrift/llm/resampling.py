"""Importance resampling towards a target distribution, with hashed n-grams from prefix CRCs.

A document is its words joined by one space, scanned once: a running CRC-32 is kept at the
start and at the end of every word.  CRC-32 is linear over GF(2), so the CRC of the words
from i to j needs no second look at them: the prefix up to the start of word i, shifted by
the bytes of the span (a multiplication by x**(8 * bytes) modulo the polynomial), cancels
out of the prefix up to the end of word j.

    crc(words i..j) = crc(prefix to end of j) XOR shift(crc(prefix to start of i), bytes of the span)

The scan's result, two bytes or four for each feature, is written; counts of the corpus and
weights of documents are read from it, so texts are read once.  Counts are summed in each
task over the fixed number of buckets, then by Spark; the gains, one number for each
bucket, are all that comes to the driver.  Ranks come from a range sort and the totals of
its blocks, so no task or window holds all scores.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import positions
from .arrays import LOWER, as_binary, flat, pieces, tidied, word_bounds
from .tables import written

BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: The reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Words whose CRCs are worked on at once.
_CHUNK = 1 << 16


@functools.cache
def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), c >> np.uint32(1))
    return c


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit vectors, given as four tables of 256 values, applied to each of ``x``."""
    return matrix[0][x & 255] ^ matrix[1][x >> np.uint32(8) & 255] ^ matrix[2][x >> np.uint32(16) & 255] ^ matrix[3][x >> np.uint32(24)]


@functools.cache
def _shifts() -> list[np.ndarray]:
    """For each power of two, the map that appends so many zero bytes to a CRC's message."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [_byte_table()[values & 255] ^ (values >> np.uint32(8))]
    for _ in range(40):
        out.append(_times(out[-1], out[-1]))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC multiplied by x**(8 * n_bytes), by the binary digits of n_bytes."""
    out = crc.astype(np.uint32, copy=True)
    for bit in range(int(n_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero(n_bytes >> bit & 1)
        out[at] = _times(_shifts()[bit], out[at])
    return out


def prefix_crcs(words: list[bytes], crc: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The running CRCs of words joined by a space, at the start and the end of each word.

    ``crc`` is that of what stands before the first word, its space included.
    """
    spaced = itertools.chain(words[:1], (b" " + w for w in words[1:]))
    ends = np.fromiter(itertools.accumulate(spaced, lambda c, w: zlib.crc32(w, c), initial=crc), np.uint32, len(words) + 1)
    before = ~ends[1:-1]
    starts = ~(_byte_table()[(before ^ np.uint32(32)) & 255] ^ (before >> np.uint32(8)))
    return np.concatenate([ends[:1], starts]), ends[1:]


def span_crcs(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray, grams: int) -> np.ndarray:
    """CRC-32 of every run of ``grams`` consecutive words, from the prefixes and the words' bounds
    (positions in the text with one space between words)."""
    n = len(starts) - grams + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    # a CRC is affine, not linear: with the same start and end conditions on both sides they cancel
    return ends[grams - 1 :] ^ shifted(starts[:n], (end[grams - 1 :] - begin[:n]).astype(np.int64))


def document_crcs(data: bytes, begin: np.ndarray, end: np.ndarray, grams: int) -> Iterator[np.ndarray]:
    """CRCs of all runs of 1 to ``grams`` words of one document, whose words are given by their
    bounds in ``data``; some tens of thousands of words at a time, each scanned once."""
    crc, at, kept = 0, 0, None
    for i in range(0, len(begin), _CHUNK):
        b, e = begin[i : i + _CHUNK].tolist(), end[i : i + _CHUNK].tolist()
        starts, ends = prefix_crcs([data[x:y] for x, y in zip(b, e, strict=True)], crc)
        length = end[i : i + _CHUNK] - begin[i : i + _CHUNK]
        stop = at + np.cumsum(length + 1) - 1
        now = (starts, ends, stop - length, stop)
        crc, at = zlib.crc32(b" ", int(ends[-1])), int(stop[-1]) + 1
        # runs that began in the chunk before need its last words
        whole = now if kept is None else tuple(np.concatenate([a, b]) for a, b in zip(kept, now, strict=True))
        old = 0 if kept is None else len(kept[0])
        for n in range(1, grams + 1):
            skip = max(0, old - n + 1)
            yield span_crcs(*(x[skip:] for x in whole), n)
        kept = tuple(x[max(0, len(x) - grams + 1) :] for x in whole) if grams > 1 else None


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _scanner(buckets: int, grams: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, offsets = flat(as_binary(batch.column(0)))
                lower = LOWER[data]
                begin, end, first = word_bounds(lower, offsets, _SEPARATOR)
                text, cells = lower.tobytes(), []
                for i in range(batch.num_rows):
                    a, b = first[i], first[i + 1]
                    found = [(c % np.uint32(buckets)).astype(_kind(buckets)) for c in document_crcs(text, begin[a:b], end[a:b], grams)]
                    cells.append(np.concatenate(found).tobytes() if found else b"")
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(first), pa.int64()), pa.array(cells, pa.binary())], [*batch.schema.names[1:], "n_words", "features"])

    return run


def scan(df: DataFrame, *keys: str, text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """``keys``, n_words and features (the buckets of all n-grams, packed): one scan of each text."""
    rows = df.select(F.col(f"`{text_col}`").alias("text"), *keys)
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(_scanner(buckets, grams), types + "n_words long, features binary")


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often each bucket occurs in all documents; each task sends a row a bucket at most."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            data, _ = flat(batch.column(0))
            sums += np.bincount(np.frombuffer(data.tobytes(), _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    return scanned.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, 1000 times the logarithm of how much likelier it is in the target, rounded
    down; both tables are ``scan`` results. ``buckets`` numbers come to the driver."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(bucket_counts(source, buckets).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "left")
    both = written(both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")), "buckets")
    source_sum, target_sum = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * (source_sum + buckets) / ((F.col("s") + 1) * (target_sum + buckets))
    out = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def weights(scanned: DataFrame, gain: np.ndarray) -> DataFrame:
    """The columns of a scan with n_features and weight, the floored mean gain (none: 0), for ``features``."""
    buckets = len(gain)
    rest = [c for c in scanned.columns if c != "features"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            values = np.frombuffer(data.tobytes(), _kind(buckets))
            sums = np.concatenate([[0], np.cumsum(gain[values])])
            at = offsets // values.itemsize
            n = np.diff(at)
            weight = np.where(n > 0, (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n), pa.array(weight)], [*rest, "n_features", "weight"])

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in scanned.select(*rest).schema.fields)
    return scanned.select("features", *rest).mapInArrow(run, types + "n_features long, weight long")


def gumbel(seed: int, key: Column) -> Column:
    """1000 times standard Gumbel noise, rounded down, from the hash of the seed and a key (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(documents: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, grams: int = GRAMS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank for every document.

    Features are all runs of 1 to ``grams`` words, each hashed to one of ``buckets``; weight
    is the floored mean of their gains towards ``target`` (a table with ``text_col``). Of the
    documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down)
    with the highest weight plus Gumbel noise are drawn, without replacement, and ranked; all
    others have a null rank. Ties go to the smaller id, then the smaller weight and feature
    count; null ids come last.

    Null and empty texts have no words: no features, weight 0. Every row is kept and counts
    by itself, repeated ones too (rows of one id share their noise). Empty tables give an
    empty result, an empty target equal odds. Very long texts are scanned some 65,000 words
    at a time. Other columns are ignored, whatever their names.
    """
    source = written(scan(documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "doc_id", buckets=buckets, grams=grams), "features")
    wanted = written(scan(target, text_col=text_col, buckets=buckets, grams=grams), "target")
    scored = weights(source, gains(source, wanted, buckets)).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    scored = written(scored, "scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = positions(scored.where(able), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("n_words")])
    rank = F.when(F.col("position") <= drawn, F.col("position")).cast("long").alias("rank")
    out = ("doc_id", "n_features", "weight", "score")
    return placed.select(*out, rank).unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))
