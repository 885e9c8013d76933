"""Hard-negative mining: Strassen products of anchor and candidate tiles, and mergeable heaps.

Vectors are packed into tiles of about a megabyte where they lie, one tile for each bucket of
labels.  Anchors meet candidates tile by tile; the integer products of two tiles come from
Strassen's recursion on int64 with zero padding.  Sums and differences modulo 2**64 are exact
as long as the products themselves fit, and tiles whose bounds say that they might not are
multiplied as Python integers.

Two rounds, because a window of scores is known only with its positive:

1. positives: anchors meet the tiles of their label's bucket, and keep a heap of the best rows
   of their label;
2. windows: anchors, now with the bounds of each positive, meet all tiles, and keep a heap of
   the best rows of other labels for each positive.

A heap is rows of (owner, score, id), at most k for an owner; merging is associative, so a
task merges those of its tiles, and Spark merges those of the tasks behind a group limit.

The tiles of a round are a grid: ``TOGETHER`` anchor tiles and as many candidate tiles share a
key, so keys grow with the product of both, whatever share of the rows one label has, and a
task holds one pair of tiles.  Written once: the candidates' tiles.  Shuffled: candidate tiles
once for each TOGETHER anchor tiles, and heaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import tidied
from .tables import written
from .topk_search import quantised

#: Most rows and numbers of a tile, and numbers that a task holds before it cuts tiles.
TILE_ROWS, TILE_CELLS, HELD_CELLS = 2048, 1 << 17, 1 << 21
#: Most rows of an anchor tile.
ANCHOR_ROWS = 512
#: Labels fall into at most so many buckets.
LABEL_BUCKETS = 64
#: Anchor tiles, and candidate tiles, that share a key of the grid.
TOGETHER = 4
#: Tiles with a side of at most this many are multiplied directly.
LEAF = 16


# ---- products


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The matrix product in seven half-size products a level, down to ``leaf``; sides are padded
    with zeros. int64 sums may wrap on the way: only the products must fit."""
    m, k = a.shape
    n = b.shape[1]
    levels = max(0, (max(1, min(m, k, n)) - 1).bit_length() - (leaf - 1).bit_length())
    unit = 1 << levels
    up = lambda x: -(-x // unit) * unit
    left, right = np.zeros((up(m), up(k)), a.dtype), np.zeros((up(k), up(n)), b.dtype)
    left[:m, :k], right[:k, :n] = a, b
    return _strassen(left, right, levels)[:m, :n]


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    i, j, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :n], b[:j, n:], b[j:, :n], b[j:, n:]
    down = levels - 1
    p1 = _strassen(a11 + a22, b11 + b22, down)
    p2 = _strassen(a21 + a22, b11, down)
    p3 = _strassen(a11, b12 - b22, down)
    p4 = _strassen(a22, b21 - b11, down)
    p5 = _strassen(a11 + a12, b22, down)
    p6 = _strassen(a21 - a11, b11 + b12, down)
    p7 = _strassen(a12 - a22, b21 + b22, down)
    out = np.empty((a.shape[0], b.shape[1]), a.dtype)
    out[:i, :n] = p1 + p4 - p5 + p7
    out[:i, n:] = p3 + p5
    out[i:, :n] = p2 + p4
    out[i:, n:] = p1 - p2 + p3 + p6
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of the rows of two int64 matrices, exactly; an error where one is no int64."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 63:
        return strassen(a, b.T)
    whole = strassen(a.astype(object), b.astype(object).T)
    if whole.size and max(whole.max(), -whole.min()) >= 1 << 63:
        raise OverflowError("an inner product is beyond 64 bits")
    return whole.astype(np.int64)


# ---- heaps: owners, scores and ids, at most k rows for an owner, best first, ties to the smaller id


def merged(owners: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The heaps that hold the k best rows for each owner; equal rows count once."""
    at = np.lexsort((ids, ~scores, owners))
    o, s, i = owners[at], scores[at], ids[at]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    o, s, i = o[new], s[new], i[new]
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    place = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
    keep = place < k
    return o[keep], s[keep], i[keep]


def heaps_of_tile(scores: np.ndarray, allowed: np.ndarray, owners: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``scores``, its k best allowed columns."""
    s = np.where(allowed, scores, np.iinfo(np.int64).min)
    if s.shape[1] > k and len(np.unique(ids)) == len(ids):  # rows of one id could stand for one
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        allowed = allowed & (s >= edge[:, None])
    row, column = np.nonzero(allowed)
    return merged(owners[row], scores[row, column], ids[column], k)


# ---- tiles


def _narrow(cells: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest needs; the row count and dimensions tell how many."""
    most = max(int(cells.max(initial=0)), -int(cells.min(initial=0)))
    kind = np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return np.ascontiguousarray(cells, kind).tobytes()


def _wide(cells: bytes, rows: int, dims: int) -> np.ndarray:
    if not rows * dims:
        return np.zeros((rows, dims), np.int64)
    return np.frombuffer(cells, np.dtype(f"i{len(cells) // (rows * dims)}")).reshape(rows, dims).astype(np.int64)


_TILE = "tile long, bucket int, dims int, rows int, ids binary, labels binary, cells binary"


def _tiles(rows: DataFrame, extra: str | None = None, most: int = TILE_ROWS) -> DataFrame:
    """Tiles of rows (id, label, bucket, v and, as ``extra``, a list of longs), cut in each task."""
    names = ["id", "label", "bucket", "v", *([extra] if extra else [])]
    kinds = [("tile", pa.int64()), *[(n, pa.int32()) for n in ("bucket", "dims", "rows")], *[(n, pa.binary()) for n in ("ids", "labels", "cells", *names[4:])]]
    schema = pa.schema(kinds)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
        waiting: list[pa.RecordBatch] = []
        held = 0

        def cut() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            t = pa.Table.from_batches(waiting).combine_chunks()
            ids, labels, buckets = (np.asarray(t[c].combine_chunks()) for c in names[:3])
            v = t["v"].combine_chunks()
            lengths, flat = np.asarray(v.value_lengths()), np.asarray(v.flatten())
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            for bucket, d in sorted(set(zip(buckets.tolist(), lengths.tolist(), strict=True))):
                at = np.flatnonzero((buckets == bucket) & (lengths == d))
                size = max(64, min(most, TILE_CELLS // max(1, d)))
                for i in range(0, len(at), size):
                    part = at[i : i + size]
                    cells = flat[offsets[part][:, None] + np.arange(d)] if d else np.zeros((len(part), 0), np.int64)
                    row = {"tile": task * (1 << 24) + seq, "bucket": bucket, "dims": d, "rows": len(part), "ids": ids[part].astype(np.int64).tobytes(), "labels": labels[part].astype(np.int64).tobytes(), "cells": _narrow(cells)}
                    if extra:
                        row[extra] = np.asarray(t[extra].combine_chunks().take(pa.array(part)).flatten(), np.int64).tobytes()
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
                    seq += 1

        for batch in batches:
            waiting.append(batch)
            held += len(batch.column(3).flatten())
            if held >= HELD_CELLS:
                yield from cut()
                waiting, held = [], 0
        if waiting:
            yield from cut()

    return rows.select(*names).mapInArrow(run, "tile long, bucket int, dims int, rows int, ids binary, labels binary, cells binary" + (f", {extra} binary" if extra else ""))


def _grid(anchors: DataFrame, tiles: DataFrame, anchor_counts: dict[int, int], tile_counts: dict[int, int], bucket: Column) -> DataFrame:
    """Every pair of an anchor tile and a candidate tile of one bucket and length, dealt out by cells of a grid."""

    def cells(counts: dict[int, int]) -> Column:
        known = [F.lit(x) for b, n in counts.items() for x in (b, max(1, -(-n // TOGETHER)))]
        return F.coalesce(F.try_element_at(F.create_map(*known), F.col("g")), F.lit(1)) if known else F.lit(1)

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("tile"), n).cast("int")
    a = anchors.withColumn("g", bucket).withColumn("x", mine(cells(anchor_counts))).withColumn("y", every(cells(tile_counts))).drop("bucket", "tile")
    c = tiles.withColumn("g", bucket).withColumn("y", mine(cells(tile_counts))).withColumn("x", every(cells(anchor_counts))).drop("bucket", "tile")
    a = a.withColumnsRenamed({n: f"a_{n}" for n in ("rows", "ids", "labels", "cells")})
    return a.join(c, ["g", "x", "y", "dims"]).drop("g", "x", "y")


def _mined(pairs: DataFrame, k: int, extra: str, slots) -> DataFrame:
    """owner, score, id: heaps of each task. ``slots`` gives, for a pair of tiles, (owners, allowed) tables."""
    names = ["dims", "a_rows", "a_ids", "a_labels", "a_cells", extra, "rows", "ids", "labels", "cells"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, waiting = [[], [], []], 0
        for batch in batches:
            for i in range(batch.num_rows):
                x = {n: batch.column(c)[i].as_py() for c, n in enumerate(names)}
                ids, labels, a_ids, a_labels = (np.frombuffer(x[n], np.int64) for n in ("ids", "labels", "a_ids", "a_labels"))
                scores = products(_wide(x["a_cells"], x["a_rows"], x["dims"]), _wide(x["cells"], x["rows"], x["dims"]))
                for owners, allowed in slots(x[extra], a_ids, a_labels, ids, labels, scores):
                    for into, part in zip(heap, heaps_of_tile(scores, allowed, owners, ids, k), strict=True):
                        into.append(part)
                    waiting += len(heap[0][-1])
                if waiting > 1 << 18:
                    heap = [[h] for h in merged(*map(np.concatenate, heap), k)]
                    waiting = len(heap[0][0])
                    if waiting > 1 << 17:  # mostly different owners: nothing more to merge here
                        yield pa.RecordBatch.from_arrays([pa.array(h[0]) for h in heap], ["owner", "score", "id"])
                        heap, waiting = [[], [], []], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(h) for h in merged(*map(np.concatenate, heap), k)], ["owner", "score", "id"])

    found = pairs.select(*names).mapInArrow(run, "owner long, score long, id long")
    best = Window.partitionBy("owner").orderBy(F.col("score").desc(), "id")
    # equal rows of different tasks have one rank, and are in one partition already
    return found.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k).distinct()


def _positive_slots(keys: bytes, a_ids, a_labels, ids, labels, scores) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield np.frombuffer(keys, np.int64), (a_labels[:, None] == labels[None, :]) & (a_ids[:, None] != ids[None, :])


def _window_slots(low: int, high: int, positives: int):
    def slots(cells: bytes, a_ids, a_labels, ids, labels, scores) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        table = np.frombuffer(cells, np.int64).reshape(len(a_ids), positives, 2)
        other = a_labels[:, None] != labels[None, :]
        for slot in range(positives):
            owners = table[:, slot, 0]
            # without a positive in this slot the score is -1, and no score is within its window
            scale = table[:, slot, 1].astype(object)
            lo, hi = (-(-low * scale // 100)).astype(np.int64), (high * scale // 100).astype(np.int64)
            yield owners, other & (scores >= lo[:, None]) & (scores <= hi[:, None]) & (table[:, slot, 1] >= 0)[:, None]

    return slots


def mine_hard_negatives(vectors: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` are rows of ``vectors``. An anchor's positives are its ``positives`` best other
    rows of the same label. For each, the ``negatives`` best rows of another label whose score
    is between ``low`` and ``high`` hundredths of the positive's are returned, ranked from 1.
    Scores are inner products of vectors of floor(scale * x); ties go to the smaller id. A
    negative positive score has no window.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no
    part; vectors of different lengths aren't compared. Rows with an anchor's own id are no
    candidates of it. Rows equal in id and score count once for an anchor, and anchors equal in
    id, label and vector are one; anchors that share only their id have lists of their own.
    Empty tables give an empty result, and other columns are ignored, whatever their names.
    """

    def clean(df: DataFrame) -> DataFrame:
        out = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), quantised(F.col(f"`{vector_col}`"), scale).alias("v"))
        return out.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int"))

    packed = written(_tiles(clean(vectors)), "tiles")
    # numbers, not hashes, tell anchors and windows apart; they are written before they are used
    asked = written(clean(anchors).distinct().withColumn("key", F.monotonically_increasing_id()), "anchors")
    blocks = written(_tiles(asked.withColumn("keys", F.array("key")), "keys", ANCHOR_ROWS), "blocks")
    counted = lambda df: {r.bucket: r["count"] for r in df.groupBy("bucket").count().collect()}  # noqa: E731  LABEL_BUCKETS rows at most
    tile_counts = counted(packed)
    found = _mined(_grid(blocks, packed, counted(blocks), tile_counts, F.col("bucket")), positives, "keys", _positive_slots)
    # a window is owned by an anchor's key and the place of its positive
    best = found.where("score >= 0").select(F.col("owner").alias("key"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("owner") * positives + F.col("rank") - 1).alias("owner"))
    best = written(best, "positives")
    slots = best.groupBy("key").agg(F.flatten(F.collect_list(F.array("owner", "positive_score"))).alias("s"))
    filled = F.concat("s", F.array_repeat(F.lit(-1).cast("long"), F.lit(2 * positives) - F.size("s")))
    again = written(_tiles(asked.join(slots, "key").withColumn("windows", filled), "windows", ANCHOR_ROWS), "blocks")
    in_all = lambda counts: {0: sum(counts.values())}
    taken = _mined(_grid(again, packed, in_all(counted(again)), in_all(tile_counts), F.lit(0)), negatives, "windows", _window_slots(low, high, positives))
    out = taken.join(best, "owner").join(asked.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
