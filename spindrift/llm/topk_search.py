"""Exact top-k search by inner product: tiled matrix products with tree merging.

Rows are packed into shards (all candidates) and blocks (the queries); every pair of
a block and a shard is one tile.  A tile is one matrix product, of which only the k
best candidates per query are kept.  The per-tile lists are merged in two levels:
first within a quarter as many groups as there are shuffle partitions, then over the groups.

Shuffled: the packed shards once for each query block, the blocks once for each group of
SHARDS_TOGETHER shards, and k rows per query and tile. A block meets one group of shards in
a key of its own, so the keys, and the tasks, grow with the candidates too. No task sees
more than one shard and one block at a time, and no group grows with the number of equal
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
#: A query block and about so many shards have one key of the tiles' join.
SHARDS_TOGETHER = 4
_LIMIT = float(1 << 62)


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, computed in double; null unless the vector
    and all its components are present and finite. Values beyond +-2**62 are an error."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    floor = F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < _LIMIT, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component is beyond 2**62"))))
    return F.when(finite, floor)


def _matrix(cells: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(cells, np.int64).reshape(rows, -1) if rows and cells else np.zeros((rows, 0), np.int64)


def _packs(ids: np.ndarray, column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(dimensions, ids ascending, cells) for each run of at most ``most`` vectors of equal length."""
    lengths = np.asarray(column.value_lengths())
    cells, offsets = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        at = at[np.argsort(ids[at], kind="stable")]
        for i in range(0, len(at), most):
            part = at[i : i + most]
            rows = cells[offsets[part][:, None] + np.arange(d)] if d else np.zeros((len(part), 0), np.int64)
            yield int(d), ids[part], np.ascontiguousarray(rows, np.int64).tobytes()


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    seq = 0
    waiting: list[pa.RecordBatch] = []

    def pack() -> Iterator[pa.RecordBatch]:
        nonlocal seq
        t = pa.Table.from_batches(waiting).combine_chunks()
        for d, ids, cells in _packs(np.asarray(t["id"].combine_chunks()), t["v"].combine_chunks(), most):
            yield pa.RecordBatch.from_pylist([{"shard": task * (1 << 24) + seq, "dims": d, "ids": ids.astype(np.int64).tobytes(), "cells": cells}], schema=_SHARD)
            seq += 1

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= most:
            yield from pack()
            waiting = []
    if waiting:
        yield from pack()


_SHARD = pa.schema([("shard", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary())])


def _product(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The exact integer products: in floats as long as those hold every partial sum, in Python's
    integers where 64 bits might not; an error where a product itself is beyond them."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(s).max(initial=0)) * max(1, q.shape[1])
    if most >= 1 << 63:
        whole = q.astype(object) @ s.astype(object).T
        if max(whole.max(initial=0), -whole.min(initial=0)) >= 1 << 63:
            raise OverflowError("an inner product is beyond 64 bits")
        return whole.astype(np.int64)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind) @ s.astype(kind).T).astype(np.int64)


def best_of_tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best per query; ``ids`` ascend, so ties go to the smaller id."""
    out = ([], [], [])
    for row, query in zip(_product(q, s), query_ids, strict=True):
        at = np.flatnonzero(ids != query)
        if len(at) > k:
            scores = row[at]
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            above = np.flatnonzero(scores > edge)
            at = at[np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])]
        for o, x in zip(out, (np.full(len(at), query), ids[at], row[at]), strict=True):
            o.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                ids, queries = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["query_ids"], np.int64)
                query, vec, score = best_of_tile(queries, _matrix(x["query_cells"], len(queries)), ids, _matrix(x["cells"], len(ids)), k)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score), pa.array(np.full(len(query), x["shard"]))], ["query_id", "vec_id", "score", "shard"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k rows of ``vectors`` with the highest integer inner product, for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score. Ties go to the smaller id. A row is
    never a candidate of a query with its own id. Rows whose id is null, or whose vector
    is null or holds a null or non-finite component, take no part. Vectors of different
    lengths are not compared. Repeated ids count as one candidate for each row; the rows
    of a repeated query id share one list. Empty tables give an empty result; columns
    other than the two named are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"))
        return out.where(F.col("id").isNotNull() & F.col("v").isNotNull())

    asked = clean(queries)
    blocks = max(1, -(-asked.count() // block_rows))
    parts = max(1, -(-vectors.count() // (shard_rows * SHARDS_TOGETHER)))
    packed = clean(vectors).mapInArrow(lambda it: _shards(it, shard_rows), "shard long, dims int, ids binary, cells binary")
    block_of = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    def pack_block(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        # a block is about block_rows queries by its hash; equal ids could overfill it, so it is cut again
        rows = [{"block": key[0].as_py(), "dims": d, "query_ids": ids.astype(np.int64).tobytes(), "query_cells": cells} for d, ids, cells in _packs(np.asarray(t["id"].combine_chunks()), t["v"].combine_chunks(), block_rows)]
        return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int32()), ("dims", pa.int32()), ("query_ids", pa.binary()), ("query_cells", pa.binary())]))

    by_block = asked.withColumn("block", block_of).groupBy("block").applyInArrow(pack_block, "block int, dims int, query_ids binary, query_cells binary")
    shards = packed.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = shards.join(by_block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["block", "part", "dims"])
    found = tiles.select("shard", "ids", "cells", "query_ids", "query_cells").mapInArrow(_tiles(k), "query_id long, vec_id long, score long, shard long")
    order = (F.col("score").desc(), F.col("vec_id"))
    group = F.pmod(F.xxhash64("shard"), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
    some = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", group).orderBy(*order))).where(F.col("r") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
