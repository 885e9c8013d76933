"""Best-fit packing of tokenised documents into fixed-size sequences.

Planning works on the histogram of lengths alone: best fit over counts, longest
length first, places whole groups of equal pieces into whole groups of equal bins.
The histogram has at most ``capacity`` rows, whatever the number of documents, so it
is the only thing that reaches the driver.  Pieces then get a rank within their
length and take the planned slot with that length and rank by an equi-join.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import pieces, tidied
from .tables import written

CAPACITY = 2048
#: Salt for ranks: the ranks of one length are counted in so many parts.
RANK_PARTS = 256
#: Slots of one plan row are listed in runs of at most this many.
SLOT_RUN = 1 << 16
#: How byte-level tokenizers cut a text before merging, and the bytes that
#: their files write as themselves (all others as the characters from 256 on, in order).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_level(tokenizer: Any) -> Any:
    """A tiktoken encoding with the vocabulary and merges of a byte-level tokenizer file; None for
    files of another kind. It gives the same ids in a quarter of the time."""
    import tiktoken

    whole = json.loads(tokenizer.to_str())
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not whole.get("normalizer")
    odd = any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or model.get("type") != "BPE" or odd:
        return None
    others = [i for i in range(256) if i not in PRINTED]
    byte_of = {chr(i): i for i in PRINTED} | {chr(256 + n): i for n, i in enumerate(others)}
    vocabulary = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
    merged = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
    if merged != sorted(set(merged)) or len(vocabulary) != 256 + len(merged):  # an id must tell its merge's turn
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})


class Tokens:
    """Token ids of whole texts by the tokenizer file at ``path``.

    Texts with an added token's literal or too long a run of white space, and all texts of a
    file that isn't byte-level, are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = byte_level(self.tokenizer)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.added):
            return self.encode(text)
        try:
            return self.fast.encode_to_numpy(text)
        except ValueError:  # its pattern engine gives up on white space of some million characters
            return self.encode(text)

    def check(self, text: str) -> None:
        """Leave the fast way if it differs from the tokenizer on ``text``."""
        if self.fast is not None and not np.array_equal(self.ids(text), self.encode(text)):
            self.fast = None


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and one ``end_id``, cut
    from its end into pieces of ``capacity`` where it is longer, so that only the first piece
    may be shorter. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, checked = Tokens(tokenizer_path), False  # gone when the task ends
        for whole in batches:
            for batch in pieces(whole, "text"):
                out = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string()).to_pylist(), strict=True):
                    if text and not checked:
                        tokens.check(text)
                        checked = True
                    ids = np.append(tokens.ids(text), np.uint32(end_id)) if text else np.array([end_id], "<u4")
                    first = len(ids) % capacity or min(len(ids), capacity)
                    for p, end in enumerate(range(first, len(ids) + 1, capacity)):
                        start = max(end - capacity, 0)
                        part = np.ascontiguousarray(ids[start:end], "<u4")
                        out.append((key, p, start, len(part), zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(tidied(run), f"doc_id {source.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: (length, first rank, count, first sequence, offset) for runs of
    pieces of one length that lie at one offset of consecutive sequences.

    Longest length first. A piece goes to the bins with the least room that holds it; a
    new bin opens only when none does. Bins that were filled alike stay one group. Counts
    only are handled, so the work depends on the number of lengths, not of pieces.
    """
    rooms: list[int] = []  # ascending, those that have bins
    bins: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, count)
    out, sequences = [], 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[i]
            else:
                room = capacity
                per_bin = capacity // length
                first, count = sequences, -(-left // per_bin)
                sequences += count
            n = min(left, count)
            out.append((length, rank, n, first, capacity - room))
            if room > length:
                put(room - length, (first, n))
            if n < count:
                put(room, (first + n, count - n))
            left, rank = left - n, rank + n
    return out


def pack(token_lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``token_lengths`` (a table with doc_id, piece, length) plus sequence_id and offset.

    Every row gets a place; the rows of a sequence fill it without gaps from 0. Lengths
    must be in 1..capacity. The order among pieces of one length is by a hash of the
    document, so ties and repeated rows need no care.
    """
    spark = token_lengths.sparkSession
    keyed = token_lengths.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).cast("int"))
    counted = keyed.groupBy("length", "part").count()
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity) or [(0, 0, 0, 0, 0)], "length long, rank long, n long, first long, offset long").where("n > 0")
    runs = slots.select("length", "rank", "n", "first", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SLOT_RUN}"))).alias("run"))
    runs = runs.repartition(F.col("length"), F.col("rank"), F.col("run"))
    places = runs.select("length", "rank", "first", "offset", F.explode(F.sequence(F.col("run") * SLOT_RUN, F.least(F.col("n"), (F.col("run") + 1) * SLOT_RUN) - 1)).alias("i"))
    places = places.select("length", (F.col("rank") + F.col("i")).alias("rank"), (F.col("first") + F.col("i")).alias("sequence_id"), "offset")
    before = counted.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("r"))
    return ranked.join(places, ["length", "rank"]).drop("rank", "r", "part", "before")


def best_fit_packing(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one closing id 0; null and empty texts are that one id. Only
    documents longer than ``capacity`` are cut, and only their first piece may be shorter. An
    empty table gives no rows; repeated rows are packed each; other columns are ignored.
    """
    cut = written(token_pieces(documents, tokenizer_path, capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
