"""Removal of repeated passages: every byte covered by a long string that starts earlier too.

Equal strings of LENGTH bytes are found by the suffix order of collections, built
column-wise: one symbol of every text in each round (see ``column_suffixes``).  Rounds
are bounded because the texts of a collection are short segments, and all segments that
can hold equal strings are in one collection, because they are dealt out by content:

1. Every string of LENGTH bytes has one anchor, the place of the smallest hash among its
   KMER-byte substrings. Equal strings have equal anchors at equal places. A run of strings
   with a common anchor is one segment, at most 2 * LENGTH - KMER bytes.
2. Records of segments (hash of the anchor, hash of the bytes, place) meet by anchor. An
   anchor that occurs once can't be in a repeated string. Copies of a segment are one text
   of the collection, with the places of all of them.
3. The segments of repeated anchors are cut from their documents and meet by anchor, some
   hundred kilobytes in one collection. Neighbours in its suffix order with a common prefix
   of LENGTH bytes are one string, and all its places but the first are repeats.
4. The repeats of a document are united and cut out.

Substrings that many documents of a small sample share are chosen as anchors only where
there are no others (``common_slots``). So a phrase of a third of all documents with
different words around it doesn't gather them at one anchor; where all of a string is
such a phrase, its copies are one segment. The sample changes no result.

A document is a row's id and text together: it is known by ``sub``, a hash of both, and
ordered by id, then by ``sub``. Only rows equal in both are one document.

Each step first drops, within a task, what it has seen before, so a passage in a third of
all documents sends one record from each block of BLOCK_BYTES. Texts are shuffled once (the
exchange serves steps 3 and 4); records are shuffled as packed arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import BYTE_VALUES, RangeHash, flat, mix, pieces, tidied
from .column_suffixes import suffix_order
from .tables import BATCH_BYTES, written

LENGTH = 100
KMER = 32
#: Bytes of text for which one bucket is planned; the number of buckets grows with the input.
BUCKET_BYTES = 8 << 20
#: Within a task, repeats are dropped among so many bytes of text.
BLOCK_BYTES = 16 << 20
#: Texts are read in portions of this size, longer ones in overlapping parts.
SEGMENT_BYTES = 1 << 18
#: Segments of one collection together, unless one anchor has more.
COLLECTION_BYTES = 1 << 19
#: Anchors are chosen with the help of about so many documents ...
SAMPLE_DOCUMENTS = 500
#: ... of which so many share a substring that isn't taken if there is another,
SAMPLE_SHARED = 5
#: known by so many bits of its hash.
SLOT_BITS = 20
NO_ID = np.iinfo(np.int64).max

#: A record as it is shuffled. A text is shorter than 2**31 bytes, a run than 2**16 strings.
_TYPES = {"key": np.uint64, "bytes": np.uint64, "doc": np.int64, "sub": np.int64, "lo": np.int32, "n": np.uint16}
_RECORD = tuple(_TYPES)
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each run of ``w`` consecutive values, in two passes over blocks of ``w``."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[w - 1 : w - 1 + n])


def _kmer_hashes(data: np.ndarray, kmer: int) -> np.ndarray:
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = np.zeros(len(data) - kmer + 1, np.uint64)
    for i, c in zip(range(0, kmer, 8), _MULTIPLIERS, strict=True):
        h += words[i : i + len(h)] * c
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def common_slots(documents: DataFrame, rows: int, kmer: int = KMER) -> np.ndarray:
    """Which values of a substring hash's first bits SAMPLE_SHARED or more of a sample's documents hold.

    The sample is about SAMPLE_DOCUMENTS of the ``rows`` documents, chosen by hash; at most
    2**SLOT_BITS numbers reach the driver. It says what makes a good anchor, nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1):
                data, _ = flat(batch.column(0))
                if len(data) >= kmer:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.unique(_slots(_kmer_hashes(data[i : i + SEGMENT_BYTES + kmer - 1], kmer))) for i in range(0, len(data) - kmer + 1, SEGMENT_BYTES)])))], ["slot"])

    sample = documents.where(F.pmod("sub", F.lit(max(1, rows // SAMPLE_DOCUMENTS))) == 0).select("text")
    shared = sample.mapInArrow(tidied(run), "slot int").groupBy("slot").count().where(F.col("count") >= SAMPLE_SHARED)
    out = np.zeros(1 << SLOT_BITS, bool)
    out[[r["slot"] for r in shared.select("slot").collect()]] = True
    return out


def anchor_runs(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, base: int = 0, first: int = 0, last: int | None = None, length: int = LENGTH, kmer: int = KMER, subs: np.ndarray | None = None, common: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The anchor records of texts in a flat buffer.

    For a segment of one text, ``base`` is its place there and starts outside [first, last)
    of the buffer are left to the neighbouring segments.
    """
    empty = {k: np.zeros(0, np.uint64 if t is np.uint64 else np.int64) for k, t in _TYPES.items()}
    if len(data) < length:
        return empty
    h = _kmer_hashes(data, kmer)
    rank = h if common is None else h >> np.uint64(1) | common[_slots(h)].astype(np.uint64) << np.uint64(63)
    bits = np.uint64(int(len(h)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    minima = _window_minima((rank & ~low) | np.arange(len(h), dtype=np.uint64), length - kmer + 1)
    at = (minima & low).astype(np.int64)
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:], sizes)[: len(at)]
    s = np.arange(len(at))
    valid = (s + length <= ends) & (s >= first) & (s < (len(at) if last is None else last))
    starts = s[valid]
    if not len(starts):
        return empty
    at = at[valid]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    lo = starts[new]
    n = np.diff(np.append(np.flatnonzero(new), len(starts)))
    at = at[new]
    doc = np.searchsorted(offsets, at, side="right") - 1
    shape = (at - lo) * 1024 + n
    content = mix(RangeHash(BYTE_VALUES[data]).of(lo, lo + n - 1 + length) + shape.astype(np.uint64))
    return {"key": h[at], "bytes": content, "doc": ids[doc], "sub": np.zeros(len(doc), np.int64) if subs is None else subs[doc], "lo": lo - (offsets[doc] - base), "n": n}


def _first_of(r: dict[str, np.ndarray], *by: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The records sorted by ``by``, document and place; and which are later than the first of their group."""
    order = np.lexsort(tuple(r[x] for x in ("lo", "sub", "doc", *reversed(by))))
    r = {k: v[order] for k, v in r.items()}
    n = len(r["doc"])
    new = np.zeros(n, bool)
    for x in by:
        new[1:] |= r[x][1:] != r[x][:-1]
    new[:1] = True
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return r, (r["doc"] != r["doc"][head]) | (r["sub"] != r["sub"][head]) | (r["lo"] != r["lo"][head])


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(k, pa.binary()) for k in _RECORD], ("data", pa.binary())])
_PACKED_DDL = "bucket int, kind int, " + ", ".join(f"{k} binary" for k in _RECORD) + ", data binary"
#: Kinds of packed rows: records of segments, repeats found, segments to cut from documents, those segments.
RECORDS, REPEATS, WANTED, SEGMENTS = range(4)


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes, all first ones, then all second ones and so on: ascending small
    numbers then compress well in the shuffle."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _from_planes(data: bytes, t: type) -> np.ndarray:
    size = np.dtype(t).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(t).ravel()


def _packed(r: dict[str, np.ndarray], bucket: np.ndarray, kind: int, data: list[bytes] | None = None) -> list[dict]:
    """One row for each bucket, its records as arrays, and the bytes of their segments."""
    if not len(bucket):
        return []
    by = ("lo", "sub", "doc") if "sub" in r else ("bytes", "key")
    order = np.lexsort((*(r[k] for k in by if k in r), bucket))
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    out = []
    for part in np.split(order, cuts):
        row = {"bucket": int(bucket[part[0]]), "kind": kind}
        row |= {k: _planes(r[k][part].astype(t)) if k in r else b"" for k, t in _TYPES.items()}
        if data is not None:
            row["data"] = b"".join([data[i] for i in part])
        out.append(row)
    return out


def _unpacked(t: pa.Table, kind: int) -> dict[str, np.ndarray]:
    rows = t.filter(pa.compute.equal(t["kind"], kind))
    out = {}
    for k, t in _TYPES.items():
        parts = [_from_planes(x, t) for x in rows[k].to_pylist()]
        a = np.concatenate(parts) if parts else np.zeros(0, t)
        out[k] = a if t is np.uint64 else a.astype(np.int64)
    return out


def _table(rows: list[dict]) -> pa.Table:
    """Packed rows as a table of batches of about BATCH_BYTES."""
    batches, part, size = [], [], 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if size > BATCH_BYTES:
            batches.append(pa.RecordBatch.from_pylist(part, schema=_PACKED))
            part, size = [], 0
    if part:
        batches.append(pa.RecordBatch.from_pylist(part, schema=_PACKED))
    return pa.Table.from_batches(batches, _PACKED)


def _by_document(r: dict[str, np.ndarray], keep: np.ndarray, groups: int, kind: int, *names: str) -> list[dict]:
    part = {k: r[k][keep] for k in ("sub", "lo", "n", *names)}
    return _packed(part, np.mod(part["sub"], groups).astype(np.int32), kind)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(column.cast(pa.int64()), int(NO_ID))).astype(np.int64)


def _collections(keys: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of segments, sorted by anchor, of about COLLECTION_BYTES; an anchor's are never parted."""
    heads = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    at = 0
    while at < len(heads):
        end = max(at + 1, int(np.searchsorted(bounds[heads], bounds[heads[at]] + COLLECTION_BYTES)))
        yield int(heads[at]), int(heads[end]) if end < len(heads) else len(keys)
        at = end


def repeated_starts(data: np.ndarray, bounds: np.ndarray, r: dict[str, np.ndarray], length: int = LENGTH) -> np.ndarray:
    """For the starts of all segments in sequence: whether the string there is in another place first.

    A segment i is data[bounds[i]:bounds[i + 1]], stands at lo[i] of the document (doc[i],
    sub[i]) and has n[i] starts.
    """
    n = r["n"]
    begin = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), bool)
    for a, b in _collections(r["key"], bounds):
        own = bounds[a : b + 1] - bounds[a]
        place, same = suffix_order(data[bounds[a] : bounds[b]], own, n[a:b], length)
        group = np.cumsum(~same)
        several = np.zeros(len(same), bool)
        several[1:] = same[1:]
        several[:-1] |= same[1:]
        of = np.searchsorted(own, place, side="right") - 1
        start = place - own[of]
        keep = np.flatnonzero(several & (start < n[a:b][of]))
        of, start, group = of[keep] + a, start[keep], group[keep]
        order = np.lexsort((r["lo"][of] + start, r["sub"][of], r["doc"][of], group))
        later = np.zeros(len(order), bool)
        later[1:] = group[order][1:] == group[order][:-1]
        out[(begin[of] + start)[order][later]] = True
    return out


def find_repeats(documents: DataFrame, keyed: DataFrame, groups: int, rows: int, length: int = LENGTH) -> DataFrame:
    """Packed rows of kind REPEATS by group of documents: sub, first start, number of starts."""
    kmer = min(KMER, max(8, length // 16 * 8))
    common = documents.sparkSession.sparkContext.broadcast(common_slots(documents, rows, kmer))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict[str, np.ndarray]] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            whole = {k: np.concatenate([x.pop(k) for x in block]) for k in _RECORD}
            r, later = _first_of(whole, "key", "bytes")
            whole.clear()
            repeats = _by_document(r, later, groups, REPEATS)
            for x in repeats:  # by document group already: they pass through the next step
                x["bucket"] += groups
            first = {k: r.pop(k)[~later] for k in _RECORD}
            rows = _packed(first, (first["key"] % np.uint64(groups)).astype(np.int32), RECORDS)
            yield from _table(rows + repeats).to_batches()

        for whole in batches:
            for batch in pieces(whole, "text", SEGMENT_BYTES):
                data, offsets = flat(batch.column(2))
                ids, subs = _ids(batch.column(0)), np.asarray(batch.column(1))
                if len(data) > 2 * SEGMENT_BYTES:  # one long text
                    for begin in range(0, len(data), SEGMENT_BYTES):
                        a, b = max(0, begin - length), min(len(data), begin + SEGMENT_BYTES + 2 * length)
                        part = data[a:b]
                        block.append(anchor_runs(part, np.array([0, len(part)]), ids, a, begin - a, begin - a + SEGMENT_BYTES, length, kmer, subs, common.value))
                else:
                    block.append(anchor_runs(data, offsets, ids, length=length, kmer=kmer, subs=subs, common=common.value))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from emit()
                    block, size = [], 0
        if block:
            yield from emit()

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= groups:
            return t.set_column(0, "bucket", pa.array([bucket - groups] * t.num_rows, pa.int32()))
        r, later = _first_of(_unpacked(t, RECORDS), "key", "bytes")
        if not len(later):
            return _table([])
        new = np.concatenate([[True], r["key"][1:] != r["key"][:-1]])
        again = (np.bincount(np.cumsum(new) - 1) > 1)[np.cumsum(new) - 1]
        r, later = {k: v[again] for k, v in r.items()}, later[again]
        head = np.ones(len(later), bool)  # rows of one document that are equal count once
        head[1:] = (r["key"][1:] != r["key"][:-1]) | (r["bytes"][1:] != r["bytes"][:-1])
        return _table(_packed(r, np.full(len(later), bucket, np.int32), RECORDS) + _by_document(r, head, groups, WANTED, "key", "bytes"))

    def segments(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        r = _unpacked(marks, WANTED)
        if not len(r["sub"]) or not docs.num_rows:
            return _table([])
        order = np.argsort(r["sub"], kind="stable")
        r = {k: r[k][order] for k in ("key", "bytes", "sub", "lo", "n")}
        subs, row = np.unique(np.asarray(docs["sub"]), return_index=True)
        heads = np.concatenate([[0], np.flatnonzero(r["sub"][1:] != r["sub"][:-1]) + 1, [len(order)]])
        texts, data = docs["text"].combine_chunks(), []
        lo, end = r["lo"].tolist(), (r["lo"] + r["n"] - 1 + length).tolist()
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            text = texts[int(row[np.searchsorted(subs, r["sub"][a])])].as_py()
            data += [text[lo[i] : end[i]] for i in range(a, b)]
        return _table(_packed({k: r[k] for k in ("key", "bytes", "n")}, (r["key"] % np.uint64(groups)).astype(np.int32), SEGMENTS, data))

    def order(key: tuple, records: pa.Table, cut: pa.Table) -> pa.Table:
        g = _unpacked(cut, SEGMENTS)
        if not len(g["key"]):
            return _table([])
        r, later = _first_of(_unpacked(records, RECORDS), "key", "bytes")
        data = np.frombuffer(b"".join(cut["data"].to_pylist()), np.uint8)
        sizes = g["n"] - 1 + length
        by = np.lexsort((g["bytes"], g["key"]))
        bounds = np.concatenate([[0], np.cumsum(sizes[by])])
        data = data[np.repeat((np.cumsum(sizes) - sizes)[by] - bounds[:-1], sizes[by]) + np.arange(bounds[-1])]
        head = np.ones(len(later), bool)
        head[1:] = (r["key"][1:] != r["key"][:-1]) | (r["bytes"][1:] != r["bytes"][:-1])
        first = {k: v[head] for k, v in r.items()}
        if not (np.array_equal(first["key"], g["key"][by]) and np.array_equal(first["bytes"], g["bytes"][by])):
            raise ValueError("the segments cut from documents are not those whose records met")
        starts = repeated_starts(data, bounds, first, length)
        # runs of repeated starts within the first place of a segment; its other places are repeats
        n = first["n"]
        of, inside = np.repeat(np.arange(len(n)), n), np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
        begins = np.flatnonzero(starts & ((inside == 0) | ~np.concatenate([[False], starts[:-1]])))
        last = np.concatenate([~starts[1:] | (inside[1:] == 0), [True]])
        ends = np.flatnonzero(starts & last)
        runs = {"sub": first["sub"][of[begins]], "lo": first["lo"][of[begins]] + inside[begins], "n": ends - begins + 1}
        return _table(_by_document(r, later, groups, REPEATS) + _by_document(runs, np.ones(len(begins), bool), groups, REPEATS))

    plain = documents.select("doc_id", "sub", "text")
    found = written(plain.mapInArrow(tidied(anchors), _PACKED_DDL).groupBy("bucket").applyInArrow(meet, _PACKED_DDL), "repeats")
    wanted, records = (found.where(F.col("kind") == x).groupBy("bucket") for x in (WANTED, RECORDS))
    cut = keyed.groupBy("bucket").cogroup(wanted).applyInArrow(segments, _PACKED_DDL)
    ordered = records.cogroup(cut.groupBy("bucket")).applyInArrow(order, _PACKED_DDL)
    return found.where(F.col("kind") == REPEATS).unionByName(ordered)


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """``documents`` with the bytes of repeated strings removed from the text.

    Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of what
    remains); columns of these names are replaced, all others stay. With ``keep_text``
    the text is what remains, without bytes that are no whole character any more; else
    the text is left out.

    A byte goes if some string of ``length`` bytes that covers it starts earlier too: in a
    document with a smaller id, or earlier in the same one. Texts are judged as they come
    in. Null texts are empty; a null id counts as the largest. Rows with one id and
    different texts, or with null ids, are documents of their own, in the order of a hash;
    rows equal in id and text count as one, whose repeats are cut from each of them.
    Every row is kept.
    """
    fields = [f for f in documents.schema.fields if f.name not in (id_col, text_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"), *[F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(fields)])
    docs = docs.withColumn("sub", F.xxhash64("doc_id", "text"))
    total, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    groups = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES) | 1
    keyed = docs.withColumn("bucket", F.pmod("sub", F.lit(groups)).cast("int"))
    names = [f.name for f in fields]
    out_fields = [T.StructField(id_col, T.LongType()), *([T.StructField(text_col, T.StringType())] if keep_text else []), *fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def cut(key: tuple, t: pa.Table, marks: pa.Table) -> pa.Table:
        r = _unpacked(marks, REPEATS)
        order = np.argsort(r["sub"], kind="stable")
        sub, lo, n = (r[k][order] for k in ("sub", "lo", "n"))
        subs = np.asarray(t["sub"])
        left, right = np.searchsorted(sub, subs), np.searchsorted(sub, subs, side="right")
        out = {k: [] for k in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        texts = t["text"]
        for i in range(t.num_rows):
            data = texts[i].as_py()
            removed = spans = 0
            size = len(data)
            if left[i] < right[i]:
                a = lo[left[i] : right[i]]
                b = np.minimum(a + n[left[i] : right[i]] - 1 + length, size)
                a = np.minimum(a, size)
                edge = np.bincount(a, minlength=size + 1)[: size + 1] - np.bincount(b, minlength=size + 1)[: size + 1]
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (size > 0 and gone[0]))
                data = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out["kept_sha256"].append(hashlib.sha256(data).hexdigest())
            for k, v in (("n_bytes", size), ("n_removed", removed), ("n_spans", spans)):
                out[k].append(v)
            if keep_text:
                out["text"].append(data.decode("utf-8", "ignore"))
        cols = [t["doc_id"], *([pa.array(out["text"], pa.string())] if keep_text else []), *[t[f"_{i}"] for i in range(len(names))], *[pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string())]
        whole = pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[f.name for f in out_fields])
        return pa.Table.from_batches(whole.to_batches(max_chunksize=256), whole.schema)

    repeats = find_repeats(docs, keyed, groups, rows, length)
    return keyed.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(cut, T.StructType(out_fields))
