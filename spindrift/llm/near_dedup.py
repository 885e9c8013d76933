"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's shingles are hashed once; its sketch is the k smallest hashes.  Documents
with equal sets become one class.  Inverted lists of the sketches' values give overlaps:
each class is listed under its rarest values only, as two sets that are similar enough
share more of their sketches than the rest could hold.  A list first compares all its
classes with one of them; what is then still in different components is compared pair by
pair, after a second pass with exact prefixes over whole sets where a list is long.  The
k smallest values of two sketches estimate a pair's similarity and drop what is far off
(not after exact prefixes, whose counts alone decide);
the sets themselves decide.

No list is cut: only the order of comparing saves pairs, as classes already in one
component need no further link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import linked_components
from .arrays import BYTE_VALUES, LOWER, SPACE, RangeHash, flat, int64, mix, pieces, tidied, word_bounds
from .tables import small_side, written

SHINGLE = 5
#: Similarity at least NUMERATOR / 100.
NUMERATOR = 75
#: Values in a sketch.
K = 48
#: Two similar sketches of K share this many values but for a chance of about 8.4e-9, and so
#: does the sketch of their union.
SHARED = 18
#: Smallest list values that a class carries to tell in which list a pair is made.
MARKS = 16
#: Lists up to this length are compared pair by pair, longer ones by the exact second pass.
SHORT_LIST = 24


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 63-bit shingle hashes of each text in ascending order, and their offsets."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets, SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    words = RangeHash(RangeHash(BYTE_VALUES[LOWER[data]]).of(starts, ends))
    counts = np.diff(first)
    shingles = np.where(counts > 0, np.maximum(1, counts - size + 1), 0)
    of = np.repeat(np.arange(n), shingles)
    begin = first[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    h = words.of(begin, np.minimum(begin + size, first[1:][of])) >> np.uint64(1)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.searchsorted(of[new], np.arange(n + 1))


def _lists(values: np.ndarray, offsets: np.ndarray, most: int) -> pa.Array:
    """The first ``most`` values of each row as an Arrow list column."""
    sizes = np.minimum(np.diff(offsets), most)
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[:-1] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), int64(values[at]))


def sketches(documents: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """doc_id, n (set size), f1, f2 (128 bits that stand for the set), sketch (k smallest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                h, offsets = shingle_sets(batch.column(1), size)
                total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (mix(h), mix(h * np.uint64(0x2545F4914F6CDD1D)))]
                f1, f2 = (t[offsets[1:]] - t[offsets[:-1]] for t in total)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), int64(f1), int64(f2), _lists(h, offsets, k)], ["doc_id", "n", "f1", "f2", "sketch"])

    return documents.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, n long, f1 long, f2 long, sketch array<long>")


def _prefix(values: DataFrame, length: F.Column, total: F.Column) -> DataFrame:
    """value, rep, n, u: each class under its rarest values, ``length`` of ``total`` if all were
    shared; values that no other class has come first and need no list. ``u`` counts
    such values: the fewer of its n, the more central the class."""
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    per = values.join(shared, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("s"))
    take = length - (total - F.size("s"))
    alone = (total - F.size("s")).cast("long")
    return per.where(take > 0).select("rep", "n", alone.alias("u"), F.explode(F.slice("s", 1, take)).alias("x")).select(F.col("x.value").alias("value"), "rep", "n", "u")


def _close(n_a: F.Column, n_b: F.Column) -> F.Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * NUMERATOR


def _centres(lists: DataFrame) -> DataFrame:
    """value, b, n_b: the most central class of each list."""
    centre = lists.groupBy("value").agg(F.min(F.struct(F.round(F.col("u") / F.col("n"), 3), "rep", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    return centre.select("value", F.col("c.rep").alias("b"), F.col("c.n").alias("n_b"))


def _star_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of the classes of each list with its most central one."""
    return lists.join(_centres(lists), "value").where((F.col("rep") != F.col("b")) & _close(F.col("n"), F.col("n_b"))).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def _open_lists(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists with classes of several components: value, rep, n, u, comp, size."""
    marked = lists.drop("comp").join(nodes, lists["rep"] == nodes["node"], "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
    several = marked.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("value", "size")
    return marked.join(several, "value")


def _placed(lists: DataFrame, measured: DataFrame) -> DataFrame:
    """Lists with each class's place relative to the list's centre: size (of the centre),
    missing (of the centre's values), extra (others that some class shares); null if unknown."""
    near = measured.select(F.col("a").alias("r"), F.col("b").alias("c"), "shared").unionByName(measured.select(F.col("b").alias("r"), F.col("a").alias("c"), "shared"))
    at = lists.join(_centres(lists).withColumnsRenamed({"b": "centre", "n_b": "size_c"}), "value", "left").join(near, (F.col("rep") == F.col("r")) & (F.col("centre") == F.col("c")), "left")
    shared = F.when(F.col("rep") == F.col("centre"), F.col("n")).otherwise(F.col("shared"))
    return at.select("value", "rep", "n", "u", "size_c", (F.col("size_c") - shared).alias("missing"), F.greatest(F.lit(0), F.col("n") - shared - F.col("u")).alias("extra"))


def _all_pairs(lists: DataFrame, exact: bool = False) -> DataFrame:
    """Pairs of classes of different components within each list.

    With ``exact`` counts, pairs are left out that can't share enough: values that no other
    class has aren't shared, nor are those of the list's centre that either class misses.
    """
    names = ("rep", "n", "u", "comp", "marks") + (("missing", "extra") if exact else ())
    # a pair that meets in several lists is made in the one with the smallest value, if that is a mark of both
    lists = lists.join(lists.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("value")), 1, MARKS).alias("marks")), "rep")
    first = F.coalesce(F.array_min(F.array_intersect("marks", "marks_b")), F.col("value")) == F.col("value")
    other = lists.select("value", *[F.col(c).alias(f"{c}_b") for c in names])
    can = _close(F.col("n"), F.col("n_b"))
    if exact:
        most = F.least(F.col("n") - F.col("u"), F.col("n_b") - F.col("u_b"))
        by_centre = F.col("size_c") - F.greatest("missing", "missing_b") + F.least("extra", "extra_b")
        by_centre = F.when(F.col("missing").isNotNull() & F.col("missing_b").isNotNull(), by_centre).otherwise(most)
        can = can & (F.least(most, by_centre) * (100 + NUMERATOR) >= (F.col("n") + F.col("n_b")) * NUMERATOR)
    return lists.join(other, "value").where((F.col("rep") < F.col("rep_b")) & (F.col("comp") != F.col("comp_b")) & can & first).select(F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Pairs whose union sketch doesn't rule the similarity out."""
    s = classes.select("rep", "sketch")
    both = pairs.join(s.withColumnsRenamed({"rep": "a", "sketch": "x"}), "a").join(s.withColumnsRenamed({"rep": "b", "sketch": "y"}), "b")
    least = SHARED / K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.asarray(x[i].values), np.asarray(y[i].values)
                both = np.sort(np.concatenate([p, q]))
                twice = both[1:] == both[:-1]
                union = both[np.concatenate([[True], ~twice])]
                edge = union[k - 1] if len(union) >= k else union[-1]
                keep[i] = np.count_nonzero(both[1:][twice] <= edge) >= least * min(k, len(union))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, shared for pairs, from whole sets."""
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"rep": "b", "set": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                out[i, :2] = len(p), len(q)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                out[i, 2] = np.count_nonzero(q[at] == p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(out[:, c])) for c in range(3)]], ["a", "b", "n_a", "n_b", "shared"])

    return both.select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long, n_a long, n_b long, shared long")


def _linked(measured: DataFrame) -> DataFrame:
    return measured.where(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * NUMERATOR).select("a", "b")


def _sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """rep, set (ascending 64-bit values) of the wanted documents."""
    wanted = small_side(wanted)
    texts = documents.join(wanted, documents["doc_id"] == wanted["rep"]).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                h, offsets = shingle_sets(batch.column(1), size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["rep", "set"])

    return written(texts.mapInArrow(tidied(run), "rep long, set binary"), "sets")


def _set_values(sets: DataFrame) -> DataFrame:
    """value, rep, n for every member of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "set"):
                data, offsets = flat(batch.column(1))
                n = np.diff(offsets) // 8
                yield pa.RecordBatch.from_arrays([pa.array(data.view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), n)), pa.array(np.repeat(n, n))], ["value", "rep", "n"])

    return sets.mapInArrow(tidied(run), "value long, rep long, n long").distinct()


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Words are runs of anything but white space, A-Z in lower case; a set holds the distinct
    shingles of ``size`` words, or a shorter text's whole sequence as one. Texts without
    words, null ones too, have empty sets and are linked with nothing. Linked are documents
    with 100 * shared >= 75 * united shingles; component_id is the smallest id reachable.
    Every row is kept, repeated ones too; rows with one id count as one document when
    links are followed. A null id is linked with nothing and kept. Other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = written(sketches(docs, k, size), "sketches")
    usable = sketched.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(usable.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    whole = int(k * NUMERATOR / 100)  # a set up to this size meets only sets that their sketches hold whole
    needed = F.when(F.col("n") <= whole, F.ceil(F.col("n") * NUMERATOR / 100)).otherwise(F.lit(SHARED * k // K)).cast("int")
    total = F.least("n", F.lit(k)).cast("int")
    values = classes.select(F.explode_outer("sketch").alias("value"), "rep", "n")
    lists = written(_prefix(values, total - needed + 1, total), "lists")
    sets = _sets(docs, lists.select("rep").distinct(), size)

    def measured(pairs: DataFrame) -> DataFrame:
        return written(_measured(written(pairs, "pairs"), sets), "measured")

    links = _linked(measured(_estimated(_star_pairs(lists), classes, k)))
    nodes = written(linked_components(links), "nodes")
    left = written(_open_lists(lists, nodes), "open")
    links = links.unionByName(_linked(measured(_estimated(_all_pairs(left.where(F.col("size") <= SHORT_LIST)), classes, k))))
    long = left.where(F.col("size") > SHORT_LIST).select("rep").distinct()
    if not long.isEmpty():
        exact = _prefix(_set_values(sets.join(long, "rep", "left_semi")), F.col("n").cast("int") - F.ceil(F.col("n") * NUMERATOR / 100).cast("int") + 1, F.col("n").cast("int"))
        exact = written(exact, "lists")
        star = measured(_star_pairs(exact))
        links = links.unionByName(_linked(star))
        nodes = written(linked_components(links), "nodes")
        rest = written(_open_lists(_placed(exact, star), nodes), "open")
        links = links.unionByName(_linked(measured(_all_pairs(rest, exact=True))))
    nodes = written(linked_components(links), "nodes")
    of_class = classes.join(nodes, classes["rep"] == nodes["node"], "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n", "f1", "f2").join(of_class, ["n", "f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
