"""Similarity joins of token sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .similarity import FEW_GROUPS, GRID, _small_batches

#: Tokens of a pack of sets, about.
PACK_TOKENS = 300_000
#: Common tokens of a pair of packs, and tokens of candidates, that a task looks at together; places of its table of tokens.
TOGETHER, FLAGS = 1 << 19, 8 << 20
#: Members of a class in one row, about; rows of the result that a task makes, about, as long as tasks are no more than TASKS.
SLICE, TASK_ROWS, TASKS = 512, 500_000, 5000


class _Sets:
    """A pack's sets: keys and sizes, and of each token of ``known`` its row, the tokens of its set
    from it on, and its place in ``known``."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, known: np.ndarray):
        self.keys, self.sizes = keys, sizes
        found = np.searchsorted(known, tokens)
        hit = np.flatnonzero(known[np.minimum(found, len(known) - 1)] == tokens)
        self.row = np.repeat(np.arange(len(keys)), sizes)[hit]
        self.rest = np.cumsum(sizes)[self.row] - hit
        self.token = found[hit]
        self.starts = np.searchsorted(self.row, np.arange(len(keys) + 1))


def _of_pack(pack: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, sets = pack.values.field(0), pack.values.field(1)
    return np.asarray(keys), np.asarray(sets.value_lengths()).astype(np.int64), np.asarray(sets.flatten())


def _each(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all runs that begin at ``starts``, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _runs(counts: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Consecutive parts of ``counts`` of about ``most`` together and at most ``rows`` long."""
    ends, low = np.cumsum(counts), 0
    while low < len(counts):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right"))
        high = min(max(high, low + 1), low + rows)
        yield low, high
        low = high


def _similar(one: tuple, two: tuple, same: bool, least: float, shared: int) -> Iterator[list[np.ndarray]]:
    """Keys, common tokens and similarity of the sets of two packs that are similar enough."""
    known = np.intersect1d(one[2], two[2])
    if not len(known):
        return
    a, b = _Sets(*one, known), _Sets(*two, known)
    # from their first common token on, both sets have as many tokens as must be common, a share of both sizes
    share, width = least / (1 + least), max(a.sizes.max(), b.sizes.max()) + 2
    places = b.token * width + b.sizes[b.row]
    theirs = np.argsort(places)
    places, spare = places[theirs], b.rest[theirs] - share * b.sizes[b.row[theirs]] + 1e-9
    mine = np.flatnonzero(a.rest >= np.maximum(shared, a.sizes[a.row] * least - 1e-9))
    size = a.sizes[a.row[mine]]
    largest = np.minimum(a.rest[mine] / max(share, 1e-9) - size + 1e-6, width - 1).astype(np.int64)
    first = np.searchsorted(places, a.token[mine] * width + np.ceil(least * size - 1e-6).astype(np.int64))
    counts = np.maximum(np.searchsorted(places, a.token[mine] * width + largest, side="right") - first, 0)
    bounds = np.searchsorted(a.row[mine], np.arange(len(a.keys) + 1))
    totals = np.concatenate([[0], np.cumsum(counts)])[bounds]
    for low, high in _runs(np.diff(totals), TOGETHER, max(1, FLAGS // len(known))):
        here = slice(bounds[low], bounds[high])
        there = _each(first[here], counts[here])
        enough = spare[there] >= np.repeat(share * size[here], counts[here])
        row, column = np.repeat(a.row[mine[here]], counts[here])[enough], b.row[theirs[there[enough]]]
        row, column = np.divmod(np.unique(row * len(b.keys) + column), len(b.keys))
        if same:
            row, column = row[row < column], column[row < column]
        table = np.zeros((high - low) * len(known), np.bool_)
        own = slice(a.starts[low], a.starts[high])
        table[(a.row[own] - low) * len(known) + a.token[own]] = True
        lengths = b.starts[column + 1] - b.starts[column]
        for i, j in _runs(lengths, TOGETHER, TOGETHER):
            n, x, y = lengths[i:j], row[i:j], column[i:j]
            common = table[np.repeat((x - low) * len(known), n) + b.token[_each(b.starts[y], n)]]
            count = np.add.reduceat(common, np.cumsum(n) - n, dtype=np.int32)
            jaccard = count / (a.sizes[x] + b.sizes[y] - count)
            good = (count >= shared) & (jaccard >= least)
            yield [a.keys[x[good]], b.keys[y[good]], count[good], jaccard[good]]


def _similar_classes(ranked: DataFrame, least: float, shared: int) -> DataFrame:
    """c, d, shared, jaccard: pairs of the classes of one group (g) whose sets of numbers (s), by
    frequency, are similar enough.

    Classes meet as packs, which are copied for GRID cells at most, and a candidate is checked
    where it is found, so what is shuffled doesn't grow with the candidates.
    """
    _small_batches(ranked.sparkSession)
    parts = ranked.groupBy("g").agg(F.ceil(F.sum(F.size("s")) / PACK_TOKENS).cast("int").alias("parts"))
    # dealt out by pack, as a hot group's sets don't fit one task
    cut = ranked.join(F.broadcast(parts) if parts.count() <= FEW_GROUPS else parts, "g").select("g", F.pmod(F.xxhash64("c"), "parts").cast("int").alias("part"), "c", "s").repartition("g", "part")
    cut = cut.groupBy("g", "part").agg(F.collect_list(F.struct("c", "s")).alias("sets"))
    packs = written(cut, "packs")
    cells = min(GRID, 1 + (packs.agg(F.max("part")).first()[0] or 0))
    # two packs meet in the cell of their smaller and their larger remainder
    left = packs.withColumn("x", F.col("part") % cells).withColumn("y", F.explode(F.sequence("x", F.lit(cells - 1))))
    right = packs.select("g", F.col("part").alias("part2"), F.col("sets").alias("sets2"), (F.col("part") % cells).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), "y")))
    pairs = left.join(right, ["g", "x", "y"]).where("x < y OR part <= part2").select("sets", "sets2", (F.col("part") == F.col("part2")).alias("same"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two, same = batch.column(0)[i], batch.column(1)[i], batch.column(2)[i].as_py()
                for rows in _similar(_of_pack(one), _of_pack(two), same, least, shared):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["c", "d", "shared", "jaccard"])

    return pairs.mapInArrow(meet, "c long, d long, shared int, jaccard double")


def similar_token_sets(sets: DataFrame, id_col: str, group: str, tokens: str, *, least: float, shared: int = 1) -> DataFrame:
    """a, b (a < b), shared, jaccard: pairs of rows of one group whose token sets have at least
    ``least`` Jaccard similarity and ``shared`` common tokens.

    Rows with one set are a class, and classes meet: copies become pairs in the result only.
    Two sets that are so similar have a first common token, in order of frequency, with enough
    tokens after it in both, so rows meet by these only, and a frequent token pairs nobody by
    itself. Members of classes meet as lists, and the result's rows are made in the tasks that
    return them, so shuffles don't grow with the result's copies. Sets and their numbered forms
    are written to the shared folder, as they are read several times. Ids are unique; rows
    without tokens, or with a null group, meet nobody.
    """
    t = written(sets.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.array_sort(tokens).alias("t")).where((F.size("t") >= shared) & (F.size("t") > 0) & F.col("g").isNotNull()), "sets")
    named = t.select("id", "g", F.sha2(F.array_join("t", "\x00"), 256).alias("set"))
    classes = written(t.groupBy("g", F.sha2(F.array_join("t", "\x00"), 256).alias("set")).agg(F.any_value("t").alias("t"), F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()), "classes")
    each = classes.select("c", "g", F.explode("t").alias("w"))
    # numbers in order of frequency
    words = written(each.groupBy("g", "w").agg(F.count("*").alias("df")).orderBy("df", "g", "w").select("g", "w", F.monotonically_increasing_id().alias("k")), "words")
    ranked = written(each.join(words, ["g", "w"]).groupBy("c", "g").agg(F.array_sort(F.collect_list("k")).alias("s")), "ranked")
    own = classes.select("c", F.col("c").alias("d"), F.size("t").alias("shared"), F.lit(1.0).alias("jaccard")).where(F.lit(1.0) >= least)
    linked = written(_similar_classes(ranked, least, shared).unionByName(own), "linked")

    slices = lambda n: F.ceil(F.col(n) / SLICE).cast("int")
    members = named.join(classes.select("g", "set", "c", "n"), ["g", "set"])
    lists = written(members.groupBy("c", F.pmod(F.xxhash64("id"), slices("n")).cast("int").alias("part")).agg(F.collect_list("id").alias("ids")), "lists")
    counted = linked.join(classes.select("c", "n"), "c").join(classes.select(F.col("c").alias("d"), F.col("n").alias("n2")), "d")
    rows = counted.agg(F.sum(F.col("n") * F.col("n2"))).first()[0] or 0
    every = lambda n: F.explode(F.sequence(F.lit(0), slices(n) - 1))
    met = counted.withColumn("part", every("n")).withColumn("part2", every("n2")).where("c <> d OR part <= part2")
    both = met.join(lists, ["c", "part"]).join(lists.select(F.col("c").alias("d"), F.col("part").alias("part2"), F.col("ids").alias("ids2")), ["d", "part2"])
    dealt = both.repartition(min(math.ceil(rows / TASK_ROWS), TASKS) or 1, "c", "d", "part", "part2")
    pairs = dealt.withColumn("i", F.explode("ids")).withColumn("j", F.explode("ids2")).where("c <> d OR part <> part2 OR i < j")
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "shared", "jaccard")
