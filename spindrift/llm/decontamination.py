"""Benchmark decontamination by winnowing, with DataFrame operations only.

A text's fingerprints are the minimum k-gram hash of each window of consecutive k-grams.
Two texts that share a span of ``WINDOW`` words share at least one fingerprint, so the
join of training and test fingerprints misses none.  A document's fingerprint that a test
item has too is a seed.  A seed is extended to the windows around it, which are compared
with the distinct windows of the items, words and all; what items a window stands in is
asked only for windows that were found.

So a document's rows never meet the items one by one: seeds, candidate windows and hits
each grow with the document alone, also where words repeat without end or thousands of
items share a phrase.  Documents are read once for fingerprints and word counts; texts are
shuffled, and cut into words again, only for documents with a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written
from .words import ascii_lower, text_key, words

WINDOW = 13
#: Words of a k-gram. Windows of WINDOW - GRAM + 1 k-grams give the guarantee.
GRAM = 6
#: The low bits of a fingerprint hold its position, the others the hash.
_POSITION_BITS = 30
_LENGTH_BITS = 24


def fingerprints(w: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """The distinct window minima of a word array: hash and position packed in one long each,
    ties to the leftmost; empty for fewer words than ``window``."""
    mask = F.lit(~((1 << _POSITION_BITS) - 1))
    packed = F.transform(F.sequence(F.lit(0), F.size(w) - gram), lambda i: F.xxhash64(F.slice(w, i + 1, gram)).bitwiseAND(mask).bitwiseOR(i.cast("long")))
    span = window - gram + 1

    def minima(grams: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - span + 1), lambda i: F.array_min(F.slice(grams, i, span))))

    # transform over a one-element array evaluates the packed grams once
    return F.when(F.size(w) >= window, F.transform(F.array(packed), minima)[0]).otherwise(F.array().cast("array<long>"))


def _loose(text: Column) -> Column:
    """For finding candidates only: all letters to lower case. It never merges or splits words."""
    return F.lower(F.coalesce(text, F.lit("")))


def _scan(df: DataFrame, *keys: str, window: int, gram: int) -> DataFrame:
    """``keys``, n_words and the fingerprints f of each text."""
    return df.select(*keys, words(_loose(F.col("text"))).alias("w")).select(*keys, F.size("w").cast("long").alias("n_words"), fingerprints(F.col("w"), window, gram).alias("f"))


def _prints(scanned: DataFrame, *keys: str) -> DataFrame:
    # outer: without it the optimizer adds a filter on the array and evaluates it twice
    each = scanned.select(*keys, F.explode_outer("f").alias("f")).where(F.col("f").isNotNull())
    return each.select(*keys, F.shiftright("f", _POSITION_BITS).alias("hash"), F.col("f").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int").alias("at"))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, length, words: every window of an item once."""
    w = items.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(window), F.size("w"))
    each = w.select("item_id", size.alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda s: F.array_join(F.slice("w", s, size), " "))).alias("words"))
    return each.distinct()


def _candidates(scanned: DataFrame, documents: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, key, at, length: where a window of so many words may begin; for ``length`` of
    ``window`` words, the place of a seed that the window holds instead."""
    test = _prints(_scan(items, window=window, gram=gram)).select("hash").distinct()
    seeds = _prints(scanned, "doc_id", "key").join(test, "hash", "left_semi").select("doc_id", "key", "at", F.lit(window).alias("length"))
    # an item of fewer words is one window: it may begin wherever its first word stands
    short = items.select(words(_loose(F.col("text"))).alias("w")).where((F.size("w") > 0) & (F.size("w") < window)).select(F.col("w")[0].alias("word"), F.size("w").alias("length")).distinct()
    if short.isEmpty():  # items are few and small beside the documents
        return seeds
    each = documents.select("doc_id", "key", F.posexplode_outer(words(_loose(F.col("text")))).alias("at", "word"))
    return seeds.unionByName(each.join(short, "word").select("doc_id", "key", "at", "length"))


def _found(scanned: DataFrame, documents: DataFrame, items: DataFrame, test: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, key, start, length, words: every place in a document where a window of ``test`` stands."""
    span = window - gram + 1
    per_doc = _candidates(scanned, documents, items, window, gram).groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "length")).alias("c")).withColumnsRenamed({"doc_id": "d", "key": "k"})
    texts = documents.join(per_doc, documents["doc_id"].eqNullSafe(per_doc["d"]) & (documents["key"] == per_doc["k"])).select("doc_id", "key", words(ascii_lower(F.col("text"))).alias("w"), "c")

    def around(c: Column) -> Column:
        first = F.when(c["length"] == window, F.greatest(F.lit(0), c["at"] - span + 1)).otherwise(c["at"])
        return F.transform(F.sequence(first, c["at"]), lambda s: F.shiftleft(s.cast("long"), _LENGTH_BITS) + c["length"])

    # start and length in one long: Spark finds distinct numbers by hash, distinct structs pair by pair
    start, length = (lambda x: F.shiftright(x, _LENGTH_BITS).cast("int")), (lambda x: x.bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1)).cast("int"))
    places = F.array_distinct(F.flatten(F.transform("c", around)))
    inside = F.filter(places, lambda x: start(x) + length(x) <= F.size("w"))
    found = F.transform(inside, lambda x: F.struct(start(x).alias("start"), length(x).alias("length"), F.array_join(F.slice("w", start(x) + 1, length(x)), " ").alias("words")))
    each = texts.select("doc_id", "key", F.explode_outer(found).alias("x"))
    return each.select("doc_id", "key", "x.*").join(test.select("length", "words").distinct(), ["length", "words"], "left_semi").select("doc_id", "key", "start", "length", "words")


def find_hits(documents: DataFrame, items: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, key, item_id, start, length: every window of an item in a document, exactly.

    ``documents`` has doc_id, text and a ``key`` of the text (``text_key``), ``items`` item_id and text.
    """
    test = _windows(items, window)
    hits = _found(_scan(documents, "doc_id", "key", window=window, gram=gram), documents, items, test, window, gram)
    return hits.join(test, ["length", "words"]).select("doc_id", "key", "item_id", "start", "length").distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document.

    A window is ``window`` consecutive words of an item, or a whole shorter item of at
    least one word. Null texts have no words. Without hits: n_hit and n_items are 0 and
    the digest is that of an empty string. Every row is kept, repeated ones too (rows with
    one id and different texts are told apart); other columns are ignored. Items with a
    null id have windows but add nothing to n_items and the digest. Very long texts, and
    texts of one word over and over, take time in proportion to their length.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", text_key(F.col("text")))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    scanned = written(_scan(docs, "doc_id", "key", window=window, gram=gram), "fingerprints")
    test = written(_windows(items, window), "windows")
    hits = written(_found(scanned, docs, items, test, window, gram).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("places"), F.collect_set(F.struct("length", "words")).alias("windows")), "hits")
    # places in order: each adds the words beyond the furthest end so far
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["start"] + x["length"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(s["end"], x["start"]))).alias("n"))
    covered = hits.select("doc_id", "key", F.aggregate("places", state, step)["n"].alias("n_hit"))
    each = hits.select("doc_id", "key", F.explode("windows").alias("x")).select("doc_id", "key", "x.*").join(test.where(F.col("item_id").isNotNull()), ["length", "words"])
    named = each.select("doc_id", "key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    marked = covered.withColumnsRenamed({"doc_id": "d", "key": "k"}).join(named.withColumnsRenamed({"doc_id": "d2", "key": "k2"}), F.expr("d <=> d2 AND k = k2"), "left")
    out = scanned.select("doc_id", "key", "n_words").join(marked, F.expr("doc_id <=> d AND key = k"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
