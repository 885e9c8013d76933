"""Language identification by interpolated Kneser-Ney character models.

One model per language over characters of letters and single blanks, order 4.  Letters
are numbered by the alphabet of what is learned from, any code point among them; letters
that were never seen share one number.  The n-grams of all languages stand in one sorted
array per order (an n-gram of four 16-bit numbers is its own 64-bit key), with a column of
log probabilities for each language, so that one binary search scores a character under
all languages.  A text goes to the language with the lowest cross-entropy per character;
a text whose cross-entropy lies beyond what the language's own texts show is marked as
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import pieces, tidied
from .quality import held_out
from .tables import small_side, written

ORDER = 4
DISCOUNT = 0.75
#: Learned from: at most so many rows of each language, those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 2000
#: A text is rejected beyond mean + REJECT standard deviations of its language's cross-entropy.
REJECT = 4.0

_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
_PARTS = [np.uint64(16 * i) for i in range(ORDER)]
#: Numbers of the blank and of letters that no learned text has; letters have the ones from 2 on.
BLANK, UNSEEN, MOST = 0, 1, 1 << 16


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, a zero after each, and the texts' offsets in them."""
    units = [x.lower().encode("utf-32-le", "surrogatepass") for x in texts]
    lengths = np.array([len(x) // 4 + 1 for x in units], np.int64)
    return np.frombuffer(b"\0\0\0\0".join(units) + b"\0\0\0\0", "<u4"), np.concatenate([[0], np.cumsum(lengths)])


def numbering(alphabet: np.ndarray) -> np.ndarray:
    """The number of every code point, for an alphabet (the letters beyond 65,534, if there are so many, are unseen)."""
    out = np.full(0x110000, UNSEEN, np.uint16)
    out[~_LETTER] = BLANK
    out[alphabet[: MOST - 2]] = np.arange(2, 2 + min(len(alphabet), MOST - 2))
    return out


def characters(texts: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters (letters in lower case, one blank after each word) as 4-gram keys
    that end in each character, and the offsets of the texts. Blanks stand before a text."""
    u, bounds = _points(texts)
    number = numbers[u]
    letter = number != BLANK
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~letter[1:]
    offsets = np.concatenate([[0], np.cumsum(keep)])[bounds]
    s = number[keep].astype(np.uint64)
    at = np.arange(len(s)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = s.copy()
    for i in range(1, ORDER):
        before = np.zeros(len(s), np.uint64)
        before[i:] = s[:-i]
        before[at < i] = BLANK
        key |= before << _PARTS[i]
    return key, offsets


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << 16 * order) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class Model:
    """Interpolated Kneser-Ney models of several languages over shared sorted arrays."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], counts: list[np.ndarray], alphabet: np.ndarray):
        self.languages = languages
        self.numbers = numbering(alphabet)
        self.limits: np.ndarray = np.full(len(languages), np.inf)
        n = len(languages)
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        if not n:
            return
        seen = [(g, c) for g, c in zip(grams, counts, strict=True)]
        levels = [seen]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
            levels.insert(0, [np.unique(_suffix(g, order), return_counts=True) for g, _ in levels[0]])
        lower, lower_keys = None, None
        for order, level in enumerate(levels, 1):
            keys = np.unique(np.concatenate([g for g, _ in level]))
            contexts, of = np.unique(keys >> np.uint64(16), return_inverse=True)
            p, rest = np.zeros((len(keys), n)), np.ones((len(contexts), n))
            for i, (g, c) in enumerate(level):
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, g)] = c
                total = np.bincount(of, count, len(contexts))
                kinds = np.bincount(of, count > 0, len(contexts))
                rest[:, i] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                p[:, i] = np.maximum(count - DISCOUNT, 0) / np.maximum(total[of], 1)
            if order == 1:
                self.unknown = rest[0] / (len(keys) + 1)  # one more than the characters seen: all others together
                p += self.unknown
            else:
                p += rest[of] * lower[np.searchsorted(lower_keys, _suffix(keys, order - 1))]
            lower, lower_keys = p, keys
            self.keys.append(keys)
            self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(contexts)
            self.backoff.append(np.log(rest).astype(np.float32))
        self.unknown = np.log(self.unknown).astype(np.float32)

    def _log(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of the last character, one column a language."""
        if order == 0:
            return np.broadcast_to(self.unknown, (len(keys), len(self.languages)))
        at, hit = _find(self.keys[order - 1], keys)
        out = self.logp[order - 1][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            k = keys[miss]
            below = self._log(_suffix(k, order - 1), order - 1).copy()
            if order > 1:
                c, known = _find(self.contexts[order - 1], k >> np.uint64(16))
                below += np.where(known[:, None], self.backoff[order - 1][c], 0)
            out[miss] = below
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its posterior, its cross-entropy and whether it is rejected, by text."""
        n = len(self.languages)
        keys, offsets = characters([x or "" for x in texts], self.numbers)
        sums = np.zeros((len(texts), n))
        sizes = np.diff(offsets)
        some = np.flatnonzero(sizes)
        if len(some) and n:
            sums[some] = np.add.reduceat(self._log(keys, ORDER).astype(np.float64), offsets[:-1][some], axis=0)
        entropy = -sums / np.maximum(1, sizes)[:, None]
        best = entropy.argmin(1) if n else np.zeros(len(texts), np.int64)
        rows = np.arange(len(texts))
        score, least = np.zeros(len(texts)), np.zeros(len(texts))
        if n:
            score = 1 / np.exp(np.minimum(700, sums - sums[rows, best][:, None])).sum(1)
            least = entropy[rows, best]
        names = [self.languages[b] if n and (size or any(c.isalpha() for c in x or "")) else "und" for b, size, x in zip(best, sizes, texts, strict=True)]
        over = np.maximum(0, least - self.limits[best]) if n else np.zeros(len(texts))
        nothing = np.array([x == "und" for x in names], bool)
        score = np.where(nothing, 0.0, np.clip(score * np.exp(-over), 0, 1))
        return names, score, least, (over > 0) | nothing


def _texts(batch: pa.RecordBatch, column: int) -> list[str | None]:
    return pc.cast(batch.column(column), pa.large_string()).to_pylist()


def fit(documents: DataFrame, *, sample_per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a bounded sample of the rows with a language that are not held out.

    The sample is drawn by hash: a threshold for each language that lets about twice as many
    rows pass, then the smallest hashes of those. Every tenth row of it is left out of the
    counts and calibrates the rejection: a limit is as many deviations above the mean
    cross-entropy of the language's own left-out texts. A language with fewer than ten rows
    has no limit. n-grams are counted and summed by Spark, and all of the others' are kept.
    """
    usable = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    ids = usable.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), F.col(lang_col).alias("lang"))
    share = small_side(written(ids.groupBy("lang").agg((F.lit(2.0 * sample_per_language) / F.count("*")).alias("share")), "languages"))
    ids = ids.join(share, "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= sample_per_language)
    ids = small_side(written(ids.groupBy(F.col("id").alias("__id")).agg(F.bool_and(F.col("r") % 10 == 0).alias("__out")), "sample"))
    drawn = usable.join(ids, usable[id_col] == ids["__id"]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), "__out")
    sample, left_out = drawn.where("NOT __out").drop("__out"), drawn.where("__out")

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, bool)
        for whole in batches:
            for batch in pieces(whole, "text"):
                seen[_points(_texts(batch, 1))[0]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen & _LETTER).astype(np.int32))], ["letter"])

    seen = sample.mapInArrow(tidied(letters), "letter int").groupBy("letter").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "letter").collect()
    alphabet = np.array([r["letter"] for r in seen], np.int64)
    numbers = documents.sparkSession.sparkContext.broadcast(numbering(alphabet))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                langs, texts = batch.column(0).to_pylist(), _texts(batch, 1)
                for lang in dict.fromkeys(langs):
                    keys, counts = np.unique(characters([t for x, t in zip(langs, texts, strict=True) if x == lang], numbers.value)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    kept = sample.mapInArrow(tidied(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(kept["lang"].unique())
    by = [kept[kept["lang"] == x] for x in languages]
    order = [np.argsort(x["gram"].to_numpy().view(np.uint64)) for x in by]
    model = Model(languages, [x["gram"].to_numpy().view(np.uint64)[o] for x, o in zip(by, order, strict=True)], [x["n"].to_numpy()[o] for x, o in zip(by, order, strict=True)], alphabet)
    if languages:
        own = _scored(left_out.select(F.col("lang").alias("own"), F.lit(False).alias("held_out"), "text"), "string", model).where("doc_id = lang_pred").groupBy("doc_id").agg(F.avg("entropy").alias("m"), F.coalesce(F.stddev_pop("entropy"), F.lit(0.0)).alias("s")).collect()
        for r in own:
            model.limits[languages.index(r["doc_id"])] = r["m"] + REJECT * r["s"]
    return model


def _scored(source: DataFrame, id_type: str, model: Model) -> DataFrame:
    shipped = source.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                names, score, entropy, rejected = shipped.value.score(_texts(batch, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "entropy", "rejected"])

    return source.mapInArrow(tidied(run), f"doc_id {id_type}, held_out boolean, lang_pred string, score double, entropy double, rejected boolean")


def identify(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every row, from whole texts.

    A null text, or one without any letter, is ``und`` with score 0. Ties go to the first
    language in order of name. Without a learned language everything is ``und``. Every row
    is kept, repeated ones too; other columns are ignored.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return _scored(source, source.schema[0].dataType.simpleString(), model)
