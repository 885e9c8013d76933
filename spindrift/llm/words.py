"""Words of texts as DataFrame expressions: runs of ASCII letters, digits and non-ASCII characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators one by one: Java's engine then tests a character by one table look-up.
WORD = "[^" + "".join(rf"\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """The words in order, as they stand in ``text``."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def text_key(text: Column) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(text)
