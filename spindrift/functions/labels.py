"""Scopes and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The legal scopes with their paths, the legal categories and their aliases.
SCOPES = {"Tamil Nadu": "tamil-nadu", "India": "india", "World": "world"}
CATEGORIES = "politics economy crime courts tech health environment sports culture".split()
CATEGORY_ALIASES = {
    "science": "tech", "science_and_tech": "tech", "sci_tech": "tech", "law": "courts", "legal": "courts", "world": "politics",
    "foreign": "politics", "international": "politics", "diplomacy": "politics", "foreign_affairs": "politics",
}


def lookup(mapping: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), c)


def normalize_scope(c: Column) -> Column:
    """The legal name of a scope's alias; other names stay, stripped; empty is null."""
    plain = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" "))
    return F.when(plain.isin("tamil nadu", "tamilnadu"), "Tamil Nadu").when(plain == "india", "India").when(plain == "world", "World").otherwise(F.nullif(F.trim(c), F.lit("")))


def normalize_category(c: Column) -> Column:
    """A legal category by itself or by an alias, else null."""
    plain = F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")
    named = F.coalesce(lookup(CATEGORY_ALIASES, plain), plain)
    return F.when(named.isin(CATEGORIES), named)


def scope_path(label: Column) -> Column:
    return lookup(SCOPES, label)


def scope_label(path: Column) -> Column:
    return lookup({v: k for k, v in SCOPES.items()}, path)


def category_params(values: Column) -> Column:
    """Legal categories only, each once, in order."""
    return F.array_distinct(F.filter(values, lambda x: x.isin(CATEGORIES)))
