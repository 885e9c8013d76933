"""Address expressions: normal forms, name-based ids, publishers, image addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_", "fbclid", "gclid", "mc_cid", "mc_eid")
#: What the address of a wide image asks for.
IMAGE_WIDTH, IMAGE_AUTO, IMAGE_FIT = 1200, "auto=format%2Ccompress", "fit=max"
#: Publisher names and hosts with their rank as a source of images and their page id.
NAME_RANK = {"the hindu": 1, "hindu": 1, "the indian express": 3, "indian express": 3, "the new indian express": 3, "new indian express": 3, "the times of india": 2, "times of india": 2, "toi": 2}
HOST_RANK = (("indianexpress.com", 3), ("newindianexpress.com", 3), ("timesofindia.com", 2), ("indiatimes.com", 2), ("thehindu.com", 1))
PUBLISHER_OF_RANK = {1: "hindu", 2: "times-of-india", 3: "indian-express"}
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no query, fragment or closing slash."""
    return F.rtrim(F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), _part(url, 3)), F.lit("/"))


def canonical_url(url: Column) -> Column:
    """One form per article: https by default, lower-case scheme and host, no closing slash,
    no tracking parameters, the others sorted, no fragment. Null for an empty address."""
    full = F.trim(url)
    full = F.when(full == "", None).when(full.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), full).otherwise(F.concat(F.lit("https://"), full))
    path = F.coalesce(F.nullif(_part(full, 3), F.lit("")), F.lit("/"))
    path = F.when(path == "/", path).otherwise(F.rtrim(path, F.lit("/")))
    pairs = F.filter(F.split(F.substring(_part(full, 4), 2, 1 << 30), "&"), lambda x: x != "")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    both = F.transform(pairs, lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("k"), F.when(F.contains(x, F.lit("=")), decode(F.regexp_replace(x, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v")))
    tracks = lambda k: F.exists(F.array(*[F.lit(p) for p in TRACKING]), lambda p: F.startswith(F.lower(k), p))
    kept = F.array_sort(F.filter(both, lambda x: ~tracks(x["k"])))
    query = F.array_join(F.transform(kept, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    return F.concat(F.lower(_part(full, 1)), F.lit("://"), F.lower(_part(full, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 UUID of a name, as a pure expression."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def url_id(url: Column) -> Column:
    return uuid5(canonical_url(url))


def host(url: Column) -> Column:
    """Lower-case host without port, user and www."""
    return F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^.*@|:\d*$", ""), r"^www\.", "")


def _host_rank(url: Column) -> Column:
    h = host(url)
    out = F.lit(0)
    for name, rank in reversed(HOST_RANK):
        out = F.when((h == name) | F.endswith(h, F.lit(f".{name}")), rank).otherwise(out)
    return out


def publisher_rank(source: Column, url: Column) -> Column:
    """Preference as a source of the main image: by name, else by host, else 0."""
    names = F.create_map(*[F.lit(x) for pair in NAME_RANK.items() for x in pair])
    by_name = F.try_element_at(names, F.lower(F.trim(source)))
    return F.coalesce(by_name, F.when(F.coalesce(url, F.lit("")) != "", _host_rank(url)), F.lit(0))


def publisher_of_url(url: Column) -> Column:
    """Publisher id by host, null if unknown."""
    r = _host_rank(url)
    return F.when(r == 1, "hindu").when(r == 2, "times-of-india").when(r == 3, "indian-express")


def publisher_of(name_or_url: Column) -> Column:
    """Publisher id of a name or an http address, null if unknown."""
    names = F.create_map(*[F.lit(x) for name, rank in NAME_RANK.items() for x in (name, PUBLISHER_OF_RANK[rank])])
    c = F.trim(name_or_url)
    return F.when(c.rlike("^https?://"), publisher_of_url(c)).otherwise(F.try_element_at(names, F.lower(c)))


def absolute(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)


def best_of_srcset(srcset: Column) -> Column:
    """The address with the largest width of a srcset; ``2x`` counts as 2000, none as 0, ties to the first."""
    parts = F.filter(F.transform(F.split(F.trim(srcset), ","), lambda x: F.trim(x)), lambda x: x != "")
    size = r"\s+(\d+)(w|x)\s*$"
    number = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, size, 1), F.lit("")).cast("int"), F.lit(0))
    factor = lambda x: F.when(F.regexp_extract(x, size, 2) == "x", 1000).otherwise(1)
    each = F.transform(parts, lambda x, i: F.struct((number(x) * factor(x)).alias("w"), (-i).alias("i"), absolute(F.trim(F.regexp_replace(x, size, ""))).alias("u")))
    return F.array_max(F.filter(each, lambda x: x["u"] != ""))["u"]


def upgrade_image(url: Column, image_host: str, width: int = IMAGE_WIDTH) -> Column:
    """For images of ``image_host``: the query with w set and auto and fit given where absent;
    other addresses only become absolute. Empty is null."""
    one = F.when(F.contains(url, F.lit(",")) & F.contains(url, F.lit("w")), F.coalesce(best_of_srcset(url), url)).otherwise(F.trim(url))
    full = absolute(F.nullif(F.trim(one), F.lit("")))
    pairs = F.filter(F.split(F.regexp_replace(_part(full, 4), r"^\?", ""), "&"), lambda x: F.contains(x, F.lit("=")) & ~F.endswith(x, F.lit("=")))
    names = F.transform(pairs, lambda x: F.substring_index(x, "=", 1))
    with_w = F.when(F.array_contains(names, "w"), F.transform(pairs, lambda x: F.when(F.substring_index(x, "=", 1) == "w", F.lit(f"w={width}")).otherwise(x))).otherwise(F.array_append(pairs, F.lit(f"w={width}")))
    with_auto = F.when(F.array_contains(names, "auto"), with_w).otherwise(F.array_append(with_w, F.lit(IMAGE_AUTO)))
    with_fit = F.when(F.array_contains(names, "fit"), with_auto).otherwise(F.array_append(with_auto, F.lit(IMAGE_FIT)))
    upgraded = F.concat(_part(full, 1), F.lit("://"), _part(full, 2), _part(full, 3), F.lit("?"), F.array_join(with_fit, "&"))
    return F.when(F.contains(full, F.lit(image_host)), upgraded).otherwise(full)


def image_of_key(key: Column, base: str, width: int = IMAGE_WIDTH) -> Column:
    """The address of a stored image under ``base``: its key percent-encoded whole, slashes too."""
    path = F.replace(F.url_encode(F.regexp_replace(F.trim(key), "^/+", "")), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(base), path, F.lit(f"?w={width}&{IMAGE_AUTO}&{IMAGE_FIT}"))


def hero_address(original: Column, key: Column, *, image_host: str, old_host: str, base: str) -> Column:
    """A story's main image: its original address upgraded where it is one of ``image_host`` or a
    srcset; else that of its key, which also stands in for addresses of ``old_host``; else the
    original address as it is."""
    url, key = (F.nullif(F.trim(c), F.lit("")) for c in (original, key))
    by_key = F.when(key.isNotNull(), image_of_key(key, base))
    wide = F.contains(absolute(url), F.lit(image_host)) | (F.contains(url, F.lit(",")) & F.contains(url, F.lit("w")))
    return F.when(wide, upgrade_image(url, image_host)).when(F.contains(absolute(url), F.lit(old_host)), by_key).otherwise(F.coalesce(by_key, absolute(url)))
