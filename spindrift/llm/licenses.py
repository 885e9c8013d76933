"""License detection by ordered signature rules, with DataFrame operations only.

A rule is a regular expression over a text's lower-case words (joined by single blanks),
keywords of which each match holds one, a label, a priority and a confidence.  Only texts
with a word that some rule's match must hold are looked at (see ``gate_words``); of their
words, those that are some rule's keyword pick the rules to try.  A detection inside another one of the same or a
higher priority is suppressed; base rules are reported whatever suppresses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import ascii_lower, n_words, text_key, words

#: phrase, label, keyword: the places that are counted as such.
BASE = (("mit license", "mit", "mit"), ("apache license", "apache", "apache"), ("general public license", "gpl", "general"))
#: family label, keywords, pattern of the name, versions (a blank stands for the dot).
FAMILIES = (
    ("Apache", "apache", r"apache(?: software)?(?: foundation)?", ("1 0", "1 1", "2 0")),
    ("MIT", "mit expat x11", r"(?:mit|expat|x11)", ()),
    ("GPL", "general", r"(?:gnu )?general public", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("LGPL", "lesser", r"(?:gnu )?lesser general public", ("2 1", "3 0", "3")),
    ("LGPL", "library", r"(?:gnu )?library general public", ("2 0", "2")),
    ("AGPL", "affero", r"(?:gnu )?affero general public", ("1 0", "3 0", "3")),
    ("GFDL", "documentation", r"(?:gnu )?free documentation", ("1 1", "1 2", "1 3")),
    ("GPL", "gpl", r"gnu gpl|gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("LGPL", "lgpl", r"gnu lgpl|lgpl", ("2 1", "3 0", "2", "3")),
    ("AGPL", "agpl", r"gnu agpl|agpl", ("3 0", "3")),
    ("BSD", "bsd", r"(?:new |modified |revised |simplified |free )?bsd", ()),
    ("BSD-2-Clause", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd)", ()),
    ("BSD-3-Clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd)", ()),
    ("BSD-4-Clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd)", ()),
    ("0BSD", "0bsd", r"0bsd", ()),
    ("MPL", "mozilla", r"mozilla public", ("1 0", "1 1", "2 0")),
    ("MPL", "mpl", r"mpl", ("1 0", "1 1", "2 0")),
    ("EPL", "eclipse", r"eclipse public", ("1 0", "2 0")),
    ("EPL", "epl", r"epl", ("1 0", "2 0")),
    ("CDDL", "cddl", r"cddl", ("1 0", "1 1")),
    ("CDDL", "distribution", r"common development and distribution", ("1 0", "1 1")),
    ("EUPL", "eupl", r"eupl", ("1 0", "1 1", "1 2")),
    ("EUPL", "union", r"european union public", ("1 0", "1 1", "1 2")),
    ("CPL", "common", r"common public", ("1 0",)),
    ("IPL", "ibm", r"ibm public", ("1 0",)),
    ("OSL", "open", r"open software", ("1 0", "2 0", "2 1", "3 0")),
    ("AFL", "academic", r"academic free", ("1 2", "2 0", "2 1", "3 0")),
    ("Artistic", "artistic", r"artistic", ("1 0", "2 0")),
    ("BSL", "boost", r"boost software", ("1 0",)),
    ("BUSL", "business", r"business source", ("1 1",)),
    ("ISC", "isc", r"isc", ()),
    ("Zlib", "zlib", r"zlib(?: libpng)?", ()),
    ("WTFPL", "wtfpl", r"wtfpl", ("2", "2 0")),
    ("Unlicense", "unlicense", r"unlicense", ()),
    ("PSF", "python", r"python(?: software foundation)?", ("2", "2 0")),
    ("PHP", "php", r"php", ("3 0", "3 01")),
    ("Ruby", "ruby", r"ruby", ()),
    ("OFL", "font", r"(?:sil )?open font", ("1 0", "1 1")),
    ("ODbL", "database", r"open (?:data commons )?database", ("1 0",)),
    ("PDDL", "dedication", r"public domain dedication and", ("1 0",)),
    ("MS-PL", "microsoft", r"microsoft public", ()),
    ("MS-RL", "microsoft", r"microsoft reciprocal", ()),
    ("NCSA", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", ()),
    ("PostgreSQL", "postgresql", r"postgresql", ()),
    ("Vim", "vim", r"vim", ()),
    ("OpenSSL", "openssl", r"openssl", ()),
    ("SSPL", "server", r"server side public", ("1", "1 0")),
    ("Elastic", "elastic", r"elastic", ("2", "2 0")),
    ("CeCILL", "cecill", r"cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("LPPL", "latex", r"latex project public", ("1 0", "1 2", "1 3")),
    ("QPL", "q", r"q public", ("1 0",)),
    ("Sleepycat", "sleepycat", r"sleepycat", ()),
    ("UPL", "universal", r"universal permissive", ("1 0",)),
    ("ECL", "educational", r"educational community", ("1 0", "2 0")),
)
CREATIVE = (("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s"), ("by sa", "attribution share ?alike"), ("by", "attribution"))
#: label, keywords, pattern, priority, confidence.
PHRASES = (
    ("Apache-2.0", "apache", r"apache(?: software)?(?: version)?(?: v2| 2)(?: 0)?(?:plus)?(?! \d)", 3, 0.7),
    ("copyright-notice", "copyright", r"copyright(?: c)? (?:19|20)\d\d", 1, 0.5),
    ("all-rights-reserved", "reserved", r"all rights reserved", 1, 0.5),
    ("public-domain", "domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain", 2, 0.8),
    ("public-domain", "domain", r"public domain", 1, 0.5),
    ("CC0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 3, 0.9),
    ("CC0-1.0", "commons", r"creative commons zero(?: v?1 0)?(?: universal)?", 3, 0.9),
    ("copyleft", "copyleft", r"copyleft", 1, 0.4),
    ("MIT", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 3, 1.0),
    ("ISC", "permission", r"permission to use copy modify and(?: or)? distribute this software for any purpose", 3, 1.0),
    ("BSD", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 3, 1.0),
    ("Zlib", "warranty", r"this software is provided as is without any express or implied warranty", 2, 0.8),
    ("GPL", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public", 3, 1.0),
    ("MIT", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 3, 1.0),
    ("MIT", "merchantability", r"without warranty of any kind express or implied including but not limited to the warranties of merchantability", 2, 0.7),
    ("BSD", "redistributions", r"redistributions of source code must retain the above copyright notice", 3, 1.0),
    ("BSD", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 3, 1.0),
    ("BSD-3-Clause", "endorse", r"may be used to endorse or promote products derived from this software", 4, 1.0),
    ("BSD-4-Clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 4, 1.0),
    ("Apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 4, 1.0),
    ("Apache-2.0", "basis", r"software distributed under the license is distributed on an as is basis", 4, 1.0),
    ("MPL-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 4, 1.0),
    ("GPL", "hope", r"this program is distributed in the hope that it will be useful but without any warranty", 3, 0.9),
    ("GPL", "received", r"you should have received a copy of the gnu general public license along with this", 3, 1.0),
    ("LGPL", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this", 4, 1.0),
    ("AGPL", "received", r"you should have received a copy of the gnu affero general public license along with this", 4, 1.0),
    ("GPL", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 3, 0.9),
    ("LGPL", "library", r"this library is free software you can redistribute it", 3, 1.0),
    ("EPL", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public", 4, 1.0),
    ("Unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 4, 1.0),
    ("WTFPL", "fuck", r"do what the fuck you want to", 3, 0.9),
    ("BSL-1.0", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 4, 1.0),
    ("Zlib", "misrepresented", r"the origin of this software must not be misrepresented", 3, 1.0),
    ("Zlib", "altered", r"altered source versions must be plainly marked as such", 3, 1.0),
    ("PostgreSQL", "fee", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", 3, 0.9),
    ("PSF", "psf", r"psf is making python available to licensee on an as is basis", 3, 1.0),
    ("OFL", "font", r"this font software is licensed under the sil open font license", 4, 1.0),
    ("GFDL", "invariant", r"with no invariant sections", 2, 0.8),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited", 3, 0.9),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|work|document) may be reproduced", 3, 0.9),
    ("proprietary", "trade", r"confidential and proprietary trade secrets?|trade secrets? and confidential", 2, 0.7),
    ("no-warranty", "warranty warranties", r"without (?:any )?warrant(?:y|ies)", 1, 0.3),
    ("proprietary", "proprietary", r"proprietary(?: and confidential)?(?: license)?", 1, 0.4),
)
_LICENSE = r"(?:public )?licen[cs]e"
_LICENSED = r"licen[cs]ed"
#: One of these is in each match of a rule whose pattern holds one of the two patterns above.
_LICENSE_WORDS = ("license", "licence", "licensed", "licenced")
#: Short names that are written together with a version: gplv3, lgpl2 1.
JOINED = {"gpl": "GPL", "lgpl": "LGPL", "agpl": "AGPL", "gfdl": "GFDL", "mpl": "MPL", "epl": "EPL", "eupl": "EUPL", "cddl": "CDDL", "cecill": "CeCILL"}
#: Names that stand without the word license where something is licensed under them.
BARE = frozenset(("Apache", "MIT", "BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Zlib", "BSL"))
#: In an expression: a license before the next one, and what joins them.
_OPERAND = r"[a-z0-9]+(?: (?:by|sa|nc|nd|pl|rl|clause|only|[0-9]+|[0-9]+plus))*(?: or later)?(?: with [a-z]+ exception(?: [0-9]+)*)? (?:or|and) "
#: A plus sign that ends a version number; it becomes part of the number's word.
_PLUS = r"(?<=[0-9])\+(?![0-9a-z+\x80-\x{10FFFF}])"


def _number(version: str) -> str:
    """One form of a version's number: 2 and 2.0 are the same."""
    return version.replace(" ", ".") if " " in version else f"{version}.0"


#: Families of which a later version may be allowed in words that are fixed.
OR_LATER = frozenset(("GPL", "LGPL", "AGPL", "GFDL"))


def rules() -> list[tuple[int, str, str, str, int, float, bool]]:
    """All rules in order: number, label, keywords, pattern, priority, confidence, base.

    Each family gives its name with the word license, the same after a granting verb, an
    SPDX tag, and each of these again with each version, and with later ones allowed.
    """
    out: list[tuple[str, str, str, int, float, bool]] = [(label, key, phrase, 1, 0.9, True) for phrase, label, key in BASE]
    for label, key, name, versions in FAMILIES:
        license_word = "" if key in ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "wtfpl", "unlicense", "0bsd", "cecill") else f" {_LICENSE}"
        out.append((label, key, rf"(?:{name}){license_word}", 2, 0.8, False))
        out.append((label, key, rf"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name}){license_word}", 3, 0.95, False))
        out.append((label, key, rf"(?:{name}) {_LICENSED}", 2, 0.8, False))
        if label in BARE:
            # a later one of a list comes from a rule of less priority, so that it suppresses none before it
            for before, priority in (("", 3), (r"[a-z0-9]+(?: (?:license|licence|version|public|clause|[0-9]+))* (?:and|or|and or|or the|and the) ", 1)):
                out.append((label, key, rf"{_LICENSED} under (?:both |either )?(?:the )?(?:terms of (?:the )?)?{before}(?:{name})", priority, 0.8, False))
        for v in versions:
            exact = f"{label}-{_number(v)}"
            number = rf"(?:v|version )?{v}(?! \d)" if label in OR_LATER else rf"(?:v|version )?{v}(?:plus)?(?! \d)"
            if label in OR_LATER:
                later = r"or(?: at your option)?(?: any)? later(?: versions?)?"
                out.append((f"{exact}-or-later", key, rf"(?:{name}){license_word} (?:v|version )?{v}plus", 5, 1.0, False))
                out.append((f"{exact}-or-later", key, rf"(?:{name}){license_word} {number}(?: of the license)? {later}", 5, 1.0, False))
                out.append((f"{exact}-or-later", key, rf"(?:{name}){license_word} as published by the free software foundation(?: either)? version {v}(?: of the license)? {later}", 5, 1.0, False))
                out.append((exact, key, rf"(?:{name}){license_word} as published by the free software foundation(?: either)? version {v}(?! \d)", 4, 0.95, False))
            out.append((exact, key, rf"(?:{name}){license_word} {number}", 4, 0.95, False))
            out.append((exact, key, rf"(?:{name}) {number} {_LICENSED}", 4, 0.95, False))
            out.append((exact, key, rf"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name}){license_word} {number}", 5, 1.0, False))
    for code, words_ in CREATIVE:
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"CC-{code.upper().replace(' ', '-')}-{v.replace(' ', '.')}"
            out.append((label, "cc", rf"cc {code} {v}", 4, 0.95, False))
            out.append((label, "commons", rf"creative commons {words_}(?: international| unported)? {v}", 4, 0.95, False))
        out.append((f"CC-{code.upper().replace(' ', '-')}", "cc", rf"cc {code}", 2, 0.8, False))
        out.append((f"CC-{code.upper().replace(' ', '-')}", "commons", rf"creative commons {words_}", 2, 0.8, False))
    tags = dict.fromkeys([(label, versions) for label, _, _, versions in FAMILIES])
    for label, versions in tags:
        for v in versions or ("",):
            written, tag = f"{label} {v}".lower().replace("-", " ").strip(), f"{label}-{_number(v)}" if v else label
            out.append((tag, "spdx", rf"spdx license identifier {written}(?: only)?(?! \d)", 6, 1.0, False))
            if label in OR_LATER:
                out.append((f"{tag}-or-later", "spdx", rf"spdx license identifier {written}(?: or later|plus)", 7, 1.0, False))
            for n, priority in ((1, 5), (2, 4), (3, 3)):  # the further back, the less priority: none suppresses one before it
                out.append((tag, "spdx", rf"spdx license identifier (?:{_OPERAND}){{{n}}}{written}(?: only)?(?! \d)(?! or later)", priority, 1.0, False))
                if label in OR_LATER:
                    out.append((f"{tag}-or-later", "spdx", rf"spdx license identifier (?:{_OPERAND}){{{n}}}{written}(?: or later|plus)", priority, 1.0, False))
    for short, label in JOINED.items():
        for number in dict.fromkeys(_number(v) for family, _, _, versions in FAMILIES if family == label for v in versions):
            major, minor = number.split(".")
            for word in (f"{short}v{major}", f"{short}{major}"):
                rest = "(?: 0)?" if minor == "0" else f" {minor}"
                out.append((f"{label}-{number}", word, rf"(?:gnu )?{word}{rest}(?! \d)", 4, 0.95, False))
                if label in OR_LATER:
                    out.append((f"{label}-{number}-or-later", word, rf"(?:gnu )?{word}{rest} or(?: any)? later", 5, 1.0, False))
                    out.append((f"{label}-{number}-or-later", word, rf"(?:gnu )?{word} {minor}plus", 5, 1.0, False))
                    if minor == "0":
                        out.append((f"{label}-{number}-or-later", f"{word}plus", rf"(?:gnu )?{word}plus", 5, 1.0, False))
    out += [(label, key, pattern, priority, score, False) for label, key, pattern, priority, score in PHRASES]
    return [(i, *x) for i, x in enumerate(dict.fromkeys(out))]


def gate_words() -> list[str]:
    """Words of which every match of every rule holds one: the words license and licensed where
    the rule's pattern has one in any case, and the rule's keywords elsewhere. A version's plus
    sign is no part of a word here; a rule without it has the same keyword."""
    out: set[str] = set()
    for _, _, keys, pattern, _, _, base in rules():
        out.update(_LICENSE_WORDS if base or keys == "spdx" or f" {_LICENSE}" in pattern or _LICENSED in pattern else keys.split())
    return sorted(out)


def _rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table of fixed size, one row for each keyword; each pattern takes the
    blank before its first word."""
    rows = [(i, label, key, f" (?:{pattern})(?= )", priority, score, base) for i, label, keys, pattern, priority, score, base in rules() for key in keys.split()]
    return F.broadcast(spark.createDataFrame(rows, "rule int, label string, keyword string, pattern string, priority int, confidence double, base boolean"))


def _any_of(names: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in names])


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, key, rule, label, priority, confidence, base, first, last: all detections with
    their first and last word, before any suppression."""
    # lower() is much faster than ascii_lower() and never merges or splits words
    gate = F.arrays_overlap(words(F.lower(F.coalesce("text", F.lit("")))), _any_of(gate_words()))
    marked = documents.where(gate).select("doc_id", "key", words(F.regexp_replace(ascii_lower(F.col("text")), _PLUS, "plus")).alias("w"))
    keywords = sorted({key for _, _, keys, *_ in rules() for key in keys.split()})
    joined = marked.select("doc_id", "key", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("line"), F.explode_outer(F.array_intersect("w", _any_of(keywords))).alias("keyword"))
    tried = joined.join(_rule_table(documents.sparkSession), "keyword")
    parts = F.arrays_zip(F.expr("split(line, pattern, -1)").alias("gap"), F.expr("regexp_extract_all(line, pattern, 0)").alias("hit"))
    keys = ("doc_id", "key", "rule", "label", "priority", "confidence", "base")
    each = tried.where(F.expr("line rlike pattern")).select(*keys, F.posexplode_outer(parts).alias("pos", "x"))
    size = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" ")))  # noqa: E731  each word has one blank before it
    spans = each.select(*keys, "pos", size(F.col("x.gap")).alias("gap"), F.coalesce(size(F.col("x.hit")), F.lit(0)).alias("n"), F.col("x.hit").isNotNull().alias("is_hit")).distinct()
    before = Window.partitionBy("doc_id", "key", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.sum(F.col("gap") + F.col("n")).over(before) - F.col("n")
    return spans.withColumn("first", first).where("is_hit").select(*keys, "first", (F.col("first") + F.col("n") - 1).alias("last"))


def scan_licenses(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base_labels has the labels of base phrases, labels those and the labels of detections
    that no other one suppresses, but for those that differ from a base label in case only;
    both sorted and comma-joined, empty if none. score is the
    highest confidence among them, 0 if none. first_word and last_word are null without a
    base phrase. Null texts are empty. Every row is kept, repeated ones too (rows with one
    id and different texts are told apart); other columns are ignored.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", text_key(F.col("text")))
    found = detect(docs)
    wider = Window.partitionBy("doc_id", "key").orderBy(F.col("first"), F.col("last").desc(), F.col("priority").desc(), F.col("rule")).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in sorted({x[4] for x in rules()}):
        reach = F.max(F.when((F.col("priority") >= p) & ~F.col("base"), F.col("last"))).over(wider)
        inside = inside | ((F.col("priority") == p) & F.coalesce(reach >= F.col("last"), F.lit(False)))
    kept = found.withColumn("inside", inside & ~F.col("base")).where(~F.col("inside"))
    base = F.col("base")
    per_doc = kept.groupBy("doc_id", "key").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("b"), F.array_sort(F.collect_set("label")).alias("all"), F.max("confidence").alias("score"),
    )
    # a license is named once: a base label stands for the same name in the method's spelling
    named = F.filter("all", lambda x: F.array_contains("b", x) | ~F.array_contains("b", F.lower(x)))
    per_doc = per_doc.withColumns({"base_labels": F.array_join("b", ","), "labels": F.array_join(named, ",")}).drop("b", "all")
    per_doc = per_doc.withColumnsRenamed({"doc_id": "d", "key": "k"})
    out = docs.select("doc_id", "key", n_words(F.col("text")).alias("n_words")).join(per_doc, F.expr("doc_id <=> d AND key = k"), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
