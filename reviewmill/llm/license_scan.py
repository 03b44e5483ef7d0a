"""Licenses: ordered signature rules behind a keyword prefilter.

A rule is a regular expression with a label, a priority and keywords that each of its matches holds.
A text is looked at closely only if it holds one of a few general keywords, and a rule runs only if
the text holds the rule's. Keywords are sought in lower case with every run of white space made one
space, so that no match is lost to them. Detections are code-point intervals. One that lies inside another of the same or a
higher priority is suppressed, so a full notice silences the names and fields inside it;
equal intervals go to the higher priority, then to the earlier rule.

The rules are license families times the forms in which texts name them, and a list of
tell-tale sentences from the licenses' own texts.

Defined results: null text is empty. A text without words or detections has empty labels, null word
places and score 0. Every row is answered for itself; ids play no part.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, query, table, whole_text
from .spans import find_spans, no_spans

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# A character that is no part of a word (A-Z counts as a-z).
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: How sure a detection of each priority is.
CONFIDENCE = {1: 0.5, 2: 0.7, 3: 0.9, 4: 1.0}
BASE_CONFIDENCE = 0.7


class Family(NamedTuple):
    label: str
    name: str  # a space stands for any white space
    ids: str  # identifiers in metadata
    keys: str  # a text that names the family holds one of these, in lower case
    link: str = ""
    short: bool = False  # the name alone says little: a title needs the word license
    alone: str = ""  # keys of names without the word license


class Rule(NamedTuple):
    label: str
    form: str
    priority: int
    pattern: str
    keywords: list[list[str]]  # of each list every match holds one; the first opens the text


def _version(n: str) -> str:
    major, _, minor = n.partition(".")
    return rf",? ?(?:version |v\.? ?|-)?{major}" + (rf"(?:\.{minor})?" if minor == "0" else rf"\.{minor}") + r"(?!\.?[0-9])"


def _short(name: str, majors: str) -> str:
    """Keys of a short name in front of a version; the bare letters are in many words."""
    return "|".join(name + c for c in f" ,v-{majors}")


def _creative(terms: str, words: str, n: str) -> Family:
    spelled = "-".join(terms.split())
    return Family(
        f"cc-{spelled}-{n}",
        rf"(?:CC[ -]{terms.replace(' ', '[ -]')}|Creative Commons {words})(?: International| Unported)?[ -]?(?:version )?{n}",
        rf"CC-{spelled}-{n}", "cc by|cc-by|creative commons", rf"creativecommons\.org/licenses/{spelled}/{n}",
        alone="cc by|cc-by|creative commons",
    )


FAMILIES = [
    Family("mit", "(?:MIT|Expat|X11)", "MIT", "mit|expat|x11", r"opensource\.org/licenses?/mit", True),
    Family("mit-0", "MIT No Attribution", "MIT-0", "mit", alone="no attribution"),
    Family("apache-2.0", f"Apache (?:Software )?Licen[cs]e{_version('2.0')}", "Apache-2\\.0", "apache",
           r"apache\.org/licenses/LICENSE-2\.0"),
    Family("apache-1.1", f"Apache (?:Software )?Licen[cs]e{_version('1.1')}", "Apache-1\\.1", "apache"),
    *[Family(f"gpl-{n}", rf"(?:(?:GNU )?General Public Licen[cs]e(?: \(GPL\))?|(?:GNU )?GPL){_version(n)}",
             rf"GPL-?{n}(?:-only|-or-later|\+)?", "gpl|general public", rf"gnu\.org/licenses/(?:old-licenses/)?gpl-{n}",
             alone="gpl")
      for n in ("1.0", "2.0", "3.0")],
    *[Family(f"lgpl-{n}", rf"(?:(?:GNU )?(?:Lesser|Library) General Public Licen[cs]e|(?:GNU )?LGPL){_version(n)}",
             rf"LGPL-?{n}(?:-only|-or-later|\+)?", "lgpl|general public", rf"gnu\.org/licenses/(?:old-licenses/)?lgpl-{n}",
             alone="lgpl")
      for n in ("2.0", "2.1", "3.0")],
    Family("agpl-3.0", f"(?:(?:GNU )?Affero General Public Licen[cs]e|(?:GNU )?AGPL){_version('3.0')}",
           "AGPL-?3\\.0(?:-only|-or-later|\\+)?", "agpl|affero", r"gnu\.org/licenses/agpl-3\.0", alone="agpl"),
    *[Family(f"gfdl-{n}", f"(?:GNU )?Free Documentation Licen[cs]e{_version(n)}", f"GFDL-{n}", "free documentation|gfdl")
      for n in ("1.2", "1.3")],
    *[Family(f"mpl-{n}", f"(?:Mozilla Public Licen[cs]e|MPL){_version(n)}", f"MPL-{n}", _short("mpl", n[0]) + "|mozilla public", rf"mozilla\.org/(?:en-US/)?MPL/{n}",
             alone=_short("mpl", n[0]))
      for n in ("1.1", "2.0")],
    Family("bsd-2-clause", "(?:Simplified BSD|BSD[ -]2[ -]Clause|2[ -]clause BSD)", "BSD-2-Clause", "bsd", "", True),
    Family("bsd-3-clause", "(?:New BSD|Modified BSD|BSD[ -]3[ -]Clause|3[ -]clause BSD)", "BSD-3-Clause", "bsd",
           r"opensource\.org/licenses?/bsd-3-clause", True),
    Family("bsd-4-clause", "(?:Original BSD|BSD[ -]4[ -]Clause|4[ -]clause BSD)", "BSD-4-Clause", "bsd", "", True),
    Family("0bsd", "(?:Zero[ -]Clause BSD|0BSD)", "0BSD", "bsd", "", True),
    Family("bsd", "BSD", "BSD", "bsd", "", True),
    Family("isc", "ISC", "ISC", "isc", r"opensource\.org/licenses?/isc", True),
    Family("cc0-1.0", "(?:CC0|Creative Commons Zero)(?: 1\\.0)?", "CC0-1\\.0", "cc0|creative commons zero", r"creativecommons\.org/publicdomain/zero",
           alone="cc0|creative commons zero"),
    *[_creative(t, w, n) for n in ("2.0", "3.0", "4.0") for t, w in (
        ("by", "Attribution"), ("by sa", "Attribution[ -]Share ?Alike"),
        ("by nc", "Attribution[ -]Non ?Commercial"), ("by nd", "Attribution[ -]No ?Deriv(?:ative)?s"),
        ("by nc sa", "Attribution[ -]Non ?Commercial[ -]Share ?Alike"),
        ("by nc nd", "Attribution[ -]Non ?Commercial[ -]No ?Deriv(?:ative)?s"))],
    Family("unlicense", "Unlicense", "Unlicense", "unlicense", r"unlicense\.org"),
    Family("wtfpl", "(?:WTFPL|Do What The F\\w+ You Want To Public Licen[cs]e)", "WTFPL", "wtfpl|do what the", alone="wtfpl"),
    Family("zlib", "zlib(?:/libpng)?", "Zlib", "zlib", "", True),
    Family("bsl-1.0", "Boost Software Licen[cs]e", "BSL-1\\.0", "boost|bsl-", r"boost\.org/LICENSE_1_0"),
    *[Family(f"epl-{n}", f"(?:Eclipse Public Licen[cs]e|EPL){_version(n)}", f"EPL-{n}", _short("epl", n[0]) + "|eclipse public", r"eclipse\.org/legal/epl",
             alone=_short("epl", n[0]))
      for n in ("1.0", "2.0")],
    Family("edl-1.0", "Eclipse Distribution Licen[cs]e", "EDL-1\\.0", "eclipse distribution|edl-"),
    *[Family(f"cddl-{n}", f"(?:Common Development and Distribution Licen[cs]e|CDDL){_version(n)}", f"CDDL-{n}", "cddl|common development", alone="cddl")
      for n in ("1.0", "1.1")],
    *[Family(f"eupl-{n}", f"(?:European Union Public Licen[cs]e|EUPL){_version(n)}", f"EUPL-{n}", "eupl|european union public", alone="eupl") for n in ("1.1", "1.2")],
    *[Family(f"artistic-{n}", f"Artistic Licen[cs]e{_version(n)}", f"Artistic-{n}", "artistic") for n in ("1.0", "2.0")],
    *[Family(f"afl-{n}", f"Academic Free Licen[cs]e{_version(n)}", f"AFL-{n}", "academic free|afl-") for n in ("2.1", "3.0")],
    *[Family(f"osl-{n}", f"Open Software Licen[cs]e{_version(n)}", f"OSL-{n}", "open software|osl-") for n in ("2.1", "3.0")],
    Family("ecl-2.0", "Educational Community Licen[cs]e", "ECL-2\\.0", "educational community|ecl-"),
    Family("ncsa", "(?:University of Illinois/)?NCSA(?: Open Source)?", "NCSA", "ncsa", "", True),
    Family("postgresql", "PostgreSQL", "PostgreSQL", "postgresql", "", True),
    Family("psf-2.0", "(?:Python Software Foundation|PSF)", "(?:PSF|Python)-2\\.0", "psf|python", "", True),
    Family("php-3.01", "PHP", "PHP-3\\.01", "php", "", True),
    Family("ruby", "Ruby", "Ruby", "ruby", "", True),
    Family("vim", "Vim", "Vim", "vim", "", True),
    Family("openssl", "OpenSSL", "OpenSSL", "openssl", "", True),
    Family("ofl-1.1", "(?:SIL )?Open Font Licen[cs]e", "OFL-1\\.1", "open font|ofl-", r"scripts\.sil\.org/OFL"),
    Family("odbl-1.0", "Open (?:Data Commons Open )?Database Licen[cs]e", "ODbL-1\\.0", "database lic|odbl", r"opendatacommons\.org/licenses/odbl"),
    Family("odc-by-1.0", "Open Data Commons Attribution Licen[cs]e", "ODC-By-1\\.0", "open data commons|odc-by"),
    Family("ms-pl", "Microsoft Public Licen[cs]e", "MS-PL", "microsoft public|ms-pl"),
    Family("ms-rl", "Microsoft Reciprocal Licen[cs]e", "MS-RL", "microsoft reciprocal|ms-rl"),
    Family("upl-1.0", "Universal Permissive Licen[cs]e", "UPL-1\\.0", "universal permissive|upl-"),
    Family("sspl-1.0", "Server Side Public Licen[cs]e", "SSPL-1\\.0", "server side public|sspl"),
    Family("busl-1.1", "Business Source Licen[cs]e", "BUSL-1\\.1", "business source|busl"),
    Family("elastic-2.0", "Elastic Licen[cs]e", "Elastic-2\\.0", "elastic"),
    Family("unicode", "Unicode", "Unicode-(?:DFS|3)[\\w.-]*", "unicode", "", True),
    Family("openrail", "(?:Creative ?ML )?Open ?RAIL(?:-?[MDS]+)?", "(?:creativeml-)?openrail(?:-m|\\+\\+)?", "rail", "", True),
]

VERBS = [
    "licensed", "licenced", "released", "distributed", "published", "available", "provided", "covered", "issued", "shared",
]
_UNDER = rf"(?:{'|'.join(VERBS)}) (?:\w+ )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
#: What such a notice holds beside a verb.
UNDER = " under "

#: Sentences that give a license's own text away.
TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy", "permission is hereby granted"),
    ("isc", "Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", "permission to use"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification", "redistribution and use"),
    ("bsd-3-clause", "Neither the name of .{1,80} nor the names of its contributors", "neither the name"),
    ("bsd-4-clause", "All advertising materials mentioning features or use of this software", "advertising materials"),
    ("apache-2.0", "you may not use this file except in compliance with the Licen[cs]e", "in compliance with the"),
    ("gpl", "This program is free software[;:] you can redistribute it and/or modify", "is free software"),
    ("lgpl", "This library is free software[;:] you can redistribute it and/or modify", "is free software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public Licen[cs]e", "source code form"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released into|dedicated to|placed in(?:to)?|in) the public domain", "public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty", "as-is"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining", "organization obtaining"),
    ("proprietary", "(?:copyright|\\(c\\)|©) .{0,80}all rights reserved", "all rights reserved"),
    ("proprietary", "(?:proprietary and confidential|unauthorized copying of this file)", "confidential|unauthorized copying"),
    ("cc", "This work is licensed under a Creative Commons", "creative commons"),
    ("gpl", "under the GNU (?:General Public|GPL)", "under the gnu"),
]


def _spaced(pattern: str) -> str:
    return pattern.replace("[ -]", "[\\s-]").replace(" ?", "\\s*").replace(" ", "\\s+")


def build_rules() -> list[Rule]:
    """All rules in their order: sentences first, then every family in every form."""
    out = [Rule(label, "text", 4, "(?i)" + _spaced(p), [k.split("|")]) for label, p, k in TEXTS]
    for f in FAMILIES:
        title = rf"(?:{f.name}) licen[cs]e" if f.short else f.name
        forms = [
            ("identifier", 4, rf"SPDX-License-Identifier:\s*\(?(?:{f.ids})(?!\w|\.\w)", [["spdx"]]),
            ("notice", 3, rf"{_UNDER}(?:{f.name})(?: licen[cs]e)?(?!\w)", [[UNDER], VERBS]),
            ("title", 2, rf"(?<!\w)(?:{title})(?!\w)", [["licen", *filter(None, f.alone.split("|"))]]),
            ("field", 1, rf"licen[cs]es?[\"']?\s*[:=]\s*[\[(\"'\s]*(?:{f.ids})(?!\w|\.\w)", [["licen"]]),
        ]
        for form, priority, pattern, keys in forms:
            out.append(Rule(f.label, form, priority, "(?i)" + _spaced(pattern), [*keys, f.keys.split("|")]))
        if f.link:
            site = re.match(r"[a-z\\.]+", f.link)[0].replace("\\", "")
            pattern = rf"(?:https?://)?(?:www\.)?{f.link}"
            out.append(Rule(f.label, "link", 3, "(?i)" + _spaced(pattern), [[site]]))
    return out


RULES = build_rules()
_FIRST = {k for r in RULES for k in r.keywords[0]}
#: A text without any of these holds no match of any rule.
GENERAL = sorted(k for k in _FIRST if not any(o != k and o in k for o in _FIRST))
KEYS = sorted({k for r in RULES for keys in r.keywords for k in keys})
_RULE = "struct<label:string,priority:int,pattern:string,keywords:array<array<string>>,at:int>"


def _rule_table(rules: list[Rule]) -> Column:
    rows = [
        {"label": r.label, "priority": r.priority, "pattern": r.pattern, "keywords": r.keywords, "at": i}
        for i, r in enumerate(rules)
    ]
    return F.from_json(F.lit(json.dumps(rows)), f"array<{_RULE}>")


def _any_case(words: str) -> str:
    return f"{_GAP}+".join("".join(f"[{c.upper()}{c}]" for c in w) for w in words.split())


def _base_spans(text: Column) -> Column:
    spans = [
        find_spans(text, rf"(?<!{_IN_WORD}){_any_case(phrase)}(?!{_IN_WORD})", label, i)
        for i, (phrase, label) in enumerate(BASE.items())
    ]
    return F.when(F.rlike(text, F.lit("[Ll][Ii][Cc][Ee][Nn][Ss][Ee]")), F.array_sort(F.concat(*spans))).otherwise(no_spans())


DETECTION = "struct<start:int,back:int,level:int,at:int,label:string>"


def _detections(text: Column, low: Column, rules: Column) -> Column:
    """All matches of the rules whose keywords the text holds: by start, longest and highest
    priority first (``back`` and ``level`` are the end and the priority, negated)."""
    # The keywords that the text holds are found once; a lambda variable keeps them.
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in KEYS]))

    def found(r):
        spans = find_spans(text, r["pattern"], r["label"], r["at"])
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"), (-r["priority"]).alias("level"),
            s["rank"].alias("at"), s["kind"].alias("label"),
        ))

    def of_rules(have):
        live = F.filter(rules, lambda r: F.forall(r["keywords"], lambda keys: F.arrays_overlap(keys, have)))
        return F.array_sort(F.flatten(F.transform(live, found)))

    return F.transform(F.array(held), of_rules)[0]


def _unsuppressed(found: Column) -> Column:
    """Detections outside every earlier one of their own or a higher priority.

    Sorted as they are, an interval is inside an earlier one exactly if that one ends no
    earlier; the farthest end so far is kept per priority.
    """
    levels = sorted(CONFIDENCE)

    def far(acc, p):
        return acc[f"far{p}"]

    def step(acc, d):
        inside = F.lit(False)
        for p in levels:
            inside = inside | ((-d["level"] == p) & (far(acc, p) >= -d["back"]))
        ends = [
            F.when(-d["level"] >= p, F.greatest(far(acc, p), -d["back"])).otherwise(far(acc, p)).alias(f"far{p}")
            for p in levels
        ]
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(d)))
        return F.struct(*ends, out.alias("out"))

    start = F.struct(*[F.lit(-1).alias(f"far{p}") for p in levels], F.array().cast(f"array<{DETECTION}>").alias("out"))
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: list[Rule] = RULES, out: str = "licenses", text: str = "text") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, base (spans), found (detections that stand)."""
    given = docs.columns
    body, low, base = fresh(docs, "_body", "_low", "_base")
    rows = docs.withColumn(body, whole_text(text))
    rows = rows.withColumn(low, F.regexp_replace(F.lower(body), r"[^\S ]\s*| \s+", " "))

    def holds(words):
        return reduce(lambda a, b: a | b, [F.contains(F.col(low), F.lit(k)) for k in words])

    general = holds([k for k in GENERAL if k != UNDER]) | (holds([UNDER]) & holds(VERBS))
    rows = rows.withColumn(base, _base_spans(F.col(body)))
    none = F.array().cast(f"array<{DETECTION}>")
    found = F.when(general, _unsuppressed(_detections(F.col(body), F.col(low), _rule_table(rules)))).otherwise(none)
    n_words = F.regexp_count(F.col(body), F.lit(f"{_IN_WORD}+")).cast("long")
    return rows.select(
        *[F.col(f"`{c}`") for c in given],
        F.struct(n_words.alias("n_words"), F.col(base).alias("base"), found.alias("found")).alias(out),
    )


def _word_at(text: Column, start: Column) -> Column:
    """Number of words before a word's start."""
    return F.regexp_count(F.substring(text, F.lit(1), start), F.lit(f"{_IN_WORD}+")).cast("long")


@query()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    rows = scan(docs).select("doc_id", "text", "licenses.*")
    any_ = F.size("base") > 0
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda s: s["kind"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("found", lambda d: d["label"])))
    sure = F.array_max(F.transform("found", lambda d: F.element_at(
        F.array(*[F.lit(CONFIDENCE[p]) for p in sorted(CONFIDENCE)]), -d["level"])))
    from_base = F.when(any_, BASE_CONFIDENCE).otherwise(0.0)
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.when(any_, _word_at(F.col("text"), F.element_at("base", 1)["start"])).alias("first_word"),
        F.when(any_, _word_at(F.col("text"), F.element_at("base", -1)["start"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(from_base, F.coalesce(sure, F.lit(0.0))).alias("score"),
        F.size("found").alias("n_found"),
    )
