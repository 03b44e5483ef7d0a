"""License scan: base phrases, keyword gates and suppression against brute force."""

import random
import re

import pytest

from reviewmill.llm import license_scan as ls

SAMPLES = [
    "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: MIT",
    "SPDX-License-Identifier: GPL-2.0-or-later", "license = \"BSD-3-Clause\"", "mit  LICENSE--mit.license", "permit license",
    "MIT licenses", "the mit_license and MIT/License", "see https://www.gnu.org/licenses/gpl-3.0 for more",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "released into the public domain", "日本mit license",
    "apache license apache license", "EUPL 1.2 and MPL 2.0", "wonderful prose of no license",
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_base(text):
    words = WORD.findall(lowered(text))
    found = [
        (i, label) for phrase, label in ls.BASE.items() for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(found)


def brute_found(text):
    text, low = text or "", (text or "").lower()
    if not any(k in low for k in ls.GENERAL):
        return []
    found = [
        (m.start(), -m.end(), -r.priority, i, r.label) for i, r in enumerate(ls.RULES)
        if all(any(k in low for k in keys) for keys in r.keywords) for m in re.finditer(r.pattern, text, re.ASCII)
    ]
    out = []
    for d in sorted(found):
        if not any(o < d and o[0] <= d[0] and o[1] <= d[1] and o[2] <= d[2] for o in found):
            out.append(d)
    return out


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [*SAMPLES, " ".join(SAMPLES), "\n".join(reversed(SAMPLES)), None, "", "a"]
    return ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()


def test_base_places(scanned):
    for r in scanned:
        n, found = brute_base(r["text"])
        assert r["licenses"]["n_words"] == n
        assert [s["kind"] for s in r["licenses"]["base"]] == [label for _, label in found], r["text"]


def test_detections_equal_brute_force(scanned):
    for r in scanned:
        assert [tuple(d) for d in r["licenses"]["found"]] == brute_found(r["text"]), r["text"]


def test_query_places_and_labels(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*SAMPLES, None, ""])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in ls.op1_license_scan(spark, str(tmp_path)).collect():
        n, found = brute_base(dict(rows)[r["doc_id"]])
        places = [i for i, _ in found]
        assert (r["n_words"], r["n_base"]) == (n, len(found))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        base = {label for _, label in found}
        assert r["base_labels"] == ",".join(sorted(base))
        assert base <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_a_notice_silences_what_lies_inside(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    found = ls.scan(df).first()["licenses"]["found"]
    assert [(d["label"], -d["level"]) for d in found] == [("mit", 3)]


def test_rules_are_many_and_named():
    assert len(ls.RULES) > 300
    assert len({(r.label, r.form, r.pattern) for r in ls.RULES}) == len(ls.RULES)


def test_odd_rows(odd, none):
    out = ls.scan(odd, out="lic")
    assert out.columns == [*odd.columns, "lic"] and out.count() == odd.count()
    assert all(r["lic"]["n_words"] == brute_base(r["text"])[0] for r in out.collect())
    assert ls.scan(none, out="lic").collect() == []


def ungated(text):
    """All rules on the text, without any keyword."""
    found = sorted(
        (m.start(), -m.end(), -r.priority, i, r.label)
        for i, r in enumerate(ls.RULES) for m in re.finditer(r.pattern, text, re.ASCII)
    )
    return [d for d in found if not any(o < d and o[0] <= d[0] and o[1] <= d[1] and o[2] <= d[2] for o in found)]


def example(tree, rng):
    """A random text that the parsed pattern matches."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += rng.choice([chr(arg).lower(), chr(arg).upper()]) if chr(arg).isascii() else chr(arg)
        elif op == "ANY":
            out += "x"
        elif op == "IN":
            kind, value = rng.choice(arg)
            one = {"CATEGORY_SPACE": rng.choice(" \t\n\r"), "CATEGORY_WORD": "w"}.get(str(value))
            out += one or chr(value[0] if str(kind) == "RANGE" else value)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += "".join(example(inner, rng) for _ in range(rng.randint(low, min(high, low + 2))))
        elif op == "SUBPATTERN":
            out += example(arg[3], rng)
        elif op == "BRANCH":
            out += example(rng.choice(arg[1]), rng)
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_no_match_is_lost_to_a_keyword(spark):
    told = [
        "uses MPL v2.0", "MPLv2.0", "MPL version 2.0", "EPL v1.0", "MIT No Attribution", "licensed only under MIT",
        "distributed solely under MIT", "Unauthorized copying of this file", "released under\tMIT",
        "provided 'as-is', without any express or implied warranty", "This software is provided 'as-is', without any express or implied warranty",
        "released  under the\r\n MIT", "GNU General\n  Public License v2", "CC\tBY 4.0", "all rights\nreserved, (c) us, all  rights\treserved",
    ]
    rng = random.Random(5)
    made = [example(re._parser.parse(r.pattern), rng) for r in ls.RULES for _ in range(4)]
    texts = [f"{before}{t}{after}" for t in [*told, *made] for before, after in [("", ""), ("prose ", " more.")]]
    rows = ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    for r in rows:
        assert [tuple(d) for d in r["licenses"]["found"]] == ungated(r["text"]), r["text"]
    assert sum(bool(r["licenses"]["found"]) for r in rows) > 0.9 * len(rows)


@pytest.mark.parametrize(("text", "label", "found"), [
    ("Apache License 2.1", "apache-2.0", False), ("Apache License, Version 2.0", "apache-2.0", True),
    ("under the Apache License 2.0.", "apache-2.0", True), ("the GPL 3.5", "gpl-3.0", False),
    ('"license": "MIT"', "mit", True), ("license: MIT.", "mit", True), ("licenses: [MIT]", "mit", True),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "mit", True), ("license: MIT.x", "mit", False),
])
def test_versions_and_metadata_fields(text, label, found):
    rules = [r for r in ls.build_rules() if r.label == label]
    assert rules and any(re.search(r.pattern, text, re.ASCII) for r in rules) == found
