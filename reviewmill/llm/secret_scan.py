"""Secrets: regular expressions behind a trigram inverted index.

A Boolean query over trigrams is derived from every rule's pattern: literal stretches that each
match must hold, as an AND of ORs. The index lists, for each trigram that any query names, the
texts that hold it. Intersecting those lists leaves few texts per rule, and only these are
verified with the pattern. A rule without a mandatory trigram scans every text.

Postings name texts by a 64-bit hash. Copies of a text share one posting, combined before the
shuffle, and a hash collision only adds a candidate that verification turns down.

Defined results: a null text is empty and holds no secret. Every row is answered, repeated rows and
null ids included. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, query, table, whole_text
from .spans import find_spans, mask_spans, no_spans, spans_text


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # its least length


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_any_case, ["password", "passwd", "secret", "token"])) + "|" + (
    _any_case("api") + "_?" + _any_case("key")
)

# The three base rules.
BASE = [
    Rule("assign", f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),  # the whole runs of 24 or more
]
MORE = [
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("lab_token", "glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat_token", "xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("temporary_access", "ASIA[A-Z0-9]{16,}"),
    Rule("payment_key", "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("mail_key", "SG\\.[A-Za-z0-9_-]{16,}\\.[A-Za-z0-9_-]{16,}"),
    Rule("package_token", "npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{32,}"),
    Rule("hub_token", "hf_[A-Za-z0-9]{30,}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("storage_key", "AccountKey=[A-Za-z0-9+/=]{40,}"),
    Rule("bearer", "[Bb]earer\\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", "://[^\\s/:@]+:[^\\s/@]+@"),
]
RULES = BASE + MORE
MARKER = "[SECRET]"


# --- from patterns to trigram queries ----------------------------------------------

MAX_STRINGS = 64  # literal alternatives followed at once; beyond, they are closed into a clause
MAX_CLASS = 8


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


class _Clauses:
    """Walks a parsed pattern; ``now`` holds the literal strings that may end at this place."""

    def __init__(self):
        self.now, self.clauses = {""}, []

    def close(self) -> None:
        sets = {_trigrams(s) for s in self.now}
        if all(sets):
            self.clauses.append([s for s in sets if not any(o < s for o in sets)])
        self.now = {""}

    def extend(self, strings: set[str]) -> None:
        if len(self.now) * len(strings) > MAX_STRINGS:
            self.close()
        self.now = {a + b for a in self.now for b in strings}

    def walk(self, items) -> None:
        for op, arg in items:
            if op is sre.LITERAL:
                self.extend({chr(arg).lower()})
            elif op is sre.IN and len(arg) <= MAX_CLASS and all(o is sre.LITERAL for o, _ in arg):
                self.extend({chr(c).lower() for _, c in arg})
            elif op is sre.SUBPATTERN:
                self.walk(arg[-1])
            elif op is sre.BRANCH:
                self.branch(arg[1])
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1) and (exact := _exact(arg[2])):
                self.extend({"", *exact})
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                self.walk(arg[2])
                self.close()
            else:
                self.close()

    def branch(self, options) -> None:
        exact = [_exact(o) for o in options]
        if all(exact):
            self.extend(set().union(*exact))
            return
        self.close()
        each = [_clauses(o) for o in options]
        if all(each):  # one clause of each option: a match holds one of them
            self.clauses.append([s for found in each for s in found[0]])


def _exact(items) -> set[str] | None:
    """The strings that ``items`` matches, if they are few literals."""
    c = _Clauses()
    for op, _ in items:
        if op not in (sre.LITERAL, sre.IN, sre.SUBPATTERN, sre.BRANCH, sre.MAX_REPEAT):
            return None
    c.walk(items)
    least, most = sre_parse.SubPattern(sre_parse.State(), list(items)).getwidth()
    lengths = {len(s) for s in c.now}
    # As many characters as the pattern takes at least and at most: nothing was left out.
    return c.now if not c.clauses and (min(lengths), max(lengths)) == (least, most) else None


def _clauses(items) -> list[list[frozenset[str]]]:
    c = _Clauses()
    c.walk(items)
    c.close()
    return c.clauses


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of trigram sets, in lower case, that every match of ``pattern`` fulfils."""
    return _clauses(sre_parse.parse(pattern))


# --- index, candidates, verification -----------------------------------------------

def _query_rows(rules: list[Rule]) -> list[tuple[str, int, int, int, int, str]]:
    return [
        (r.kind, len(q), c, a, len(s), t)
        for r in rules for q in [trigram_query(r.pattern)]
        for c, clause in enumerate(q) for a, s in enumerate(clause) for t in sorted(s)
    ]


def trigram_postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """(trigram, text_hash): which texts hold which of ``trigrams``, ignoring case."""
    lowered = docs.select(F.xxhash64(whole_text(text)).alias("text_hash"), F.lower(whole_text(text)).alias("low"))
    held = [F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]
    rows = lowered.select("text_hash", F.explode(F.array_compact(F.array(*held))).alias("trigram"))
    return rows.distinct()


def candidates(postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """(text_hash, rules): per text the rules whose trigram query its postings fulfil."""
    spark = postings.sparkSession
    wanted = spark.createDataFrame(
        _query_rows(rules),
        "kind string, clauses int, clause int, option int, trigrams int, trigram string",
    )
    # The query table has a few rows per rule, whatever the data.
    hits = postings.join(F.broadcast(wanted), "trigram")
    options = hits.groupBy("text_hash", "kind", "clauses", "clause", "option", "trigrams").agg(
        F.count("*").alias("n")
    ).where(F.col("n") == F.col("trigrams"))
    met = options.groupBy("text_hash", "kind", "clauses").agg(F.count_distinct("clause").alias("n"))
    return met.where(F.col("n") == F.col("clauses")).groupBy("text_hash").agg(
        F.collect_set("kind").alias("kinds")
    )


def scan(docs: DataFrame, rules: list[Rule] = RULES, out: str = "spans", text: str = "text") -> DataFrame:
    """``docs`` with ``out``: the spans of all rules by start, then rule. Ids play no part."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    names = sorted({row[-1] for row in _query_rows(indexed)})
    found = candidates(trigram_postings(docs, names, text), indexed)
    own, body = fresh(docs, "_text_hash", "_body")
    given = docs.columns
    docs = docs.withColumn(body, whole_text(text)).withColumn(own, F.xxhash64(body))
    hash_, kinds = fresh(docs, "_found_hash", "_kinds")
    found = found.select(F.col("text_hash").alias(hash_), F.col("kinds").alias(kinds))
    rows = docs.join(found, F.col(own) == F.col(hash_), "left")
    parts = []
    for rank, r in enumerate(rules):
        spans = find_spans(F.col(body), r.pattern, r.kind, rank, r.group, r.least)
        if r in indexed:
            spans = F.when(F.array_contains(kinds, r.kind), spans)
        parts.append(F.coalesce(spans, no_spans()))
    return rows.select(*[F.col(f"`{c}`") for c in given], F.array_sort(F.concat(*parts)).alias(out))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in the text replaced by a marker; n_chars follows the text."""
    (spans,) = fresh(docs, "spans")
    given = docs.columns
    found = scan(docs, out=spans)
    masked = F.when(F.col("text").isNotNull(), mask_spans(F.col("text"), F.col(spans), MARKER))
    new = found.withColumn("text", masked)
    if "n_chars" in given:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        new = new.withColumn("n_chars", F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars")))
    return new.select(*[F.col(f"`{c}`") for c in given])


def _sql_kind(r: Rule, rank: int, name: str) -> str:
    """DuckDB: a list column of (start, rank, end, kind) of one base rule."""
    p = r.pattern.replace("'", "''")
    return f"""
  list_filter(list_transform(range(1, len({name}_m) + 1), lambda i: {{
    's': coalesce(list_sum(list_transform({name}_g[1:i], lambda x: length(x))), 0)
       + coalesce(list_sum(list_transform({name}_m[1:i-1], lambda x: length(x))), 0),
    'r': {rank},
    'n': length({name}_m[i]), 'inner': length({name}_i[i])}}), lambda x: x.inner >= {r.least}) AS {name}""", f"""
  regexp_extract_all(body, '{p}', 0) AS {name}_m, regexp_extract_all(body, '{p}', {r.group}) AS {name}_i,
  string_split_regex(body, '{p}') AS {name}_g"""


def _twin() -> str:
    lists, parts = zip(*[_sql_kind(r, i, f"k{i}") for i, r in enumerate(RULES)])
    names = "['" + "', '".join(r.kind for r in RULES) + "']"

    def joined(items: str) -> str:
        return f"""coalesce(array_to_string(list_transform(list_sort(list_transform({items},
    lambda x: {{'s': x.s, 'r': x.r, 'e': x.s + x.n}})),
    lambda x: concat({names}[x.r + 1], ':', CAST(x.s AS BIGINT), ':', CAST(x.e AS BIGINT))), ','), '')"""

    base = joined("list_concat(list_concat(k0, k1), k2)")
    every = "k0"
    for i in range(1, len(RULES)):
        every = f"list_concat({every}, k{i})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
m AS (SELECT doc_id, {', '.join(parts)} FROM d),
s AS (SELECT doc_id, {', '.join(lists)} FROM m)
SELECT doc_id, CAST(len(k0) AS BIGINT) AS n_assign, CAST(len(k1) AS BIGINT) AS n_access,
  CAST(len(k2) AS BIGINT) AS n_hex, sha256({base}) AS base_sha256, {joined(every)} AS spans
FROM s"""


@query(_twin())
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return found.select(
        "doc_id", *[count(r.kind) for r in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )
