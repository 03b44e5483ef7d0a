"""Personal data: fixed base rules, and a character-level BiLSTM-CRF for what they miss.

The tagger learns from labelled spans: addresses, numbers and look-alikes in many spellings, made
by a seeded generator and set into windows of a bounded sample of the documents. At scoring, a text
is read through overlapping windows, each decoded by Viterbi. The spans of all windows are then
reconciled over the whole text: of overlapping ones that stays which lies deepest inside its
window, so a span cut by a window's edge gives way to the whole one. Base spans stay as they are;
a tagged span that meets one, or that its kind's own check turns down, is dropped.

Every span must hold a digit or an @ sign, so windows without either cannot yield one and are not
decoded: no result depends on that.

Defined results: null text is empty and holds nothing. Every row is answered for itself; ids play no
part. Spans are code points, end exclusive.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .char_tagger import KINDS, Tagger, symbols, tag_of, tagged_spans
from .common import hash40, query, table, whole_text
from .spans import spans_text

WINDOW, STRIDE = 96, 48  # every stretch of 49 characters lies whole in some window
TRAIN_DOCS, TRAIN_WINDOWS, PER_DOC, EPOCHS = 400, 3200, 6, 5
BATCH = 256

_HINT = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


# --- base rules ---------------------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the @ signs so that long words cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ip_holds(part: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in part.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_holds(m[0])]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- labelled spans -----------------------------------------------------------------------

def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random, least: int = 2, most: int = 9) -> str:
    return "".join(rng.choice("aeiourstlnmdcpbgkhfvw") for _ in range(rng.randint(least, most)))


def _make(rng: random.Random, kind: int) -> str:
    if kind == 0:
        user = rng.choice([_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}{_number(rng, 2)}", f"{_word(rng)}_{_word(rng)}",
                           f"{_word(rng)}.{_number(rng, 2)}".capitalize()])
        host = ".".join([_word(rng)] * rng.randint(1, 2) + [rng.choice(["com", "org", "net", "de", "fr", "es", "example.com"])])
        return f"{user}{rng.choice(['@', '@', '@', ' @ ', '@ ', '(@)', '[@]'])}{host}"
    if kind == 1:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([".", ".", ".", "[.]", " . ", "(.)"]).join(parts)
    if kind == 2:
        digits = rng.choice("3456") + _number(rng, rng.choice([14, 14, 14, 11, 13]))
        digits += next(d for d in "0123456789" if luhn(digits + d))
        gap = rng.choice(["", "", " ", "-", ".", "/", "  "])
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, mid, end = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return rng.choice([
        f"+{rng.randint(1, 99)} ({area}) {mid}-{end}", f"+{rng.randint(1, 99)} {area} {mid} {end}", f"+1{area}{mid}{end}",
        f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"0{area}/{mid}{end}",
        f"00{rng.randint(10, 99)} {area} {mid}{end}", f"1-{area}-{mid}-{end}",
    ])


def _look_alike(rng: random.Random) -> str:
    return rng.choice([
        f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(0, 23)}:{rng.randint(10, 59)}",
        f"${rng.randint(1, 999)}.{_number(rng, 2)}", f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", _number(rng, rng.randint(1, 11)),
        "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"",
        f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", f"{_number(rng, 3)}-{_number(rng, 2)}", f"@{_word(rng)}",
        f"{rng.randint(1, 99)}%", f"{rng.randint(1, 9)},{_number(rng, 3)}", f"CC BY-NC {rng.randint(1, 4)}.0", f"version {rng.randint(1, 4)}.0.",
    ])


def training_windows(carriers: list[str], n: int = TRAIN_WINDOWS, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of ``n`` windows: carriers with spans and look-alikes set in."""
    rng = random.Random(seed)
    xs, ys = np.empty((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text = rng.choice(carriers) if carriers else " ".join(_word(rng) for _ in range(20))
        # What the carrier holds itself would be unlabelled.
        text = re.sub(r"[0-9@+]+", " ", text)[:WINDOW].ljust(WINDOW)
        spans = []
        for _ in range(rng.randint(0, 2)):
            kind = rng.choice([0, 1, 2, 3, None, None])
            piece = _look_alike(rng) if kind is None else _make(rng, kind)
            at = rng.randint(0, WINDOW)
            if any(s <= at <= e for s, e, _ in spans):
                continue
            gap = rng.choice([" ", " ", " ", "\n", ": "])
            moved = len(gap) + len(piece) + 1
            spans = [(s + moved * (s >= at), e + moved * (s >= at), k) for s, e, k in spans]
            tail = rng.choice([" ", " ", ",", ".", "\n"])
            text = text[:at] + gap + piece + tail + text[at:]
            if kind is not None:
                spans.append((at + len(gap), at + len(gap) + len(piece), kind))
        shift = rng.randint(0, max(0, len(text) - WINDOW))
        xs[row] = symbols(text[shift : shift + WINDOW], WINDOW)
        for s, e, kind in spans:
            s, e = max(0, s - shift), min(WINDOW, e - shift)
            if s < e:
                ys[row, s] = tag_of(kind, True)
                ys[row, s + 1 : e] = tag_of(kind, False)
    return xs, ys


def _carriers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = []
        for t in texts:
            rng = random.Random(len(t))
            starts = [rng.randint(0, max(0, len(t) - WINDOW)) for _ in range(PER_DOC)]
            out.append([t[s : s + WINDOW] for s in starts])
        yield pd.Series(out, dtype=object)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS) -> Tagger:
    """Tagger from windows anywhere in the ``train_docs`` texts lowest in a hash order."""
    text = whole_text()
    order = hash40(F.lit("pii"), F.col("doc_id"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(order, "doc_id").limit(train_docs)
    # At most train_docs ids: small enough to broadcast whatever the table holds.
    sample = docs.select("doc_id", text.alias("t")).join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("t").alias("t"))  # of several texts of an id the least
    rows = sample.select("doc_id", F.pandas_udf(_carriers, "array<string>")("t").alias("w")).orderBy("doc_id").collect()
    return Tagger().fit(*training_windows([w for r in rows for w in r["w"] if w.strip()], windows), EPOCHS)


# --- scoring ------------------------------------------------------------------------------

def _holds(kind: int, piece: str) -> bool:
    """The kind's own check of a tagged span."""
    d = _digits(piece)
    if kind == 0:
        user, _, host = piece.partition("@")
        return bool(re.search(r"[A-Za-z0-9]", user)) and re.search(r"[A-Za-z0-9-]\.[A-Za-z]{2,}", host) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", piece)
        return len(parts) == 4 and _ip_holds(".".join(parts)) and not re.search(r"[A-Za-z]", piece)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z]", piece)
    return 9 <= len(d) <= 15 and len(d) < len(piece) and not re.search(r"[A-Za-z]", piece)


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @ sign."""
    wanted, last = set(), max(0, -(-(len(text) - WINDOW) // STRIDE))
    for m in _HINT.finditer(text):
        # Window k covers [k * STRIDE, k * STRIDE + WINDOW).
        high = min(m.start() // STRIDE, last)
        wanted.update(range(max(0, (m.start() - WINDOW) // STRIDE + 1), high + 1))
    return [k * STRIDE for k in sorted(wanted)]


def reconcile(text: str, found: list[tuple[int, int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tagged spans (start, end, kind, window start) of all windows -> (start, kind, end), no two
    of which overlap each other or a base span; the one deepest in its window goes first."""
    def depth(s: tuple[int, int, int, int]) -> int:
        left = s[0] - s[3] if s[3] > 0 else WINDOW
        right = s[3] + WINDOW - s[1] if s[3] + WINDOW < len(text) else WINDOW
        return min(left, right)

    taken, out = [(s, e) for s, _, e in base], []
    for span in sorted(found, key=lambda s: (-depth(s), s)):
        start, end, kind, _ = span
        while start < end and text[start] in " \n\t,.;:":
            start += 1
        while end > start and text[end - 1] in " \n\t,.;:":
            end -= 1
        if any(s < end and start < e for s, e in taken):
            continue
        # A badly cut span must not silence the whole one of the next window.
        if _holds(kind, text[start:end]):
            taken.append((start, end))
            out.append((start, kind, end))
    return sorted(out)


def find_all(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Per text its base spans and the tagged ones, each (start, kind, end)."""
    base = [base_spans(t) if _HINT.search(t) else [] for t in texts]
    places = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(places), BATCH):
        part = places[at : at + BATCH]
        x = np.stack([symbols(texts[i][s : s + WINDOW], WINDOW) for i, s in part])
        for (i, s), tags in zip(part, tagger.decode(x)):
            if tags.any():
                size = min(WINDOW, len(texts[i]) - s)
                found[i] += [(s + a, s + min(b, size), k, s) for a, b, k in tagged_spans(tags) if a < size]
    return [(b, reconcile(t, f, b) if f else []) for t, f, b in zip(texts, found, base)]


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def scan(docs: DataFrame, tagger: Tagger, out: str = "pii") -> DataFrame:
    """``docs`` with a struct ``out``: base and tagged spans, each sorted by start, then kind."""

    def spans(rows: list) -> list[dict]:
        return [{"start": s, "rank": k, "end": e, "kind": KINDS[k]} for s, k, e in rows]

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            both = find_all(texts.tolist(), tagger)
            yield pd.DataFrame({
                "base": pd.Series([spans(b) for b, _ in both], dtype=object),
                "tagged": pd.Series([spans(t) for _, t in both], dtype=object),
            })

    return docs.withColumn(out, F.pandas_udf(find, f"base {_SPAN}, tagged {_SPAN}")(whole_text()))


@query()
def op6_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scan(docs, fit(docs)).select("doc_id", "pii.*")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("base", "tagged"))
    return rows.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(every).alias("spans"),
    )
