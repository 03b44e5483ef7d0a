"""Spans of regular-expression matches as column expressions, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays of spans sort by start, then by the rank of the rule.
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def find_spans(
    text: Column, pattern: Column | str, kind: Column | str, rank: Column | int, group: int = 0, least: int = 1
) -> Column:
    """All leftmost non-overlapping matches of ``pattern``; a match whose ``group`` is shorter
    than ``least`` characters is dropped, and the search goes on behind it.

    What lies between the matches comes from a split, the matches from an extraction; a
    running sum of both lengths gives the places. Texts without a match skip that.
    """
    lit, kind, rank = (x if isinstance(x, Column) else F.lit(x) for x in (pattern, kind, rank))
    gaps, found = F.split(text, lit, -1), F.regexp_extract_all(text, lit, F.lit(0))
    inner = found if group == 0 else F.regexp_extract_all(text, lit, F.lit(group))
    steps = F.zip_with(
        F.slice(F.transform(gaps, F.length), 1, F.size(found)),
        F.zip_with(F.transform(found, F.length), F.transform(inner, F.length), lambda a, b: F.struct(
            a.alias("whole"), b.alias("inner"))),
        lambda gap, m: F.struct(gap.alias("gap"), m["whole"].alias("whole"), m["inner"].alias("inner")),
    )

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["whole"]
        span = F.struct(
            start.alias("start"), rank.alias("rank"), end.alias("end"), kind.alias("kind")
        )
        more = F.when(x["inner"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))
    all_ = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, lit), all_).otherwise(no_spans())


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in the order of the array."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def mask_spans(text: Column, spans: Column, marker: str) -> Column:
    """``text`` with every stretch covered by sorted ``spans`` replaced by one marker."""

    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit(marker))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), new.alias("out"))

    def finish(acc):
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))
