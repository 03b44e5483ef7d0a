"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source has a target number of words: its weight's share of all words, at most
   ``MAX_REPEAT`` times the words it has; what lies above is shared out again by weight.
2. A source's documents are permuted by a hash and cut into blocks, ``MAX_BLOCKS`` at most. Its
   exact quota of block draws is as many whole passes over its blocks as the target holds and, in a
   permuted order, the blocks of a last partial pass. The block in which the target is reached
   gives its first documents and one that fills the gap, so a source ends very near its target.
3. A binary tree over the output shards splits the quotas of all sources: at each node the
   left half's share of every source is a draw from the multivariate hypergeometric distribution,
   so each shard looks like a random sample of the whole mix while every quota is met exactly.
4. Each shard takes the next, disjoint stretch of a source's permuted block draws and shuffles
   its documents locally.

The number of shards follows from the words of the mix (``SHARD_WORDS`` each), so a shard does not grow
with the corpus. Only sums per source and block leave the scan; a source that holds most rows is spread over
its blocks. Sources are a dimension: one row each, and one array element per tree node.

Defined results: null or empty text has size 0 and is never taken. A null source is a source of its
own, the last in order. Ties are ordered by id and size; rows equal in both are
interchangeable. Every random choice is an MD5 hash, so that reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, hash40, query, table, whole_text

WEIGHTS = [5, 2, 1]
MAX_REPEAT = 3
MAX_BLOCKS = 4096  # per source
MIN_DOCS = 32  # documents in a block, on average
SHARD_WORDS = 1 << 22  # words of the mix in a shard, on average
WORD = r"[^\x20\x09-\x0D]+"
SPREAD_LEVEL = 8  # of the tree: nodes below it are dealt out to all tasks
SPREAD = 8  # standard deviations of a draw that the inverse distribution covers


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int] = WEIGHTS) -> DataFrame:
    """Per source (source, size): rank, n_docs, source_size, target, blocks, passes, rest.

    Sources in ascending order of cap per weight: as long as the level that all remaining
    weights would share lies above a source's cap, that source is capped.
    """
    s = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", MAX_REPEAT * F.col("source_size"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = W.partitionBy(F.lit(0))
    s = s.withColumns({
        "before": F.sum("cap").over(by_cap) - F.col("cap"),
        "open": F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)),
        "total": F.sum("source_size").over(everything),
    })
    level = (F.col("total") - F.col("before")) / F.col("open")
    s = s.withColumn("level", F.when(level < F.col("cap") / F.col("weight"), level))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(
        by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level") * F.col("weight"))
    s = s.withColumn("target", F.coalesce(target, F.col("cap").cast("double")))
    blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.floor(F.col("n_docs") / MIN_DOCS)))
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    return s.select(
        "source", "rank", "n_docs", "source_size", "target", blocks.cast("long").alias("blocks"),
        passes.cast("long").alias("passes"),
        (F.col("target") - passes * F.col("source_size")).alias("rest"),
    )


def _place(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (source, size, u) with their source's columns and their block."""
    s = sources.withColumnRenamed("source", "_of")
    placed = rows.join(s, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    return placed.withColumn("block", F.shiftright(F.col("u") * F.col("blocks"), 40))


def _last_pass(placed: DataFrame) -> DataFrame:
    """Per block (rank, block): ``whole`` when the last pass takes all of it, ``room`` for how many
    words of it the last pass has room otherwise (0 or less: none)."""
    b = placed.groupBy("rank", "block", "rest").agg(F.sum("size").alias("words"))
    order = W.partitionBy("rank").orderBy(hash40(F.col("rank"), F.col("block")), "block")
    b = b.withColumn("room", F.col("rest") - (F.sum("words").over(order) - F.col("words")))
    return b.select("rank", "block", (F.col("words") <= F.col("room")).alias("whole"), "room")


def _cut(last: DataFrame) -> DataFrame:
    """The blocks, one per source at most, in which the target is reached."""
    return last.where(~F.col("whole") & (F.col("room") > 0))


def _cut_rows(placed: DataFrame, last: DataFrame) -> DataFrame:
    """Rows of the cut blocks that the last pass takes: (rank, block, u, _id, size, taken).

    Rows equal in all of these are interchangeable; ``taken`` says how many of them go.
    """
    # The last block gives documents in their order while they fit, then the one that comes
    # nearest to the gap, if that makes it smaller. Ids and sizes are ranked, never texts.
    key = ["rank", "block", "u", "_id", "size"]
    part = placed.join(_cut(last), ["rank", "block"]).select(*key, "room")
    of = W.partitionBy("rank")
    order = of.orderBy("u", "_id", "size")
    upto = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    part = part.withColumn("_upto", upto)
    part = part.withColumn("_fits", F.col("_upto") <= F.col("room"))
    used = F.coalesce(F.max(F.when(F.col("_fits"), F.col("_upto"))).over(of), F.lit(0))
    part = part.withColumn("_gap", F.col("room") - used)
    off = F.abs(F.col("size") - F.col("_gap"))
    nearest = F.row_number().over(of.orderBy("_fits", off, "u", "_id", "size")) == 1
    last_one = ~F.col("_fits") & nearest & (off < F.col("_gap"))
    part = part.withColumn("_goes", (F.col("_fits") | last_one).cast("int"))
    return part.groupBy(*key).agg(F.sum("_goes").alias("taken"))


def _copies(placed: DataFrame, last: DataFrame, cut_rows: DataFrame) -> DataFrame:
    """``placed`` with the number of times each row is taken: a whole number per row."""
    rows = placed.join(last, ["rank", "block"])
    cut = (~F.col("whole")) & (F.col("room") > 0)
    whole = rows.where(~cut).withColumn("copies", F.col("passes") + F.col("whole").cast("int"))
    key = ["rank", "block", "u", "_id", "size"]
    part = rows.where(cut).join(
        cut_rows.select(*[F.col(c).alias(f"_{c}_of") for c in key], "taken"),
        [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in key],
    )
    nth = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    part = part.withColumn("copies", F.col("passes") + (nth <= F.col("taken")).cast("int"))
    part = part.drop("taken", *[f"_{c}_of" for c in key])
    return whole.unionByName(part).withColumn(
        "copies", F.when(F.col("size") == 0, 0).otherwise(F.col("copies")).cast("long")
    )


# --- the splitting tree ---------------------------------------------------------------

def _hypergeometric(marked: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``total`` are in a draw of ``drawn``; ``u`` is uniform in [0, 1).

    Inverse distribution by the ratio of neighbouring probabilities, over all values within
    ``SPREAD`` standard deviations of the mean.
    """
    share = F.try_divide(marked, total)
    mean = drawn * share
    sd = F.sqrt(mean * (1 - share) * F.coalesce(F.try_divide(total - drawn, total - 1), F.lit(0.0)))
    lo = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean - SPREAD * sd) - 1).cast("long")
    hi = F.least(marked, drawn, F.ceil(mean + SPREAD * sd) + 1).cast("long")

    def ratio(x):
        return (marked - x) * (drawn - x) / ((x + 1.0) * (total - marked - drawn + x + 1))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    mass = F.aggregate(
        F.sequence(lo, hi), start,
        lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["sum"] + a["w"]).alias("sum")),
        lambda a: a["sum"],
    )
    begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), lo.alias("at"))
    found = F.aggregate(
        F.sequence(lo, hi), begin,
        lambda a, x: F.struct(
            (a["w"] * ratio(x)).alias("w"), (a["sum"] + a["w"]).alias("sum"),
            F.when(a["sum"] <= u * mass, x).otherwise(a["at"]).alias("at"),
        ),
        lambda a: a["at"],
    )
    return F.when((marked == 0) | (drawn == 0), F.lit(0).cast("long")).when(
        drawn == total, marked).otherwise(found)


def _left_half(node: Column, quotas: Column, left: Column) -> Column:
    """Per source the part of ``quotas`` that falls to the left child, which takes ``left`` in all.

    Source by source: a draw given what the earlier sources have left of both.
    """
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)
    start = F.struct(total.alias("total"), left.alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(a, q):
        u = hash40(node, F.size(a["out"])) / float(1 << 40)
        x = _hypergeometric(q, a["total"], a["left"], u)
        return F.transform(F.array(x), lambda d: F.struct(
            (a["total"] - q).alias("total"), (a["left"] - d).alias("left"),
            F.concat(a["out"], F.array(d)).alias("out"),
        ))[0]

    return F.aggregate(quotas, start, step, lambda a: a["out"])


def shard_count(sources: DataFrame) -> int:
    """The power of two that gives every shard ``SHARD_WORDS`` words of the mix at most, on average."""
    words = sources.agg(F.sum("target")).first()[0] or 0
    return 1 << max(0, math.ceil(words / SHARD_WORDS) - 1).bit_length()


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(rank, quota) -> (rank, shard, first, n): which stretch of a source's block draws each shard
    takes. ``shards`` is a power of two; shards differ by one block draw at most per level."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    nodes = quotas.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("quotas")
    ).withColumn("node", F.lit(1).cast("long"))
    for level in range(shards.bit_length() - 1):
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition(1 << level, "node")
        half = F.floor(F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q) / 2)
        nodes = nodes.withColumn("left", _left_half(F.col("node"), F.col("quotas"), half))
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"),
                     F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")),
        )
        nodes = nodes.select(F.explode(children).alias("c")).select("c.*")
    leaves = nodes.select((F.col("node") - shards).alias("shard"), F.posexplode("quotas").alias("rank", "n"))
    order = W.partitionBy("rank").orderBy("shard")
    return leaves.withColumn("first", F.sum("n").over(order) - F.col("n"))


def mixing_plan(placed: DataFrame, last: DataFrame, shards: int) -> DataFrame:
    """(rank, block, copy, shard): every block draw of the mix and the shard that takes it."""
    per_block = placed.select("rank", "block", "passes").distinct().join(last, ["rank", "block"])
    n = F.col("passes") + (F.col("whole") | (F.col("room") > 0)).cast("int")
    draws = per_block.withColumn("n", n).where("n > 0").select(
        "rank", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    )
    permuted = W.partitionBy("rank").orderBy(
        hash40(F.lit("draw"), F.col("rank"), F.col("block"), F.col("copy")), "block", "copy")
    draws = cut_lineage(draws.withColumn("at", F.row_number().over(permuted) - 1))
    quotas = draws.groupBy("rank").agg(F.count("*").alias("quota"))
    # Ranks without a draw have no place in the arrays, so arrays go by the order of those present.
    slots = quotas.withColumn("slot", F.row_number().over(W.orderBy("rank")) - 1)
    split = split_quotas(slots.select(F.col("slot").alias("rank"), "quota"), shards)
    taken = split.where("n > 0").select(
        F.col("rank").alias("slot"), "shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"),
    ).join(slots.select("slot", "rank"), "slot")
    return draws.join(taken, ["rank", "at"]).select("rank", "block", "copy", "shard")


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u) of every document: what the plan is made of."""
    text = whole_text()
    return docs.select(
        "doc_id", "source", word_count(text).alias("size"),
        hash40(F.col("doc_id"), F.md5(text.cast("binary"))).alias("u"),
    )


def takes(docs: DataFrame, weights: list[int] = WEIGHTS) -> DataFrame:
    """Per document: doc_id, size, source_size, target and copies, the times the mix is to take it.

    From the block sums alone, without a mix; ``counted`` counts in the mix itself.
    """
    rows = cut_lineage(_measured(docs))
    sources = cut_lineage(source_targets(rows, weights))
    placed = _place(rows, sources).withColumn("_id", F.col("doc_id"))
    last = cut_lineage(_last_pass(placed))
    return _copies(placed, last, _cut_rows(placed, last))


def _dealt(docs: DataFrame, placed: DataFrame, sources: DataFrame, shards: int | None) -> DataFrame:
    """``docs``, each row once per copy, by shard and locally shuffled, from their measured rows."""
    last = cut_lineage(_last_pass(placed))
    shards = shards or shard_count(sources)
    plan = cut_lineage(mixing_plan(placed, last, shards))
    # The same expressions on the whole rows: no row needs an identity to be found again.
    given = docs.columns
    text = whole_text()
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in given]).alias("_doc"), F.col("doc_id").alias("_id"), "source",
        word_count(text).alias("size"), hash40(F.col("doc_id"), F.md5(text.cast("binary"))).alias("u"),
    )
    cut_rows = cut_lineage(_cut_rows(placed.withColumn("_id", F.col("doc_id")), last))
    taken = _copies(_place(own, sources), last, cut_rows).where("copies > 0")
    out = taken.join(plan, ["rank", "block"]).where("copy < copies")
    out = out.repartition(shards, "shard").sortWithinPartitions(
        "shard", hash40(F.lit("place"), F.col("u"), F.col("copy")), "_id")
    return out.select("_doc.*")


def mix(docs: DataFrame, weights: list[int] = WEIGHTS, shards: int | None = None) -> DataFrame:
    """The mix itself: ``docs``, each row once per copy, by shard and locally shuffled.

    The number of shards, a power of two, follows from the words of the mix unless it is given.
    """
    rows = cut_lineage(_measured(docs))
    sources = cut_lineage(source_targets(rows, weights))
    return _dealt(docs, _place(rows, sources), sources, shards)


def counted(docs: DataFrame, weights: list[int] = WEIGHTS, shards: int | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target and copies, counted in the finished mix.

    Rows equal in id, source and text are interchangeable and share their copies out. A row of the
    mix that is no document's shows up with a null target.
    """
    rows = cut_lineage(_measured(docs))
    sources = cut_lineage(source_targets(rows, weights))
    placed = _place(rows, sources)
    mixed = cut_lineage(_dealt(docs, placed, sources, shards))
    key = ["doc_id", "source", "size", "u"]
    given = placed.select(*key, "source_size", "target", F.lit(1).alias("rows"), F.lit(0).alias("drawn"))
    drawn = _measured(mixed).withColumns({
        "source_size": F.lit(None).cast("long"), "target": F.lit(None).cast("double"),
        "rows": F.lit(0), "drawn": F.lit(1),
    })
    both = given.unionByName(drawn).groupBy(*key).agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"),
        F.sum("rows").alias("rows"), F.sum("drawn").alias("drawn"),
    )
    n = F.greatest(F.col("rows"), F.lit(1))
    each = both.withColumn("n", n).withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    copies = F.expr("drawn div n") + (F.col("at") <= F.col("drawn") % F.col("n")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", copies.alias("copies"))


_TWIN = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST(concat('0x', substr(md5(concat_ws(chr(31), CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 10)) AS BIGINT) AS u
  FROM documents),
s0 AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
s1 AS (SELECT *, list_extract([{', '.join(map(str, WEIGHTS))}], CAST(rank % {len(WEIGHTS)} + 1 AS INT)) AS weight,
    {MAX_REPEAT} * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, CAST(sum(cap) OVER (ORDER BY cap / weight, rank) AS BIGINT) - cap AS before,
    CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM s1),
s3 AS (SELECT *, CASE WHEN (total - before) / open < cap / weight THEN (total - before) / open END AS own FROM s2),
s4 AS (SELECT *, first_value(own IGNORE NULLS) OVER (ORDER BY cap / weight, rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM s3),
s5 AS (SELECT *, CASE WHEN level * weight < cap THEN level * weight ELSE CAST(cap AS DOUBLE) END AS target,
    greatest(1, least({MAX_BLOCKS}, n_docs // {MIN_DOCS})) AS blocks FROM s4),
s AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM s5),
p AS (SELECT d.*, s.rank, s.source_size, s.target, s.passes, s.target - s.passes * s.source_size AS rest,
    (d.u * s.blocks) >> 40 AS block FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
b0 AS (SELECT rank, block, rest, CAST(sum(size) AS BIGINT) AS words FROM p GROUP BY ALL),
b AS (SELECT rank, block, words, rest - (CAST(sum(words) OVER (PARTITION BY rank ORDER BY
    CAST(concat('0x', substr(md5(concat_ws(chr(31), CAST(rank AS VARCHAR), CAST(block AS VARCHAR))), 1, 10)) AS BIGINT), block)
    AS BIGINT) - words) AS room FROM b0),
t0 AS (SELECT p.*, b.words <= b.room AS whole, b.room,
    CAST(sum(size) OVER (PARTITION BY p.rank, p.block ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM p JOIN b ON p.rank = b.rank AND p.block = b.block),
t1 AS (SELECT *, room - coalesce(max(CASE WHEN upto <= room THEN upto END) OVER (PARTITION BY rank, block), 0) AS gap FROM t0),
t AS (SELECT *, row_number() OVER (PARTITION BY rank, block
    ORDER BY upto <= room, abs(size - gap), u, doc_id, size) AS nearest FROM t1)
SELECT doc_id, size, source_size, target, size * (passes +
  CASE WHEN whole THEN 1 WHEN room > 0 AND (upto <= room OR nearest = 1 AND abs(size - gap) < gap) THEN 1
    ELSE 0 END) AS taken
FROM t"""


@query(_TWIN)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = counted(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
