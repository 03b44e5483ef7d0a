"""Near-duplicates: a multi-index Hamming join over b-bit MinHash signatures.

Texts are lower-cased (A-Z), cut into words and turned into their set of 5-word shingles. A
signature has ``CHUNKS * SYMBOLS`` MinHash symbols of ``BITS`` bits; the signature distance of two
texts is the number of differing symbols. By the pigeonhole principle two signatures at distance
``MAX_DISTANCE`` or less agree in one chunk up to one symbol, so every chunk is written to the index
once per symbol left out, and all pairs within that distance meet under a key. A pair of texts
at a similarity of 0.85 or more is farther apart with a probability below 1e-5.

What meets is not paired off:

1. Rows with the same set of shingles are one node from the start.
2. Under each key every node is paired with the lowest node only, and these pairs are
   verified on full sets. That joins most groups of copies at a cost linear in their size.
3. Nodes that still share a key with a node of another group may hold a link that the lowest
   node did not show. Among those nodes, and only across groups, an exact prefix filter finds
   the pairs to verify: a link of similarity 0.85 needs a common shingle among the rarest 15 %
   of either side's, and parity maps of the sets that differ in few places. No key, bucket or
   group is capped.

Groups are the connected components of the verified links (alternating large and small stars).
Sets of shingles are held as 64-bit hashes.

Defined results: null, empty or blank text has an empty set, is linked with nothing and kept.
Fewer than five words are one shingle. A null id takes part; a component of null ids only
has a null id. Rows that repeat an id and text share one result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WordHasher, fresh, mix64, query, table, whole_text

WIDTH = 5  # words in a shingle
NUM, DEN = 85, 100  # linked when DEN * intersection >= NUM * union
CHUNKS, SYMBOLS, BITS = 13, 5, 12
MAX_DISTANCE = 2 * CHUNKS - 1  # at most one error in some chunk
LANES = 16  # 64-bit lanes of a set's parity map

SKETCH = "n_shingles long, digest string, chunks array<long>"
SET = "shingles array<long>, parity array<long>"


class Shingler:
    def __init__(self, seed: int = 815):
        rng = np.random.default_rng(seed)
        self.hasher = WordHasher()
        self.place = rng.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
        k = CHUNKS * SYMBOLS
        self.a = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(1, 2**63, k, dtype=np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes of a whole text."""
        words = self.hasher.words(text.encode("utf-8").lower())  # bytes: A-Z only
        n = len(words)
        if n == 0:
            return words
        width = min(n, WIDTH)
        total = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            total += words[i : n - width + 1 + i] * self.place[i]
        return np.unique(mix64(total))

    def chunks(self, shingles: np.ndarray) -> list[int]:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 4096):  # bounds the memory of a long text
            block = shingles[at : at + 4096, None] * self.a + self.b
            np.minimum(least, block.min(axis=0), out=least)
        symbols = (mix64(least) >> np.uint64(64 - BITS)).reshape(CHUNKS, SYMBOLS)
        shifts = np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(BITS)
        return (symbols << shifts).sum(axis=1, dtype=np.uint64).astype(np.int64).tolist()

    def parity(self, shingles: np.ndarray) -> list[int]:
        """Bit i tells whether an odd number of shingles fall on place i."""
        places = (shingles >> np.uint64(40)).astype(np.int64) % (64 * LANES)
        odd = np.bincount(places, minlength=64 * LANES).astype(np.uint8) & 1
        return np.packbits(odd).view(np.int64).tolist()


def _sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    s = Shingler()
    with np.errstate(over="ignore"):
        for texts in batches:
            rows = []
            for t in texts:
                x = s.shingles(t)
                if len(x):
                    rows.append((len(x), xxhash.xxh3_128_hexdigest(x.tobytes()), s.chunks(x)))
                else:
                    rows.append((0, None, None))
            yield pd.DataFrame(rows, columns=["n_shingles", "digest", "chunks"])


def _sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    s = Shingler()
    with np.errstate(over="ignore"):
        for texts in batches:
            sets = [s.shingles(t) for t in texts]
            yield pd.DataFrame({
                "shingles": pd.Series([x.astype(np.int64) for x in sets], dtype=object),
                "parity": pd.Series([s.parity(x) for x in sets], dtype=object),
            })


def index_keys(chunks: Column) -> Column:
    """One key per chunk and symbol left out: equal for chunks that differ there only."""
    symbol = (1 << BITS) - 1

    def of(value, place):
        left_out = [value.bitwiseAND(F.lit(~(symbol << (BITS * d)))) for d in range(SYMBOLS)]
        return F.array(*[F.xxhash64(place, F.lit(d), v) for d, v in enumerate(left_out)])

    return F.flatten(F.transform(chunks, of))


def signature_distance(a: Column, b: Column) -> Column:
    symbol = (1 << BITS) - 1

    def errors(x, y):
        diff = x.bitwiseXOR(y)
        lanes = [(diff.bitwiseAND(F.lit(symbol << (BITS * d))) != 0).cast("int") for d in range(SYMBOLS)]
        return sum(lanes[1:], lanes[0])

    return F.aggregate(F.zip_with(a, b, errors), F.lit(0), lambda s, x: s + x)


def _similar(common: Column, a: Column, b: Column) -> Column:
    return DEN * common >= NUM * (a + b - common)


def _parity_fits(a: Column, b: Column, n: Column) -> Column:
    """Exact: sets that differ in few shingles differ in no more places of their parity maps.
    ``n`` is the sum of both sizes; similar sets differ in ``n * (DEN - NUM) / (DEN + NUM)`` at most."""
    differing = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(LANES)]
    return (DEN + NUM) * sum(differing[1:], differing[0]) <= (DEN - NUM) * n


def _sizes_fit(a: Column, b: Column) -> Column:
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (low, node) whose signatures are near and whose full sets are similar."""

    def of(side: str, *cols: str) -> DataFrame:
        return sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols])

    near = (
        pairs.join(of("low", "n", "chunks", "parity"), "low").join(of("node", "n", "chunks", "parity"), "node")
        .where(_sizes_fit(F.col("n_low"), F.col("n_node")))
        .where(_parity_fits(F.col("parity_low"), F.col("parity_node"), F.col("n_low") + F.col("n_node")))
        .where(signature_distance(F.col("chunks_low"), F.col("chunks_node")) <= MAX_DISTANCE)
        .select("low", "node", "n_low", "n_node")
    )
    both = near.join(of("low", "shingles"), "low").join(of("node", "shingles"), "node")
    common = F.size(F.array_intersect("shingles_low", "shingles_node"))
    return both.where(_similar(common, F.col("n_low"), F.col("n_node"))).select("low", "node")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (low, node) of different labels that an exact prefix filter cannot rule out.

    In the order from rare to frequent, two similar sets share one of the first
    ``n - ceil(0.85 n) + 1`` shingles of each. A shingle that a single set has cannot be shared,
    so it only uses up the prefix.
    """
    shingles = nodes.join(sets.select("node", "n", "shingles"), "node").select(
        "node", "label", "n", F.explode("shingles").alias("shingle")
    )
    shared = shingles.groupBy("shingle").agg(
        F.count("*").alias("df"), (F.min("label") < F.max("label")).alias("mixed")
    ).where(F.col("df") > 1)
    kept = shingles.join(shared, "shingle")
    by_node = W.partitionBy("node")
    prefix = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    rare = (
        kept.withColumn("at", F.row_number().over(by_node.orderBy("df", "shingle")))
        .withColumn("at", F.col("at") + F.col("n") - F.count("*").over(by_node))
        .where((F.col("at") <= prefix) & F.col("mixed"))
        .join(sets.select("node", "parity"), "node")
        .select("shingle", "node", "label", "n", "at", "parity")
    )
    a, b = rare.alias("a"), rare.alias("b")
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    need = F.ceil((F.col("a.n") + F.col("b.n")) * NUM / (NUM + DEN))
    return (
        a.join(b, (F.col("a.shingle") == F.col("b.shingle"))
               & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
               & _sizes_fit(F.col("a.n"), F.col("b.n")) & (left + 1 >= need)
               & _parity_fits(F.col("a.parity"), F.col("b.parity"), F.col("a.n") + F.col("b.n")))
        .select(F.col("a.node").alias("low"), F.col("b.node").alias("node"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (low, node); a component is its lowest node.

    Alternating large-star and small-star steps: few rounds even for long chains, and no node's
    neighbours are gathered in one place.
    """

    def largest_first(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("low", "node").alias("u"), F.least("low", "node").alias("v")).where("u != v")

    def stars(e: DataFrame, large: bool) -> DataFrame:
        around = e.union(e.select("v", "u")) if large else e
        least = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        linked = around.join(least, "u")
        if large:
            return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return down.union(least.select("u", F.col("m").alias("v"))).distinct()

    e, before = cut_lineage(largest_first(edges).distinct()), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, e = state, cut_lineage(stars(stars(e, True), False))
    lows = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(lows)


def _links(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """All verified links that the components need, as (low, node)."""
    wanted = members.select("node").distinct().join(
        classes.select("node", "rep", F.col("n_shingles").alias("n"), "chunks"), "node"
    )
    own = docs.select("doc_id", "text", "text_hash")
    texts = own.join(
        wanted,
        own["doc_id"].eqNullSafe(wanted["rep.doc_id"]) & (own["text_hash"] == wanted["rep.text_hash"]),
    ).dropDuplicates(["doc_id", "text_hash", "node"])
    made = texts.select("node", "n", "chunks", F.pandas_udf(_sets, SET)("text").alias("set"))
    sets = cut_lineage(made.select("node", "n", "chunks", "set.*"))

    star = members.where("node > low").select("low", "node").distinct()
    first = cut_lineage(_verified(star, sets))
    joined = components(first).withColumnRenamed("component", "label")
    labelled = members.select("key", "node").join(joined, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    unsettled = cut_lineage(
        labelled.join(open_keys.where("lo < hi").select("key"), "key").select("node", "label").distinct()
    )
    return first.union(_verified(_prefix_pairs(unsettled, sets), sets))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, digest) and classes (digest, rep, n_rows, component),
    both cut. ``docs`` has doc_id and a non-null text."""
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = cut_lineage(
        docs.select("doc_id", "text_hash", F.pandas_udf(_sketch, SKETCH)("text").alias("s")).select("doc_id", "text_hash", "s.*")
    )
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep")
    classes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        rep, F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"),
        F.first("chunks").alias("chunks"),
    )
    # Numbers are fixed by the write; they only need to be unique.
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    keys = classes.select("node", F.explode(index_keys(F.col("chunks"))).alias("key"))
    meeting = keys.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n"))
    members = cut_lineage(keys.join(meeting.where("n > 1").drop("n"), "key"))
    found = components(_links(docs, classes, members))
    whole = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rows, cut_lineage(whole.select("digest", "rep", "n_rows", "component"))


def _groups(classes: DataFrame) -> DataFrame:
    return classes.groupBy("component").agg(F.min("rep").alias("first"), F.sum("n_rows").alias("n_in"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept."""
    rows, classes = _grouped(docs.select("doc_id", whole_text().alias("text")))
    # Only groups of two rows or more need a look-up by digest.
    several = classes.join(_groups(classes).where("n_in > 1"), "component").select("digest", "first.doc_id")
    several = several.withColumnsRenamed({"digest": "of", "doc_id": "component_id"})
    out = rows.join(several, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns and one row of each group: the lowest id's."""
    given = docs.columns
    own, id_, hash_ = fresh(docs, "text_hash", "of_id", "of_hash")
    docs = docs.withColumn(own, F.xxhash64(whole_text()))
    rows, classes = _grouped(docs.select("doc_id", whole_text().alias("text")))
    groups = _groups(classes).where("n_in > 1").select("component", "first", "n_in")
    several = classes.join(groups, "component").select("digest", "first")
    marked = cut_lineage(
        rows.join(several, "digest").groupBy("doc_id", "text_hash").agg(
            F.count("*").alias("copies"),
            F.max(
                F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
            ).alias("stays"),
        )
    ).withColumnsRenamed({"doc_id": id_, "text_hash": hash_})
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_))
    once = docs.join(marked.where("not stays or copies > 1"), same, "left_anti")
    repeated = docs.join(marked.where("stays and copies > 1"), same, "left_semi").dropDuplicates(["doc_id", own])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in given])


@query()
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
