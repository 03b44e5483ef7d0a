"""Document fingerprints: Order MinHash over k-mers of words.

A text is a sequence of k-mers (``K`` words from every word on; the last ones are shorter). Each gets
its occurrence number, so that a repeated k-mer counts as often as it stands there. A hash of both
deals all k-mers to ``BUCKETS`` and ranks them inside. From every bucket the ``TUPLE`` k-mers of
least rank are taken, put back into their order in the text, and hashed together. A component
thus changes when its k-mers change or swap places, which makes the share of equal components
follow the edit distance, not only the common content.

All of it are array expressions on the row: one sort for occurrences (only where a k-mer repeats) and
one sort by rank, with the position packed into the low bits.

``op2_...`` also needs each document's successor. Ids alone are ranged and numbered; a text
then moves once, to meet the beginning of its successor.

Defined results: null text is empty. Texts without words have an empty fingerprint; two of these are
alike (1.0), one of these and another text are not (0.0). A null id counts as the lowest.
Where several rows share an id, the successor's text is the one whose needed beginning sorts
first, and its fingerprint the lowest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, query, table, whole_text

K = 2
TUPLE = 2
BUCKET_BITS = 5
BUCKETS = 1 << BUCKET_BITS
SPACES = r"[\x20\x09-\x0D]+"


def _left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def _right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _bucket(packed: Column) -> Column:
    return F.shiftright(packed, 64 - BUCKET_BITS)


def _kmers(words: Column) -> Column:
    """Hash of the k-mer from every word on."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, K)]))


def _packed(hash_: Column, occurrence: Column, at: Column, bits: Column) -> Column:
    """Rank hash of an occurrence-numbered k-mer, with its place in the low ``bits``."""
    rank = F.xxhash64(hash_, occurrence)
    return F.coalesce(_left(_right(rank, bits), bits).bitwiseOR(at.cast("bigint")), F.lit(0).cast("bigint"))


def _numbered(ordered: Column, bits: Column) -> Column:
    """Packed k-mers of a text in which some repeat. ``ordered`` holds (hash, place), sorted: equal
    k-mers are runs, and a k-mer's number is its place in the run."""
    n = F.size(ordered)
    hash_at = lambda j: F.get(ordered, j)["hash"]
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (hash_at(j) != hash_at(j - 1)))

    def with_starts(s: Column) -> Column:
        run = lambda a, i: F.transform(
            F.sequence(a, F.coalesce(F.get(s, i + 1), n) - 1),
            lambda j: _packed(hash_at(j), j - a, F.get(ordered, j)["at"], bits),
        )
        return F.flatten(F.transform(s, run))

    return F.transform(F.array(starts), with_starts)[0]


def _components(kmers: Column, selected: Column, bits: Column) -> Column:
    """One number per filled bucket: the bucket and a 32-bit hash of its k-mers in text order."""
    place = lambda x: x.bitwiseAND(_left(F.lit(1).cast("bigint"), bits) - 1).cast("int")

    def of(x: Column, j: Column) -> Column:
        first = (j == 0) | (_bucket(F.get(selected, j - 1)) != _bucket(x))
        mates = [F.when(_bucket(F.get(selected, j + d)) == _bucket(x), place(F.get(selected, j + d))) for d in range(1, TUPLE)]
        in_order = F.array_sort(F.array_compact(F.array(place(x), *mates)))
        tuple_ = F.xxhash64(F.transform(in_order, lambda p: F.get(kmers, p)))
        low = tuple_.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(first, F.shiftleft(_bucket(x) + BUCKETS // 2, 32).bitwiseOR(low))

    return F.array_compact(F.transform(selected, of))


def fingerprint_components(df: DataFrame, out: str, text: str) -> DataFrame:
    """``df`` with ``out``: the fingerprint of column ``text`` as an array of numbers.

    Every step is a column that the next one names more than once, so that Spark keeps the
    steps apart instead of working one out again for each array element.
    """
    given = [F.col(f"`{c}`") for c in df.columns]
    w, k, s, p, b, c = fresh(df, "_w", "_k", "_s", "_p", "_b", "_c")
    words = F.filter(F.split(whole_text(text), SPACES), lambda x: x != "")
    df = df.select(*given, words.alias(w))
    df = df.select(*given, _kmers(F.col(w)).alias(k), F.ceil(F.log2(F.size(w) + 2.0)).cast("int").alias(b))
    repeats = F.size(F.array_distinct(k)) < F.size(k)
    ordered = F.when(repeats, F.array_sort(F.transform(k, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))))
    df = df.select(*given, k, b, ordered.alias(s))
    plain = F.transform(k, lambda h, i: _packed(h, F.lit(0), i, F.col(b)))
    packed = F.when(F.size(s) > 0, _numbered(F.col(s), F.col(b))).otherwise(plain)
    df = df.select(*given, k, b, F.sort_array(packed).alias(p))
    least = F.filter(p, lambda x, j: (j < TUPLE) | (_bucket(F.get(F.col(p), j - TUPLE)) != _bucket(x)))
    df = df.select(*given, k, b, F.when(F.size(p) > 0, least).otherwise(F.array().cast("array<bigint>")).alias(c))
    return df.select(*given, _components(F.col(k), F.col(c), F.col(b)).alias(out))


def fingerprint_text(components: Column) -> Column:
    return F.array_join(F.transform(components, lambda x: F.lower(F.hex(x))), "-")


def likeness(a: Column, b: Column) -> Column:
    """Equal components among the buckets that either text fills, from 0 to 1."""
    buckets = lambda c: F.transform(c, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(buckets(a), buckets(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def successors(ids: DataFrame) -> DataFrame:
    """(key, next) for every distinct ``key``: the next greater one, after the last the first.

    Keys are dealt out by range and looked up inside their range; the last of a range follows
    on to the first of the next. Only one row per range meets in one place.
    """
    distinct = ids.select("key").distinct()
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(distinct.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    edges = ranged.groupBy("part").agg(F.min("key").alias("low"))
    order = W.orderBy("part")
    after = F.coalesce(F.lead("low").over(order), F.first("low").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    edges = edges.select("part", after.alias("after"))
    inner = ranged.withColumn("next", F.lead("key").over(W.partitionBy("part").orderBy("key")))
    return inner.join(edges, "part").select("key", F.coalesce("next", "after").alias("next"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, key, next (key of the successor), text, n_chars and edited: the text whose last quarter
    is replaced by the beginning of its successor. A null id and the lowest number share a key."""
    lowest = F.lit(-(1 << 63))
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("key"), whole_text().alias("text"))
    need = own.groupBy("key").agg(F.max(F.floor(F.length("text") / 4)).alias("need"))
    follows = cut_lineage(successors(own).join(need, "key"))
    # Both joins deal the same two columns out by the same key, so Spark shuffles texts once
    # and reuses that.
    wanted = follows.select(F.col("next").alias("key"), F.col("key").alias("asks"), "need")
    begins = own.join(wanted, "key").select("asks", F.expr("substring(text, 1, cast(need as int))").alias("begin"))
    begins = begins.groupBy("asks").agg(F.min("begin").alias("begin"))
    both = own.join(begins, F.col("key") == F.col("asks")).join(follows.select("key", "next"), "key")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("begin"), F.lit(1), cut))
    doc_id = F.when(F.col("key") != lowest, F.col("key")).alias("doc_id")
    return both.select(doc_id, "key", "next", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))


@query()
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = edited_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    marked = texts.select("doc_id", "key", "next", "text", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    marked = fingerprint_components(fingerprint_components(marked, "own", "text"), "changed", "edited")
    rows = cut_lineage(marked.drop("text", "edited"))
    lowest = rows.groupBy(F.col("key").alias("next")).agg(F.min("own").alias("after"))
    joined = rows.join(lowest, "next")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("own")).alias("fingerprint"),
        fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
