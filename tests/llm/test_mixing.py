"""Mixing: exact quotas, disjoint draws, targets and the SQL twin."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from reviewmill.llm import mixing as mx
from reviewmill.llm.common import REGISTRY, SQL

SF = "/root/testdata/sf0.001"


def level(sizes, weights):
    """Targets by resharing until none is above three times its size."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(3 * sizes[i] for i in capped)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] >= 3 * sizes[i]}
        if not over:
            return [share.get(i, 3 * sizes[i]) for i in range(len(sizes))]
        capped |= over


def test_twin_on_documents(spark):
    assert compare(REGISTRY["op3_mix_sources"](spark, SF), connect(SF), SQL["op3_mix_sources"]) is None


@pytest.mark.parametrize("sizes", [[10, 1000, 500, 3], [5, 5, 5], [1000, 1, 1, 1, 1, 2000], [7, 0, 0, 9]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "source string, size long")
    got = [r["target"] for r in mx.source_targets(df).orderBy("rank").collect()]
    want = level(sizes, [mx.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def many(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("id") * 37 % 23 + 1).cast("int")), lambda x: F.lit("w")), " ")
    source = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string")))
    return spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"))


def test_sources_come_near_their_targets(many):
    taken = mx.takes(many)
    per = taken.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.first("target").alias("target")).collect()
    assert all(abs(r["got"] - r["target"]) <= 12 for r in per)
    assert taken.agg(F.max("copies")).first()[0] <= mx.MAX_REPEAT


def test_the_mix_holds_every_taken_copy(many):
    want = Counter({r["doc_id"]: r["copies"] for r in mx.takes(many).where("copies > 0").collect()})
    mixed = mx.mix(many, shards=8).withColumn("p", F.spark_partition_id()).collect()
    assert Counter(r["doc_id"] for r in mixed) == want
    # Every shard holds about its share of the hot source.
    hot, shard = Counter(), Counter()
    for r in mixed:
        shard[r["p"]] += 1
        hot[r["p"]] += r["source"] == "hot"
    overall = sum(hot.values()) / sum(shard.values())
    assert all(abs(hot[p] / n - overall) < 0.25 for p, n in shard.items() if n > 100)


def test_quotas_are_split_exactly(spark):
    quotas = {0: 1000, 1: 1, 2: 37, 3: 0, 4: 512}
    split = mx.split_quotas(spark.createDataFrame(list(quotas.items()), "rank int, quota long"), 16).collect()
    per_rank, per_shard = Counter(), Counter()
    for r in split:
        assert r["n"] >= 0
        per_rank[r["rank"]] += r["n"]
        per_shard[r["shard"]] += r["n"]
    assert dict(per_rank) == quotas
    assert max(per_shard.values()) - min(per_shard.values()) <= 4
    stretches = sorted((r["rank"], r["first"], r["n"]) for r in split if r["n"])
    for (rank, first, n), (rank2, first2, _) in zip(stretches, stretches[1:]):
        assert rank != rank2 or first + n == first2


def test_draws_follow_the_distribution(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    draw = u.select(mx._hypergeometric(F.lit(30), F.lit(100), F.lit(40), F.col("u")).alias("x"))
    got = draw.agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.min("x"), F.max("x")).first()
    assert got["mean"] == pytest.approx(12, abs=0.05)
    assert got["var"] == pytest.approx(40 * 0.3 * 0.7 * 60 / 99, rel=0.03)


def test_reruns_agree(many):
    rows = lambda: sorted(map(tuple, mx.takes(many).select("doc_id", "copies").collect()))
    assert rows() == rows()


def test_odd_rows(odd, none):
    taken = mx.takes(odd)
    assert taken.count() == odd.count()
    assert taken.where("size = 0 and copies > 0").count() == 0
    mixed = mx.mix(odd, shards=4)
    assert mixed.columns == odd.columns
    assert mixed.count() == taken.agg(F.sum("copies")).first()[0]
    assert mx.takes(none).collect() == [] == mx.mix(none, shards=4).collect()


def test_shards_are_a_power_of_two(spark):
    with pytest.raises(ValueError):
        mx.split_quotas(spark.createDataFrame([(0, 1)], "rank int, quota long"), 3)


def test_the_query_counts_in_the_finished_mix(spark, monkeypatch, tmp_path, many, odd):
    def rows(df):
        return Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["copies"]) for r in df.collect())

    assert rows(mx.counted(many, shards=8)) == rows(mx.takes(many))
    assert rows(mx.counted(odd, shards=4)) == rows(mx.takes(odd))
    many.write.parquet(f"{tmp_path}/documents.parquet")
    whole = Counter({r["doc_id"]: r["taken"] for r in mx.op3_mix_sources(spark, str(tmp_path)).collect()})
    # A plan that loses one block draw of the tree shows in the query.
    plan = mx.mixing_plan
    monkeypatch.setattr(mx, "mixing_plan", lambda *a: plan(*a).where("not (rank = 0 and block = 0 and copy = 0)"))
    less = Counter({r["doc_id"]: r["taken"] for r in mx.op3_mix_sources(spark, str(tmp_path)).collect()})
    assert set(less) == set(whole) and sum(less.values()) < sum(whole.values())


@pytest.mark.parametrize("words", [0, 1, 999, 1000, 1001, 7000, 64001])
def test_shards_follow_from_the_words(spark, monkeypatch, words):
    monkeypatch.setattr(mx, "SHARD_WORDS", 1000)
    sources = mx.source_targets(spark.createDataFrame([("a", words), ("b", 0)], "source string, size long"))
    n = mx.shard_count(sources)
    assert n & (n - 1) == 0 and words <= 1000 * n and (n == 1 or words > 500 * n)


def test_a_mix_over_many_shards_and_repeated_rows(spark, monkeypatch, many):
    """Deep enough a tree for its nodes to be dealt out; every row five times over."""
    monkeypatch.setattr(mx, "SPREAD_LEVEL", 2)
    monkeypatch.setattr(mx, "SHARD_WORDS", 4000)
    five = many.where("doc_id < 600").crossJoin(spark.range(5).drop("id").withColumn("again", F.lit(1)))
    want = Counter()
    for r in mx.takes(five).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mx.mix(five).collect()) == +want
    got = Counter()
    for r in mx.counted(five).collect():
        got[r["doc_id"]] += r["copies"]
    assert got == want


def test_no_text_is_ranked(many):
    """The window that ranks a source's cut block sees ids and sizes only."""
    placed = mx._place(mx._measured(many), mx.source_targets(mx._measured(many))).withColumn("_id", F.col("doc_id"))
    assert set(mx._cut_rows(placed, mx._last_pass(placed)).columns) == {"rank", "block", "u", "_id", "size", "taken"}
