"""The pipeline: what each stage hands on, against plain versions on a small table."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from reviewmill.llm import byte_bpe, mixing, secret_scan

from .test_near_dup import brute as near_dup_groups

SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = lambda n: [f"word{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for i in range(240):
        text = words(rng.randint(60, 120))
        if i % 10 == 0:
            text = ["again"] * 80  # fails the base rule
        if i % 12 == 1:
            text = text + SECRET.split(" ")
        rows.append((i, " ".join(text), "en", f"s{i % 3}", None))
    rows += [(300 + i, rows[i + 1][1] + " tail", "en", "s0", 1) for i in range(0, 200, 7)]
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), rows[3]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mix", "tokens"]
    good = cp.keep_good(spark, docs, folder)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert good.columns == columns
    assert set(texts) == {r["doc_id"] for r in docs.collect() if r["text"] and "again" not in r["text"]}

    single = cp.one_of_each(spark, good, folder)
    want = near_dup_groups([(r["doc_id"], r["text"]) for r in good.collect()])
    assert single.columns == columns
    assert Counter(r["doc_id"] for r in single.collect()) == Counter({d for d, _, _, kept in want if kept})

    clean = cp.without_secrets(spark, single, folder)
    rows = clean.collect()
    assert clean.columns == columns and len(rows) == single.count()
    assert not any("04dbebab" in r["text"] for r in rows)
    assert sum(secret_scan.MARKER in r["text"] for r in rows) == sum("04dbebab" in r["text"] for r in single.collect()) > 0

    mix = cp.mixed(spark, clean, folder)
    copies = {r["doc_id"]: r["copies"] for r in mixing.takes(clean).where("copies > 0").collect()}
    assert mix.columns == columns and Counter(r["doc_id"] for r in mix.collect()) == Counter(copies)

    tokens = cp.encoded(spark, mix, folder).collect()
    assert len(tokens) == sum(copies.values()) and all(r["round_trip"] for r in tokens)
    assert all(r["n_tokens"] == len(r["ids"]) for r in tokens)


def test_run_equals_the_stages(spark, folder):
    once = lambda: Counter((r["doc_id"], r["n_tokens"]) for r in cp.run(spark, folder).collect())
    got = once()
    assert sum(got.values()) > 100 and got == once()


def test_empty_and_odd_tables(spark, odd, none, tmp_path):
    for df in (none, odd):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns
            out.count()
        assert cp.STAGES[-1][1](spark, df, "").count() == df.count()


def test_pipeline_reads_its_vocabulary_from_a_parameter():
    assert byte_bpe.VOCABULARY.endswith("byte_bpe_50k.tiktoken")
