import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.functions import minhash as mh
from reviewmill.operators import cleaning, dedup, joins

BANDS, ROWS = mh.band_layout()
A, B = mh._family(128, 1)


def shingles(text):
    return {text[i:i + 3] for i in range(len(text) - 2)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def keys(text):
    sig = mh._signature(text, A, B, 3)
    return {(i, tuple(sig[i * ROWS:(i + 1) * ROWS])) for i in range(BANDS)}


def brute_force(texts, verify=False):
    """One row after the other against the rows kept so far."""
    prints, kept, matches = [keys(t) for t in texts], [], []
    for i, t in enumerate(texts):
        hits = [k for k in kept if prints[i] & prints[k]
                and (not verify or jaccard(t, texts[k]) >= 0.85)]
        matches += [(i, k) for k in hits]
        if not hits:
            kept.append(i)
    return kept, matches


def corpus(seed=3, n=120):
    """A third of the rows are near copies of one template; others vary word by word."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    template = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(n):
        if i % 3 == 0:
            texts.append(f"{template} {i}")
        elif i % 3 == 1 and texts:
            parts = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))))
    return [*texts, "", "ab", "ab", texts[0], texts[5]]


def frame(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "review_id bigint, content string").repartition(parts)


def ids(df):
    return sorted(r.review_id for r in df.select("review_id").collect())


def test_band_layout():
    assert (BANDS, ROWS) == (8, 16)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_greedy_equals_row_by_row(spark, parts):
    texts = corpus()
    kept, _ = brute_force(texts)
    assert 20 < len(kept) < len(texts) - 40
    assert ids(dedup.greedy_near_dedup(frame(spark, texts, parts))) == kept


def test_verified_equals_row_by_row(spark):
    texts = corpus(5)
    kept, _ = brute_force(texts, verify=True)
    assert ids(dedup.greedy_near_dedup(frame(spark, texts), verify=True)) == kept
    assert all(jaccard(texts[a], texts[b]) < 0.85 or not keys(texts[a]) & keys(texts[b])
               for a in kept for b in kept if a < b)


def test_matches_and_similarity(spark):
    texts = corpus(7)
    _, matches = brute_force(texts)
    rows = dedup.near_dup_matches(frame(spark, texts)).collect()
    assert sorted((r.review_id, r.kept_id) for r in rows) == matches
    for r in rows:
        assert r.jaccard == pytest.approx(jaccard(texts[r.review_id], texts[r.kept_id]))


def test_hot_buckets_take_the_split_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "MAX_HOT_KEYS", 64)
    texts = corpus(11)
    kept, matches = brute_force(texts)
    assert ids(dedup.greedy_near_dedup(frame(spark, texts))) == kept
    rows = dedup.near_dup_matches(frame(spark, texts)).collect()
    assert sorted((r.review_id, r.kept_id) for r in rows) == matches
    verified, _ = brute_force(texts, verify=True)
    assert ids(dedup.greedy_near_dedup(frame(spark, texts), verify=True)) == verified


def test_chain_keeps_first_and_third(spark):
    """A ~ B ~ C without A ~ C keeps A and C."""
    def state(rows):
        return spark.createDataFrame(rows, "id bigint, buckets array<binary>")

    prints = state([(1, [b"p"]), (2, [b"p", b"q"]), (3, [b"q"]), (4, [b"z"])])
    assert sorted(r.id for r in dedup._kept_ids(prints).collect()) == [1, 3, 4]


def test_short_texts_keep_the_first_only(spark):
    assert ids(dedup.greedy_near_dedup(frame(spark, ["ab", "x", "", "abcd efgh"]))) == [0, 3]


def test_signature_tracks_jaccard(spark):
    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("abcdefghijklmnop "), 900))
    errors = []
    for edits in (0, 10, 40, 100, 250):
        chars = list(base)
        for p in rng.choice(len(chars), edits, replace=False):
            chars[p] = "z"
        other = "".join(chars)
        same = np.mean(mh._signature(base, A, B, 3) == mh._signature(other, A, B, 3))
        errors.append(abs(same - jaccard(base, other)))
    assert max(errors) < 0.15


def test_long_texts_are_hashed_whole():
    text = "".join(chr(0x4E00 + i % 20000) for i in range(20000))
    tail = text + "tail end"
    assert (mh._signature(text, A, B, 3) >= mh._signature(tail, A, B, 3)).all()
    codes = mh._shingle_codes(tail, 3)
    assert len(codes) > mh._ROWS_PER_STEP
    whole = ((codes[None, :] * A[:, None] + B[:, None]) % mh.PRIME).min(axis=1)
    assert (whole == mh._signature(tail, A, B, 3)).all()


def test_band_keys_agree_with_fused_keys(spark):
    """Both ways put the same rows into the same buckets."""
    df = frame(spark, corpus(13))
    signed = df.select("review_id", mh.minhash_signature(F.col("content")).alias("s"))
    two = signed.select("review_id", F.posexplode(mh.band_keys("s", BANDS, ROWS)).alias("b", "k"))
    one = df.select("review_id", mh.minhash_bands(F.col("content"), BANDS, ROWS).alias("k")).select(
        "review_id", F.posexplode("k").alias("b", "k"))

    def groups(members):
        rows = members.groupBy("b", "k").agg(F.sort_array(F.collect_list("review_id")).alias("m"))
        return sorted((r.b, r.m) for r in rows.collect())

    assert groups(one) == groups(two)


def test_exact_dedup_keeps_lowest_id(spark):
    rows = [(5, "a"), (2, "a"), (9, "b"), (7, None), (8, None)]
    df = spark.createDataFrame(rows, "review_id bigint, content string")
    assert ids(cleaning.exact_dedup(df)) == [2, 7, 9]


def test_null_content_is_dropped_by_length(spark):
    rows = [(1, None), (2, "a b c d e"), (3, "a b c d e f")]
    df = spark.createDataFrame(rows, "review_id bigint, content string")
    assert ids(cleaning.length_filter(df)) == [3]


def test_verified_dedup_reads_its_rows_once(spark):
    """Cleaned texts are not cleaned again for the digests, the texts and the answer."""
    words = ["late", "driver", "map", "price", "crash", "refund", "slow", "login"]
    texts = [" ".join(words[(i * k) % 8] for k in range(3, 30)) + f" {i % 7}" for i in range(60)]
    rows = [(i, i % 5, t) for i, t in enumerate([*texts, *texts[:9], ""])] + [(None, 1, "no id"), (None, 1, texts[0])]
    df = spark.createDataFrame(rows, "review_id long, score long, content string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = dedup.greedy_near_dedup(df.mapInArrow(counted, df.schema), verify=True).collect()
    assert read.value == len(rows)
    kept, _ = brute_force([t for _, _, t in rows[:-2]], verify=True)
    assert sorted(r.review_id for r in got) == sorted(kept) and all(rows[r.review_id][1] == r.score for r in got)
