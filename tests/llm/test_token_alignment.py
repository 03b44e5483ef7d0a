"""Alignment and pair counts against a plain byte-by-byte version."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import tokenizers

from reviewmill.llm import token_alignment as ta


@pytest.fixture(scope="module")
def plain_tokens():
    """text -> lists of (id, bytes) of both sides."""
    a = tokenizers.Tokenizer.from_file(ta.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.PIECE_BPE)
    alphabet = ta.byte_level_alphabet()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in ids], [(i, piece(i)) for i in b.encode(text)]

    return tokens


def plainly(rows, tokens):
    aligned, holders = [], defaultdict(set)
    for n, (_, text) in enumerate(rows):
        links, groups, x, y = Counter(), [], [], []
        if text:
            x, y = tokens(text)
            if not b"".join(t for _, t in x) == b"".join(t for _, t in y) == b" " + text.encode():
                x, y = [], []
        at_a = [i for i, (_, t) in enumerate(x) for _ in t]  # token of every byte
        at_b = [i for i, (_, t) in enumerate(y) for _ in t]
        for i, j in set(zip(at_a, at_b)):
            links[x[i][0], y[j][0]] += 1
        if x:
            starts = [k for k in range(len(at_a)) if k == 0 or (at_a[k] != at_a[k - 1] and at_b[k] != at_b[k - 1])]
            for s, e in zip(starts, [*starts[1:], len(at_a)]):
                groups.append(",".join(str(x[i][0]) for i in dict.fromkeys(at_a[s:e])) + "|"
                              + ",".join(str(y[i][0]) for i in dict.fromkeys(at_b[s:e])))
        for pair in links:
            holders[pair].add(n)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        aligned.append((len(x), len(y), len(groups), links, digest))
    top = defaultdict(int)
    for (i, _), docs in holders.items():
        top[i] = max(top[i], len(docs))
    out = []
    for (doc, _), (n_a, n_b, n_groups, links, digest) in zip(rows, aligned):
        best = sum(n for p, n in links.items() if len(holders[p]) == top[p[0]])
        out.append((doc, n_a, n_b, n_groups, sum(links.values()), best, sum(n * len(holders[p]) for p, n in links.items()), digest))
    return sorted(out, key=str)


def answers(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in ta.align_tokenizers(df).select(columns).collect()), key=str)


def some_texts(n):
    rng, words = random.Random(4), "the Tokenizers' über 日本語 <|endoftext|> <0x41> x=1; naïve 🙂🙂 \t\n  supercalifragilistic a▁b".split(" ")
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_equals_plain_version_in_many_blocks_and_rounds(spark, monkeypatch, plain_tokens):
    for name, value in (("BLOCK_DOCS", 5), ("BLOCK_RECORDS", 60), ("FAN_IN", 3), ("RADIX", 4)):
        monkeypatch.setattr(ta, name, value)
    rows = [*enumerate(some_texts(90)), (7, "the the the"), (None, "the naïve"), (200, None), (201, ""), (202, " "), (203, "a  b▁")]
    assert answers(spark.createDataFrame(rows, "doc_id long, text string")) == plainly(rows, plain_tokens)


def test_odd_rows(spark, odd, none, plain_tokens):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert answers(odd) == plainly(rows, plain_tokens)
    assert answers(none) == []


def test_query_on_whole_table(spark, plain_tokens):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = plainly(list(zip(t["doc_id"], t["text"])), plain_tokens)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r) for r in ta.op12_align_tokenizers(spark, sf).select(columns).collect()), key=str)
    assert got == want and sum(r[1] > 0 for r in got) > 100


def test_runs_round_trip_and_merge():
    rng = np.random.default_rng(2)
    runs, total = [], Counter()
    for _ in range(7):
        pairs = np.unique(rng.integers(0, 2**40, 50))
        counts = rng.integers(1, 9, len(pairs))
        total.update(dict(zip(pairs.tolist(), counts.tolist())))
        runs.append(ta.pack_pairs(pairs, counts))
    pairs, counts = ta.merge(runs)
    assert dict(zip(pairs.tolist(), counts.tolist())) == dict(total) and sorted(pairs.tolist()) == pairs.tolist()
    assert [len(x) for x in ta.unpack_pairs(ta.pack_pairs(pairs[:0], counts[:0]))] == [0, 0]


def test_highest_keeps_ties():
    pairs = np.array([1 << 32 | 5, 1 << 32 | 6, 2 << 32, 2 << 32 | 1, 2 << 32 | 9])
    assert ta.highest(pairs, np.array([3, 3, 1, 4, 2])).tolist() == [True, True, False, True, False]


def test_files_are_public_vocabularies():
    assert all(Path(p).is_file() for p in (ta.BYTE_BPE, ta.PIECE_BPE))


def test_quick_encoder_gives_the_same_ids():
    import duckdb

    aligner = ta.Aligner(Path(ta.BYTE_BPE).read_text("utf-8"), Path(ta.PIECE_BPE).read_bytes())
    rng = random.Random(9)
    below = [chr(c) for c in range(1, ord(ta.LATIN))]
    texts = ["".join(rng.choices(below, k=rng.randrange(1, 60))) for _ in range(3000)]
    texts += [f"{a}{c}{b}" for c in below for a, b in (("x", "y"), (" ", " "), ("1", "\n"), ("'s", " !"))]
    texts += [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    spaced = [" " + t for t in texts]
    want = [e.ids for e in aligner.a.encode_batch_fast(spaced, add_special_tokens=False)]
    assert aligner.quick is not None and aligner._byte_bpe(spaced) == want
