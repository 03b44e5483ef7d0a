"""Byte-level BPE against the library, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewmill.llm import byte_bpe as bpe

from .conftest import ODD_TEXTS


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def machine(ranks):
    return bpe.Utf8Machine({r: t for t, r in ranks.items()})


PIECES = st.sampled_from(["a", " the", "ing", "'s", "'ll", " ", "  ", "\n", "\r\n", "\x1c", "\xa0", "　", "日本", "🙂", "12", "Ⅷ", "!?", "<|endoftext|>", "é"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=25).map("".join)))
def test_equals_the_library(encoder, machine, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert machine.decode(ids) == text


def test_long_pieces(encoder, library):
    for text in ["x" * 3000, "ab" * 2000, "abcdefghij" * 300, "0" * 999]:
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_emptied_caches_change_nothing(ranks, library, monkeypatch):
    for name in ("MAX_STATES", "MAX_PAIRS", "MAX_TEXTS"):
        monkeypatch.setattr(bpe, name, 5)
    text = " ".join(t for t in ODD_TEXTS if t and len(t) < 200)
    e = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    assert e.encode(text) == library.encode_ordinary(text)
    m = bpe.Utf8Machine({r: t for t, r in ranks.items()})
    assert m.decode_packed(e.packed(text)[1]) == m.decode_packed(e.packed(text)[1]) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=5), max_size=8))
def test_utf8_machine_on_any_chunks(chunks):
    """Valid parts come out whole however they are cut; broken bytes give replacement signs."""
    m = bpe.Utf8Machine(dict(enumerate(chunks)))
    whole = b"".join(chunks)
    want = whole.decode("utf-8", "replace")
    assert m.decode(range(len(chunks))) == want
    packed = np.arange(len(chunks), dtype=np.int32).tobytes()
    for size in (4, 8, 12):  # the second time from what is kept
        parts = [packed[i : i + size] for i in range(0, len(packed), size)]
        assert m.decode_packed(parts) == m.decode_packed(parts) == want


def test_odd_rows(spark, odd, none, library):
    out = bpe.encoded_and_decoded(odd, out="both")
    assert out.columns == [*odd.columns, "both"]
    for r in out.collect():
        text = r["text"] or ""
        assert list(r["both"]["ids"]) == library.encode_ordinary(text)
        assert r["both"]["decoded"] == text
    assert bpe.encoded_and_decoded(none, out="both").collect() == []
    assert [len(r["n"]) for r in bpe.tokenize(odd, out="n").collect()] == [len(r["both"]["ids"]) for r in out.collect()]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.op7_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(" ".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode())


def test_a_share_of_the_caches_bounds_a_worker_and_changes_no_id():
    ranks = bpe.read_ranks(open(bpe.VOCABULARY, "rb").read())
    share = 1 / 3000
    full, small = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Encoder(ranks, public_tokenizers.PATTERN, share)
    machine = bpe.Utf8Machine({rank: token for token, rank in ranks.items()}, share)
    for i in range(400):
        text = f"wörd{i} {i * 7919}x{i} née{i % 9} plain text"
        ids, parts = small.packed(text)
        assert ids == full.packed(text)[0] and machine.decode_packed(parts) == text
    assert len(small.known) <= 100 >= len(small.older) and len(machine.whole) <= 100 >= len(machine.older)
    assert len(full.known) > 400 and len(small.transducer.states) < len(full.transducer.states)


def test_neighbours_stay_apart_as_the_merges_have_it(ranks, encoder):
    own = encoder.transducer
    words = (b" ", b"  ", b"a", b"aa", b" the", b"the", b"in", b"ing", b"g", b"s", b"ss", b"th", b"e", b"re")
    common = [ranks[t] for t in words if t in ranks]
    rare = list(ranks.values())[::997]
    for left in common + rare:
        for right in common + rare[:20]:
            want = own.merge(own.bytes_of[left] + own.bytes_of[right]) == [left, right]
            assert own.stay_apart(left, right) == want, (left, right)


def test_signs_behind_a_word_are_cut_off(ranks, library):
    """So ``word`` is one entry of the caches, whatever sign it stands before."""
    e = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for end in ".,;:!?%)'12":
        assert e.encode(f"\n wörterbuchhaft{end} zz{end}s") == library.encode_ordinary(f"\n wörterbuchhaft{end} zz{end}s")
    assert sum("wörter" in t for t in e.known) <= 2  # with the line break, and the match itself


def test_decoding_a_whole_text(ranks, machine, library):
    for text in [t for t in ODD_TEXTS if t]:
        assert machine.decode_text(np.array(library.encode_ordinary(text), np.int32).tobytes()) == text
    broken = [ranks[b"a"], ranks[b"\xe2"], ranks[b"b"], ranks[b"\xf0"]]
    assert machine.decode_text(np.array(broken, np.int32).tobytes()) == "a�b�"
