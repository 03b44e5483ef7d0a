"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 machine.

**Encoding.** A sequence of tokens is the encoding of its bytes exactly when every two neighbours
are: merging the bytes of the pair gives the pair back. So the last token of a prefix follows from
the last tokens of the shorter prefixes. A state of the transducer is the set of (last token,
bytes begun since) that can still go on; it is determinised when first met, a transition at a
time, and kept. Reading a byte yields the last token of the new prefix. As soon as one possibility
is left, all tokens before it are final and emitted: the look-ahead is bounded by the longest
token.

**Splitting.** The pattern of the vocabulary splits a text before the merges. Its matches never
cross from a non-space to a white-space character, nor from a letter to a sign or digit, so a text is first
cut there (signs and digits: behind a first word), and what a stretch encodes to is looked up or worked out once. The ids of a stretch are kept packed, four bytes
each, so that those of a text are joined without a Python object per id.

**Decoding.** The token bytes of a whole text are joined; where they are UTF-8, that is the text. Any others run
through a UTF-8 state machine that keeps the incomplete character at
the end; a step (pending bytes, token) is worked out once and looked up from then on. So is a step over
the packed ids of a whole stretch that begins and ends between two characters.

Caches live in each Python worker's copy of the broadcast vocabulary, so later tasks of the worker
find them; each is emptied when it reaches its bound. Results never depend on them.

Defined results: null text is empty; empty text has no ids and decodes to the empty text. Special
tokens do not exist: their spelling is ordinary text. Bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table, whole_text

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
MAX_STATES = 350_000
MAX_PAIRS = 300_000
MAX_TEXTS = 300_000
HEAD = 5  # bytes of a piece that are looked up together
LONGEST_KEPT = 48  # characters of a stretch that is worth keeping
SLICE = 512  # rows worked on and handed back at a time

# The characters with the Unicode property White_Space.
_WHITE = r"\t\n\v\f\r \x85\xa0  -     　"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"  # all letters; there are more
_SIGN = r"!-@\[-`{-~"  # ASCII; no letters
_WORD = f"[{_WHITE}]*+[{_LETTER}]++(?=[{_SIGN}{_WHITE}]|\\Z)"
_STRETCH = re.compile(f"{_WORD}|[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def read_ranks(lines: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in lines.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Transducer:
    """States are tuples of numbers ``(last + 1) << 20 | place``: a last token (0: none yet) and the
    place, in the tree of all proper beginnings of tokens, of the bytes begun since."""

    def __init__(self, ranks: dict[bytes, int], kept: float = 1):
        self.max_states, self.max_pairs = int(MAX_STATES * kept), int(MAX_PAIRS * kept)
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        places = {b"": 0}
        child: dict[int, int] = {}  # place << 8 | byte -> place
        ends: dict[int, int] = {}  # place << 8 | byte -> token
        for token, rank in ranks.items():
            at = 0
            for i in range(1, len(token)):
                if token[:i] not in places:
                    places[token[:i]] = len(places)
                    child[at << 8 | token[i - 1]] = places[token[:i]]
                at = places[token[:i]]
            ends[at << 8 | token[-1]] = rank
        # place << 8 | byte -> next place << 17 | token + 1, 0 for none
        self.grown = {key: child.get(key, 0) << 17 | ends.get(key, -1) + 1 for key in child.keys() | ends.keys()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[int, ...]] = [(0,)]
        self.numbers = {self.states[0]: 0}
        self.heads: dict[bytes, tuple[int, list[int], list[int]]] = {}  # where the first bytes of a piece lead
        self.next: dict[int, int] = {}  # state << 8 | byte -> next state << 18 | settled << 17 | last token

    def merge(self, piece: bytes, least: int = 1) -> list[int]:
        """Encoding by the merges themselves, down to ``least`` tokens; for tokens only, so the input is short."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > least:
            best, at = -1, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (rank < best or best < 0):
                    best, at = rank, i
            if best < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halved(self, token: int) -> tuple[int, int] | None:
        """The two tokens that ``token`` is merged from (a byte: itself twice); None if merges never give it."""
        if token not in self.halves:
            piece = self.bytes_of[token]
            two = self.merge(piece, 2)
            if len(two) == 1:
                self.halves[token] = (token, token)
            else:
                self.halves[token] = (two[0], two[1]) if len(two) == 2 and self.merge(piece) == [token] else None
        return self.halves[token]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merges leave the neighbours as they are: their merges are undone, the latest first, and no
        two tokens that met at the border may have a merge that comes before the one undone last."""
        bytes_of, ranks = self.bytes_of, self.ranks
        limit = len(bytes_of) + max(left, right) + 1
        while True:
            merged = ranks.get(bytes_of[left] + bytes_of[right])
            if merged is not None and merged < limit:
                return False
            before, after = self.halved(left)[1], self.halved(right)[0]
            if before != left and (left > right or after == right):
                limit, left = left, before
            elif after != right:
                limit, right = right + 1, after  # of equal merges the left one comes first
            else:
                return True

    def fits(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: may begin)."""
        known = self.pairs.get(last << 17 | token)
        if known is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            known = self.halved(token) is not None and (last < 0 or self.stay_apart(last, token))
            self.pairs[last << 17 | token] = known
        return known

    def step(self, state: int, byte: int) -> int:
        """Next state and last token of the prefix read so far, as in ``next``."""
        out, last = [], -1
        for possible in self.states[state]:
            grown = self.grown.get((possible & 0xFFFFF) << 8 | byte)
            if grown is None:
                continue
            if grown >> 17:
                out.append(possible >> 20 << 20 | grown >> 17)
            if last < 0:
                token = (grown & 0x1FFFF) - 1
                if token >= 0 and self.fits((possible >> 20) - 1, token):
                    last = token
        out.append((last + 1) << 20)
        found = tuple(out)
        number = self.numbers.get(found)
        if number is None:
            number = self.numbers[found] = len(self.states)
            self.states.append(found)
        # Settled: one possibility is left, nothing before this place can change any more.
        to = self.next[state << 8 | byte] = number << 18 | (len(out) == 1) << 17 | last
        return to

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) >= self.max_states:
            self.reset()
        if len(piece) > HEAD:
            head = self.heads.get(piece[:HEAD])
            if head is None:
                if len(self.heads) >= self.max_states:
                    self.heads.clear()
                head = self.heads[piece[:HEAD]] = self._read(piece[:HEAD], 0, [], [])
            state, lasts, out = self._read(piece[HEAD:], head[0], head[1].copy(), head[2].copy())
        else:
            state, lasts, out = self._read(piece, 0, [], [])
        if lasts:
            self._emit(out, lasts)
        return out

    def _read(self, piece: bytes, state: int, lasts: list[int], out: list[int]) -> tuple[int, list[int], list[int]]:
        """The state behind ``piece``, the last tokens of the prefixes since the last token emitted, all emitted."""
        known = self.next
        for byte in piece:
            to = known.get(state << 8 | byte)
            if to is None:
                to = self.step(state, byte)
            state = to >> 18
            lasts.append(to & 0x1FFFF)
            if to & 0x20000:
                self._emit(out, lasts)
                lasts = []
        return state, lasts, out

    def _emit(self, out: list[int], lasts: list[int]) -> None:
        tokens, i = [], len(lasts)
        while i > 0:
            tokens.append(lasts[i - 1])
            i -= len(self.bytes_of[lasts[i - 1]])
        tokens.reverse()
        out += tokens


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: float = 1):
        self.max_texts = int(MAX_TEXTS * kept)
        self.transducer = Transducer(ranks, kept)
        spaces = pattern.replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")
        spaces = spaces.replace(f"[^[{_WHITE}]", f"[^{_WHITE}")  # inside a class already
        self.pieces = regex.compile(spaces)
        self.known: dict[str, bytes] = {}  # text -> packed ids
        self.older: dict[str, bytes] = {}

    def _keep(self, text: str, ids: bytes) -> None:
        """Two generations: what is looked up again moves on to the next, the rest goes."""
        if len(text) <= LONGEST_KEPT:
            if len(self.known) >= self.max_texts:
                self.older, self.known = self.known, {}
            self.known[text] = ids

    def _stretch(self, text: str) -> bytes:
        old = self.older.get(text)
        if old is not None:
            self._keep(text, old)
            return old
        # A space and letters are one match of the pattern, whatever comes before and after.
        body = text[1:] if text[0] == " " else text
        pieces = [text] if body.isalpha() else self.pieces.findall(text)
        parts: list[bytes] = []
        for piece in pieces:
            found = self.known.get(piece) or self.older.get(piece)
            if found is None:
                found = array("i", self.transducer.encode(piece.encode("utf-8"))).tobytes()
                self._keep(piece, found)
            parts.append(found)
        ids = b"".join(parts)
        if len(pieces) > 1:
            self._keep(text, ids)
        return ids

    def packed(self, text: str) -> tuple[bytes, list[bytes]]:
        """The packed ids of a text: whole, and stretch by stretch."""
        stretches = _STRETCH.findall(text)
        parts = list(map(self.known.get, stretches))
        try:
            return b"".join(parts), parts
        except TypeError:  # some are not known yet
            parts = [self._stretch(s) if ids is None else ids for s, ids in zip(stretches, parts, strict=True)]
            return b"".join(parts), parts

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text)[0], np.int32).tolist()


class Utf8Machine:
    """Decodes byte chunks; an incomplete character waits for the next chunk."""

    # Fixed values (RFC 3629): lead bytes, continuation bytes that follow, range of the first one.
    LEADS = [
        (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
        (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF),
        (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
    ]

    def __init__(self, bytes_of: dict[int, bytes], kept: float = 1):
        self.max_texts = int(MAX_TEXTS * kept)
        self.bytes_of = bytes_of
        self.tokens = np.full(max(bytes_of, default=-1) + 1, None, object)
        for token, chunk in bytes_of.items():
            self.tokens[token] = chunk
        self.lead = {b: (n, lo, hi) for first, last, n, lo, hi in self.LEADS for b in range(first, last + 1)}
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.clean: dict[int, str] = {}  # steps from and to a complete text
        self.whole: dict[bytes, str] = {}  # the same over packed ids
        self.older: dict[bytes, str] = {}

    def feed(self, pending: bytes, chunk: bytes) -> tuple[str, bytes]:
        """Text of the characters that ``chunk`` completes, and what is still pending."""
        out, state = [], pending
        for byte in chunk:
            if state:
                n, lo, hi = self.lead[state[0]]
                if len(state) > 1:
                    lo, hi = 0x80, 0xBF
                if lo <= byte <= hi:
                    state += bytes([byte])
                    if len(state) == n + 1:
                        out.append(state.decode("utf-8"))
                        state = b""
                    continue
                out.append("�")
                state = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.lead:
                state = bytes([byte])
            else:
                out.append("�")
        return "".join(out), state

    def run(self, pending: bytes, ids) -> tuple[str, bytes]:
        """Text of the characters that ``ids`` complete, and what is still pending."""
        if not pending:
            out = list(map(self.clean.get, ids))
            if None not in out:
                return "".join(out), b""
        out, steps = [], self.steps
        for token in ids:
            step = steps.get((pending, token))
            if step is None:
                if len(steps) >= self.max_texts:
                    steps.clear()
                step = steps[pending, token] = self.feed(pending, self.bytes_of[token])
                if not pending and not step[1]:
                    self.clean[token] = step[0]
            out.append(step[0])
            pending = step[1]
        return "".join(out), pending

    def decode(self, ids) -> str:
        text, pending = self.run(b"", ids)
        return f"{text}\ufffd" if pending else text

    def decode_text(self, packed: bytes) -> str:
        """Text of the packed ids of a whole text."""
        try:
            return b"".join(self.tokens[np.frombuffer(packed, np.int32)].tolist()).decode("utf-8")
        except UnicodeDecodeError:
            return self.decode_packed([packed])

    def decode_packed(self, parts: list[bytes]) -> str:
        """Text of packed ids that come in parts, wherever these are cut."""
        out = list(map(self.whole.get, parts))
        try:
            return "".join(out)
        except TypeError:  # some steps are not known yet
            pass
        pending = b""
        for k, part in enumerate(parts):
            if not pending:
                text = out[k] if out[k] is not None else self.older.get(part)
                if text is None:
                    text, pending = self.run(b"", np.frombuffer(part, np.int32).tolist())
                if out[k] is None and not pending and len(text) <= LONGEST_KEPT:
                    if len(self.whole) >= self.max_texts:
                        self.older, self.whole = self.whole, {}
                    self.whole[part] = text
            else:
                text, pending = self.run(pending, np.frombuffer(part, np.int32).tolist())
            out[k] = text
        return "".join([*out, "\ufffd"] if pending else out)


def _list_array(packed: list[bytes]) -> pa.Array:
    """Packed ids of several texts as one array of arrays."""
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


class Codec:
    """Encoding and decoding as column functions over one vocabulary.

    The rank file is read by the driver and broadcast: its size does not depend on the data. ``share`` is the
    part of the full bounds that the caches of a worker keep to: fewer take less memory and more time.
    """

    def __init__(
        self, spark: SparkSession, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, share: float = 1
    ):
        with open(path, "rb") as f:
            shared = spark.sparkContext.broadcast({"lines": f.read(), "kept": {}})

        def part(name: str):
            kept = shared.value["kept"]
            if name not in kept:
                ranks = read_ranks(shared.value["lines"])
                if name == "encoder":
                    kept[name] = Encoder(ranks, pattern, share)
                else:
                    kept[name] = Utf8Machine({rank: token for token, rank in ranks.items()}, share)
            return kept[name]

        def slices(batches: Iterator[pa.Array]) -> Iterator[list]:
            for rows in batches:
                for at in range(0, len(rows), SLICE):
                    yield rows[at : at + SLICE].to_pylist()

        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = part("encoder")
            for texts in slices(batches):
                yield _list_array([encoder.packed(t)[0] for t in texts])

        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            machine = part("decoder")
            for rows in slices(batches):
                yield pa.array([machine.decode(ids) for ids in rows], pa.string())

        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder, machine = part("encoder"), part("decoder")
            for texts in slices(batches):
                packed, decoded = [], []
                for t in texts:
                    ids = encoder.packed(t)[0]
                    packed.append(ids)
                    decoded.append(machine.decode_text(ids))
                yield pa.StructArray.from_arrays([_list_array(packed), pa.array(decoded, pa.string())], ["ids", "decoded"])

        self._encode, self._decode = F.arrow_udf(encode, "array<int>"), F.arrow_udf(decode, "string")
        self._both = F.arrow_udf(both, "ids array<int>, decoded string")

    def encode(self, text: Column) -> Column:
        return self._encode(whole_text(text))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)

    def there_and_back(self, text: Column) -> Column:
        """A struct of the ids and the text that they decode to, in one pass."""
        return self._both(whole_text(text))


def tokenize(docs: DataFrame, path: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: the token ids of the whole text."""
    return docs.withColumn(out, Codec(docs.sparkSession, path).encode(F.col("text")))


def encoded_and_decoded(docs: DataFrame, path: str = VOCABULARY, out: str = "codec", share: float = 1) -> DataFrame:
    """``docs`` with a struct ``out``: the token ids of the whole text and what they decode to."""
    return docs.withColumn(out, Codec(docs.sparkSession, path, share=share).there_and_back(F.col("text")))


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encoded_and_decoded(docs).select("doc_id", "codec.*")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
