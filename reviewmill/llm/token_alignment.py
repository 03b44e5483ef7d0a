"""Cross-tokenizer alignment with pair counts by external spill counting.

Both tokenizers cut the same bytes, so tokens overlap where their byte ranges do. Places where a token of
either side ends cut a text into pieces, each inside one token of either side: one link apiece. Places where
both end cut it into groups.

**Counting.** A pair's count is the number of documents that hold it linked. Documents are aligned in blocks
of bounded size. A block's records (pair, document, how often) are radix-partitioned by the A id, sorted
by A id, B id and document, and spilled as zstd runs: the pairs with the block's own document counts, and
beside them the documents. Runs of a partition are merged by a heap, ``FAN_IN`` at a time and in as many
rounds as it takes, adding up counts. The order is A-major, so all pairs of an A id pass one after the other
and its highest count is known as soon as it ends. A merged run holds each pair once: it grows with the
vocabularies, not with the documents.

**Streaming back.** The final counts of a partition meet the partition's runs, ``FAN_IN`` at a time, and
each run gives every document of its block its share of ``n_best`` and ``count_sum``. Shares of a block are added
where the block's own figures are. Only runs are shuffled, never texts or tokens, and however frequent a pair is,
it is one record in a block's counts.

Runs, counts and figures are tables in the shared folder, so a lost executor costs one step's tasks.

Defined results: null or empty texts, and texts whose tokens do not spell space + text on either side, have
no tokens: zeros and an empty hash column. Every row is a document of its own, also with a null or repeated
id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import os
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import query, table, whole_text

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
RADIX = 64  # partitions, by the low bits of the A id
BLOCK_DOCS, BLOCK_RECORDS = 4096, 1 << 20  # a block ends with the document that reaches either
FAN_IN = 64  # runs that are merged or read together
ENCODED_AT_ONCE = 256  # texts
LATIN = "\u0250"  # character classes below are the same in every regular expression engine

FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


# --- tokens of one text --------------------------------------------------------------

def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the
    others, in order, are numbered from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    def __init__(self, byte_bpe: str, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        self.a = tokenizers.Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        alphabet = byte_level_alphabet()
        entries = sorted((i, entry) for entry, i in self.a.get_vocab().items())
        self.a_bytes = [b""] * (entries[-1][0] + 1)
        for i, entry in entries:
            if all(c in alphabet for c in entry):
                self.a_bytes[i] = bytes(alphabet[c] for c in entry)
        self.quick = self._quick(byte_bpe)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        self.texts = max(len(self.a_bytes), len(self.b_bytes))
        self.spelled = [f"{i}{mark}" for mark in ",|;" for i in range(self.texts)]

    def _quick(self, byte_bpe: str) -> tiktoken.Encoding | None:
        """A faster encoder of the same vocabulary, if its merges are in the order of their ids and it is split
        by the usual pattern alone."""
        made = json.loads(byte_bpe)
        vocab, split = made["model"]["vocab"], made["pre_tokenizer"] or {}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in made["model"]["merges"]]
        in_order = all(vocab.get(m) == 256 + i for i, m in enumerate(merged))
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not (in_order and plain and not made["normalizer"]):
            return None
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _byte_bpe(self, texts: list[str]) -> list[list[int]]:
        slow = [i for i, t in enumerate(texts) if not self.quick or max(t) >= LATIN]
        out = [self.quick.encode_ordinary(t) if self.quick and max(t) < LATIN else None for t in texts]
        encoded = self.a.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)
        for i, e in zip(slow, encoded):
            out[i] = e.ids
        return out

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of both sides of each text; None where a side does not spell it."""
        spaced = [" " + t for t in texts]
        for text, own, x, y in zip(texts, spaced, self._byte_bpe(spaced), self.b.encode(texts, num_threads=1)):
            raw = own.encode()
            same = text and b"".join([self.a_bytes[i] for i in x]) == raw == b"".join([self.b_bytes[i] for i in y])
            yield (x, y) if same else None

    def align(self, a: list[int], b: list[int]) -> tuple[tuple, np.ndarray, np.ndarray]:
        """((n_a, n_b, n_groups, n_links, hash), distinct linked pairs as ``a << 32 | b``, how often each)."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.union1d(a_ends, b_ends)
        linked = a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]
        pairs, often = np.unique(linked, return_counts=True)
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        spelled = self._groups(a, b, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends))
        digest = hashlib.sha256(spelled.encode()).hexdigest()
        return (len(a), len(b), len(cuts), len(ends), digest), pairs, often

    def _groups(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: every token with the mark that follows it."""
        place = np.concatenate([2 * a_group, 2 * b_group + 1])
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.concatenate([a, b])[order]
        last = np.append(place[1:] != place[:-1], True)
        mark = np.where(last, 1 + place % 2, 0)
        return "".join([self.spelled[i] for i in (mark * self.texts + ids).tolist()])[:-1]


# --- runs ------------------------------------------------------------------------------

def pack(*columns: np.ndarray) -> bytes:
    """Whole-number columns as one zstd frame; each is preceded by its length and width."""
    parts = [struct.pack("<IB", len(c), c.dtype.itemsize) + c.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, width = struct.unpack_from("<IB", data, at)
        out.append(np.frombuffer(data, f"<i{width}", n, at + 5))
        at += 5 + n * width
    return out


def pack_pairs(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return pack(np.diff(pairs, prepend=0).astype(np.int64), counts.astype(np.int64))


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpack(blob)
    return np.cumsum(steps), counts


def spill(documents: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, pairs with their number of documents, documents and how often each) of a block."""
    sizes = [len(p) for p, _ in documents]
    pairs = np.concatenate([p for p, _ in documents]) if documents else np.zeros(0, np.int64)
    often = np.concatenate([o for _, o in documents]) if documents else np.zeros(0, np.int64)
    holder = np.repeat(np.arange(len(documents)), sizes)
    order = np.argsort(pairs, kind="stable")  # documents are in order already
    pairs, often, holder = pairs[order], often[order], holder[order]
    part = (pairs >> 32) % RADIX
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(RADIX + 1))
    for radix in range(RADIX):
        own = order[bounds[radix] : bounds[radix + 1]]
        if len(own):
            distinct, counts = np.unique(pairs[own], return_counts=True)
            steps = np.diff(holder[own], prepend=0).astype(np.int32)
            yield radix, pack_pairs(distinct, counts), pack(steps, often[own].astype(np.int32))


def merge(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order with their counts added up: a heap holds the next pair of every run."""

    def stream(blob: bytes) -> Iterator[tuple[int, int]]:
        pairs, counts = unpack_pairs(blob)
        return zip(pairs.tolist(), counts.tolist())

    pairs, counts = [], []
    for pair, count in heapq.merge(*map(stream, runs)):
        if pairs and pairs[-1] == pair:
            counts[-1] += count
        else:
            pairs.append(pair)
            counts.append(count)
    return np.array(pairs, np.int64), np.array(counts, np.int64)


def shares(run: bytes, documents: bytes, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray, n_docs: int):
    """(n_best, count_sum) of each document of a block, from one run and the final counts of its partition."""
    own, per_pair = unpack_pairs(run)
    steps, often = unpack(documents)
    place = np.repeat(np.searchsorted(pairs, own), per_pair)
    often, holder = often.astype(np.int64), np.cumsum(steps, dtype=np.int64)
    n_best, count_sum = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    np.add.at(n_best, holder, often * best[place])
    np.add.at(count_sum, holder, often * counts[place])
    return n_best, count_sum


def highest(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their A id; ``pairs`` are in A-major order."""
    if not len(pairs):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
    top = np.maximum.reduceat(counts, first)
    return counts == np.repeat(top, np.diff(np.append(first, len(pairs))))


# --- steps -----------------------------------------------------------------------------

def _aligned(shared: Broadcast):
    """Blocks of rows (doc_id, text): one row with the figures of the documents, and one for each run."""
    kinds = pa.schema([
        ("block", pa.string()), ("radix", pa.int32()), ("n_docs", pa.int32()), ("pairs", pa.binary()), ("docs", pa.binary()),
        ("figures", pa.list_(pa.struct([
            ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
            ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ]))),
    ])
    names = [f.name for f in kinds.field("figures").type.value_type]

    def block_rows(figures: list[tuple], documents: list) -> pa.RecordBatch:
        block, n = uuid.uuid4().hex, len(figures)
        rows = [(block, -1, n, None, None, [dict(zip(names, f)) for f in figures])]
        rows += [(block, radix, n, pairs, docs, None) for radix, pairs, docs in spill(documents)]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        if "aligner" not in kept:
            kept["aligner"] = Aligner(kept["byte_bpe"], kept["piece_bpe"])
        aligner, figures, documents, records = kept["aligner"], [], [], 0
        nothing = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED_AT_ONCE):
                part = batch.slice(at, ENCODED_AT_ONCE)
                for doc_id, tokens in zip(part["doc_id"].to_pylist(), aligner.tokens(part["text"].to_pylist())):
                    own, pairs, often = aligner.align(*tokens) if tokens else ((0, 0, 0, 0, ""), nothing, nothing)
                    figures.append((doc_id, *own))
                    documents.append((pairs, often))
                    records += len(pairs)
                    if len(figures) >= BLOCK_DOCS or records >= BLOCK_RECORDS:
                        yield block_rows(figures, documents)
                        figures, documents, records = [], [], 0
        if figures:
            yield block_rows(figures, documents)

    return run


def _merged(runs: pa.Table) -> pa.Table:
    pairs, counts = merge(runs["pairs"].to_pylist())
    return pa.table({"radix": runs["radix"][:1], "part": runs["part"][:1], "pairs": pa.array([pack_pairs(pairs, counts)])})


def _final_counts(runs: DataFrame, blocks: int) -> DataFrame:
    """(radix, pairs): one merged run for each partition that has pairs."""
    runs = runs.select("radix", F.col("block").alias("part"), "pairs")
    while True:
        blocks = max(1, math.ceil(blocks / FAN_IN))
        part = F.pmod(F.xxhash64("part"), F.lit(blocks)).cast("string")
        grouped = runs.withColumn("part", part).groupBy("radix", "part")
        runs = cut_lineage(grouped.applyInArrow(_merged, "radix int, part string, pairs binary"))
        if blocks == 1:
            return runs.select("radix", "pairs")


def _shares(runs: pa.Table, final: pa.Table) -> pa.Table:
    out = []
    if len(runs) and len(final):
        pairs, counts = unpack_pairs(final["pairs"][0].as_py())
        best = highest(pairs, counts)
        for row in runs.select(["block", "n_docs", "pairs", "docs"]).to_pylist():
            out.append((row["block"], pack(*shares(row["pairs"], row["docs"], pairs, counts, best, row["n_docs"]))))
    return pa.table({"block": pa.array([b for b, _ in out], pa.string()), "share": pa.array([s for _, s in out], pa.binary())})


def _finished(figures: pa.Table, shares_: pa.Table) -> pa.Table:
    docs = pa.Table.from_struct_array(figures["figures"].combine_chunks().flatten())
    n_best, count_sum = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for blob in shares_["share"].to_pylist():
        for total, part in zip((n_best, count_sum), unpack(blob)):
            total += part
    return docs.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))


def align_tokenizers(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    The tokenizers' files are read by the driver and broadcast (2 MB).
    """
    files = {"byte_bpe": Path(byte_bpe).read_text("utf-8"), "piece_bpe": Path(piece_bpe).read_bytes()}
    shared = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    blocks = cut_lineage(rows.mapInArrow(
        _aligned(shared),
        f"block string, radix int, n_docs int, pairs binary, docs binary, figures array<struct<{FIGURES.replace(' ', ':').replace(',:', ',')}>>",
    ))
    figures, runs = blocks.where("radix < 0"), blocks.where("radix >= 0")
    n_blocks = figures.count()
    final = _final_counts(runs, n_blocks)
    salts = max(1, math.ceil(n_blocks / FAN_IN))
    dealt = runs.select("block", "n_docs", "pairs", "docs", "radix", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    copied = final.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    back = dealt.groupBy("radix", "salt").cogroup(copied.groupBy("radix", "salt")).applyInArrow(
        _shares, "block string, share binary"
    )
    own = figures.select(F.col("block").alias("block"), "figures").groupBy("block")
    return own.cogroup(back.groupBy("block")).applyInArrow(_finished, f"{FIGURES}, n_best long, count_sum long")


@query()
def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
