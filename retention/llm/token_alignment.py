"""Cross-tokenizer alignment by galloping intersection of token ends.

Two tokenizers cut the same bytes.  The byte offsets where their tokens end are two increasing lists;
the shorter one drives an exponential search, then a binary search, into the longer.  Offsets found in
both close the alignment groups, and slices of the ids between them are the groups.  The rank of each end
in the other list also tells the overlaps: the differences of successive ranks are the ranges of tokens
of the longer list that every token of the shorter one touches, which are the links.

1. Every input partition is cut into blocks of bounded text.  A block tokenizes and aligns its documents,
   and writes the digests of each with its distinct id pairs (as places in the block's own list of
   distinct pairs) and, once, that list with the block's counts.
2. Pair counts are aggregated over all blocks, and the highest count of every B id is joined to them.
3. Each block gets the counts of its own pairs back, a row for a distinct pair, and adds them up for
   its documents.  Nothing is broadcast, and the tokens themselves are never shuffled.

Defined results: null and empty texts, and texts that one of the tokenizers does not give back byte by
byte, have no tokens: zeros and an empty digest; repeated rows and rows that share an id are separate
documents; strings of special tokens are plain text; an empty table gives no rows; only the id and
text columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize
from .subword import chunks

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
BLOCK_CHARS = 1_000_000
LONG_RUN = 10_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_RUN)
_B_BITS = 32  # a pair is (A id << 32) + B id


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for
    itself, the other bytes in order for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


# fixed by byte-level vocabularies: how a text is cut before merging
_BYTE_LEVEL_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Tokenizer A over space + text.  A file whose ids stand in the order of its merges, with the plain
    byte-level cut, is the same as a table of ranks, which tiktoken encodes several times faster; the
    tests compare both on every code point.  Any other file goes through its own library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.encode_special_tokens = True
        self.of.no_truncation()
        self.of.no_padding()
        byte = _byte_alphabet()
        entries = {k: v for v, k in self.of.get_vocab(with_added_tokens=True).items()}
        self.bytes = [bytes(byte[c] for c in entries[k]) if k in entries and all(c in byte for c in entries[k]) else entries.get(k, "").encode()
                      for k in range(max(entries) + 1)]
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, vocab, cut = file["model"], file["model"]["vocab"], file["pre_tokenizer"] or {}
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        plain = (
            file["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
            and merged == list(range(256, 256 + len(merged))) and len(vocab) == 256 + len(merged)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        if not plain:
            return None
        ranks = {self.bytes[k]: k for k in vocab.values()}
        return tiktoken.Encoding(path, pat_str=_BYTE_LEVEL_CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.of.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        # the cut of white space backtracks, and overflows on runs of hundreds of thousands
        return [
            self.of.encode(" " + t, add_special_tokens=False).ids if len(t) >= LONG_RUN and _LONG_SPACE.search(t)
            else self.ranked.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Tokenizer B over the text; it adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.of = SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.of.is_byte(k) else piece.replace("▁", " ").encode()
            for k in range(self.of.get_piece_size()) for piece in [self.of.id_to_piece(k)]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.of.encode(texts, num_threads=1)


class Sized:
    """A tokenizer with the lengths and digest texts of its ids as arrays."""

    def __init__(self, of: ByteLevel | Pieces):
        self.of = of
        self.size = np.array([len(b) for b in of.bytes], np.int64)
        # the id followed by ',', '|' or ';'
        self.text = np.array([f"{k}{end}" for k in range(len(of.bytes)) for end in ",|;"], object)

    def spells(self, ids: list[int], want: bytes) -> bool:
        return b"".join(map(self.of.bytes.__getitem__, ids)) == want


@functools.cache
def pair_of(folder: str) -> tuple[Sized, Sized]:
    return Sized(ByteLevel(f"{folder}/{BYTE_BPE}")), Sized(Pieces(f"{folder}/{PIECES}"))


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For every value of ``short``, how many values of ``long`` are smaller; both increase, and the last
    of ``long`` is at least that of ``short``.  Steps double from the last place until they pass the
    value, then a binary search ends between them."""
    ranks, at, n = [], 0, len(long)
    for x in short:
        if long[at] < x:
            at += 1
            if long[at] < x:
                step = 1
                end = at + 1
                while end < n and long[end] < x:
                    at = end + 1
                    step += step
                    end += step
                at = bisect_left(long, x, at, min(end, n))
        ranks.append(at)
    return ranks


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the ends of two cuttings of the same bytes: the places in ``a`` and in ``b`` where both end, and
    all overlapping (place in a, place in b)."""
    swap = len(a) > len(b)
    short, long = (b, a) if swap else (a, b)
    rank = np.array(gallop(short.tolist(), long.tolist()), np.int64)
    same = long[rank] == short  # the last ends are equal, so every rank is a place
    own = np.arange(len(short))
    first = np.concatenate([[0], (rank + same)[:-1]])
    count = rank - first + 1
    left = np.repeat(own, count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    shared, links = (own[same], rank[same]), (left, right)
    return (shared[1], shared[0], links[1], links[0]) if swap else (*shared, *links)


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, text_a: np.ndarray, text_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    end_a, end_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    end_a[cut_a], end_b[cut_b] = 1, 2
    of_a = np.searchsorted(cut_a, np.arange(len(ids_a)))
    of_b = np.searchsorted(cut_b, np.arange(len(ids_b)))
    order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
    parts = np.concatenate([text_a[3 * ids_a + end_a], text_b[3 * ids_b + end_b]])[order]
    return "".join(parts.tolist())[:-1]


def aligned(texts: list[str], a: Sized, b: Sized) -> Iterator[tuple[list[int], list[int], str, np.ndarray] | None]:
    """(n_a, n_b, n_groups; digest; pair of every link) of each text, None without tokens."""
    for text, ids_a, ids_b in zip(texts, a.of.encode(texts), b.of.encode(texts), strict=True):
        whole = (" " + text).encode()
        if not text or not a.spells(ids_a, whole) or not b.spells(ids_b, whole):
            yield None
            continue
        x, y = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        cut_a, cut_b, left, right = align(np.cumsum(a.size[x]), np.cumsum(b.size[y]))
        digest = hashlib.sha256(groups_text(x, y, cut_a, cut_b, a.text, b.text).encode()).hexdigest()
        yield len(x), len(y), len(cut_a), digest, (x[left] << _B_BITS) + y[right]


_FIELDS = "block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, links array<int>, pairs array<long>, counts array<long>"


def _blocks(folder: str, block_chars: int):
    """A row for each document, then one with the distinct pairs of its block (and no n_a)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = pair_of(folder)
        names = [f.split()[0] for f in _FIELDS.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.list_(pa.int32()) if f.endswith("array<int>") else pa.list_(pa.int64()) if f.endswith(">") else pa.int64()
                 for f in _FIELDS.split(", ")]
        number = TaskContext.get().partitionId() << 32  # the same when the task is run again
        for batch in batches:
            ids, at = batch.column("id").to_pylist(), 0
            for texts in chunks(batch.column("text").to_pylist(), block_chars):
                found = list(aligned(texts, a, b))
                every = [np.unique(f[4], return_counts=True) if f else (np.zeros(0, np.int64),) * 2 for f in found]
                pairs, place = np.unique(np.concatenate([u for u, _ in every]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([n for _, n in every]), len(pairs)).astype(np.int64)
                places = np.split(place.astype(np.int32), np.cumsum([len(u) for u, _ in every])[:-1])
                rows = [
                    (number, id_, *(f[:3] if f else (0, 0, 0)), len(f[4]) if f else 0, f[3] if f else "", p, n.astype(np.int32), None, None)
                    for id_, f, p, (_, n) in zip(ids[at:at + len(texts)], found, places, every, strict=True)]
                rows.append((number, None, None, None, None, None, None, None, None, pairs, counts))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                at += len(texts)
                number += 1

    return run


def _added(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a block with the corpus-wide counts of its pairs."""
    n = np.zeros(pairs.num_rows, np.int64)
    best = np.zeros(pairs.num_rows, bool)
    at = pairs.column("place").to_numpy()
    n[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    places, links = docs.column("places").combine_chunks(), docs.column("links").combine_chunks()
    owner = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy())
    where, times = places.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)
    total, chosen = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    np.add.at(total, owner, n[where] * times)
    np.add.at(chosen, owner, best[where] * times)
    own = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return docs.select(own).append_column("n_best", pa.array(chosen)).append_column("count_sum", pa.array(total))


def align_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: its id under ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = materialize(texts.transform(bounded).mapInArrow(_blocks(folder, block_chars), _FIELDS), "align-blocks")
    own = materialize(blocks.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select(
        "block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n")), "align-pairs")
    counts = own.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "align-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(2**_B_BITS - 1))
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("highest"))
    judged = materialize(counts.withColumn("b", b_id).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "align-judged")
    # two plain exchanges of written tables: a pair that every block has is split by AQE
    answer = own.select("block", "place", "pair").join(judged, "pair").select("block", "place", "n", "best")
    rows = blocks.filter("n_a is not null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "links")
    done = rows.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(
        _added, "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return done.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
