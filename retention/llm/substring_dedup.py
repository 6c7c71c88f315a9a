"""Substring deduplication by compaction of a token De Bruijn graph.

The edges of the graph are the windows of ``WINDOW`` consecutive words of every text; an edge is
repeated when its word sequence starts at more than one place.  Edges are never shuffled one by
one.  Each belongs to the path of neighbouring windows that share their minimizer (the window's
9-word gram with the least hash, the leftmost on ties, a function of the window's words alone),
and a path travels as one row: the minimizer's hash, a hash of the path's words, and the source
coordinates (document, first window, number of windows), about one row for 14 words.

1. Rows are aggregated by minimizer and joined back.  A minimizer at one place only has no repeated
   edge.  Where every occurrence has the same path, the path does not branch and is repeated whole:
   its edges are compacted into that one verdict.
2. Where occurrences of a minimizer branch into different paths, each different path is counted
   once with its number of copies, opened at one source coordinate into its single edges, and the
   edges are counted and joined back.  A group of copies, however large, opens one path.
3. The source coordinates bring all verdicts to their documents; the words covered by a repeated
   edge are marked there and removed.

Path and edge identities are 128 bits (a 64-bit minimizer or second hash beside a 64-bit content
hash).  Windows are judged on the input.

Defined results: null texts have no words; texts shorter than a window lose nothing; repeated rows
are copies of each other, so all their windows repeat; rows that share an id but not their text are
told apart by a text hash; a null id is replaced by a hash of the text for joining only; only the id
and text columns are read, others pass through whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize
from .subword import Words, char_table, chunks, mix64

WINDOW = 35  # fixed by the contract
GRAM = 9  # words of a minimizer
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_INV = tuple(pow(b, -1, 2**64) for b in _BASE)


@functools.cache
def word_chars() -> np.ndarray:
    return char_table(lambda c: c not in " \t\n\x0b\x0c\r")


class _Rolling:
    """Hashes of word ranges of one run of texts, from prefix sums of a polynomial mod 2^64."""

    def __init__(self, key: np.ndarray, which: int):
        power = np.full(len(key) + 1, _BASE[which], np.uint64)
        self.back = np.full(len(key) + 1, _INV[which], np.uint64)
        power[0] = self.back[0] = 1
        power, self.back = np.cumprod(power), np.cumprod(self.back)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(key * power[:-1], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.back[start] + (end - start).astype(np.uint64))


def paths_of(texts: list[str], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimizer, content) of every path, in order."""
    words = Words(texts, word_chars())
    key, doc = words.key, words.doc
    n = len(key) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    roll = _Rolling(key, 0)
    grams = np.arange(len(key) - gram + 1)
    h = roll(grams, grams + gram)
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(h, window - gram + 1).argmin(axis=1)
    valid = np.flatnonzero(doc[:n] == doc[window - 1:])
    if not len(valid):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = at[valid]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)])
    first = valid[new]
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(valid)]]))
    anchor = at[new]
    head = np.searchsorted(doc, doc[first])
    content = mix64(_Rolling(key, 1)(first, first + count + window - 1) + (anchor - first).astype(np.uint64))
    return doc[first], first - head, count, h[anchor], content


def _paths(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            doc, part = batch.column("doc").to_numpy(), batch.column("part").to_numpy()
            for texts in chunks(batch.column("text").to_pylist()):
                text, first, count, anchor, content = paths_of(texts, window, gram)
                text = text + at
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[text]), pa.array(part[text]), pa.array(first * 64 + count), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["doc", "part", "at", "anchor", "content"])

    return run


def _edges(window: int):
    """The single edges of the paths opened in each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                opened = batch.column("opened")[r].as_py()
                words = Words([batch.column("text")[r].as_py() or ""], word_chars())
                starts = np.concatenate([np.arange(x["at"] // 64, x["at"] // 64 + x["at"] % 64) for x in opened])
                count = np.array([x["at"] % 64 for x in opened])
                step = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
                same = lambda name: np.repeat(np.array([x[name] for x in opened], np.int64), count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same("anchor")), pa.array(same("content")), pa.array(same("copies")), pa.array(step.astype(np.int32)),
                     *[pa.array(_Rolling(words.key, k)(starts, starts + window).view(np.int64)) for k in (0, 1)]],
                    names=["anchor", "content", "copies", "step", "e1", "e2"])

    return run


def covered(n: int, verdicts: list[dict], window: int) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window."""
    starts = np.zeros(n + 1, np.int32)
    for v in verdicts:
        at, mask = v["at"] // 64, v["mask"]
        for k in range(v["at"] % 64):
            if mask >> k & 1:
                starts[at + k] = 1
    total = np.concatenate([[0], np.cumsum(starts[:n])])
    place = np.arange(n)
    return total[place + 1] - total[np.maximum(place + 1 - window, 0)] > 0


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept = [], [], [], []
            for text, verdicts in zip(batch.column("__text").to_pylist(), batch.column("__verdicts").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                gone = 0
                if verdicts:
                    cover = covered(n, verdicts, window)
                    gone = int(cover.sum())
                    words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                joined = b" ".join(words)
                total.append(n)
                removed.append(gone)
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if gone else text)
            own = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("__text", "__verdicts")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                names=[*[x for x in batch.schema.names if x not in ("__text", "__verdicts")], "__kept", "__n_words", "__n_removed", "__sha256"])

    return run


def document_key(id_col: str, text_col: str) -> list[Column]:
    """(doc, part): the id, or a hash of the text where it is null, and the text's 64-bit hash."""
    text = F.xxhash64(F.lit(11), F.col(text_col))
    return [F.coalesce(F.col(id_col).cast("long"), text).alias("doc"), text.alias("part")]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc`` (a struct of the input's columns), ``kept`` (its text, or the
    kept words joined by one space where any was removed), n_words, n_removed and kept_sha256."""
    texts = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"))
    paths = materialize(
        texts.transform(bounded).mapInArrow(_paths(window, gram), "doc long, part long, at long, anchor long, content long"), "dedup-paths")
    # compaction: minimizers with several occurrences, and whether all of them have one path; a
    # table of their own, so that the join has two plain exchanges and a hot minimizer is split
    anchors = materialize(
        paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
        .filter("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("whole")), "dedup-anchors")
    repeated = materialize(paths.join(anchors, "anchor"), "dedup-repeated")
    whole = repeated.filter("whole").select("doc", "part", "at", F.expr("shiftleft(1L, cast(at % 64 as int)) - 1").alias("mask"))
    branching = repeated.filter("not whole")
    # each different path of a branching minimizer, opened where it first occurs
    opened = (
        branching.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "part", "at")).alias("first"))
        .groupBy(F.col("first.doc").alias("doc"), F.col("first.part").alias("part"))
        .agg(F.collect_list(F.struct("anchor", "content", "copies", F.col("first.at").alias("at"))).alias("opened"))
    )
    edges = materialize(
        texts.join(opened, ["doc", "part"]).dropDuplicates(["doc", "part"]).select("text", "opened").transform(bounded).mapInArrow(
            _edges(window), "anchor long, content long, copies long, step int, e1 long, e2 long"), "dedup-edges")
    twice = edges.groupBy("e1", "e2").agg(F.sum("copies").alias("n")).filter("n > 1").select("e1", "e2")
    opened_masks = materialize(
        edges.join(twice, ["e1", "e2"])
        .groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, step)")).alias("mask")), "dedup-masks")
    branched = branching.join(opened_masks, ["anchor", "content"]).select("doc", "part", "at", "mask")
    verdicts = (
        whole.unionByName(branched).groupBy("doc", "part")
        .agg(F.collect_set(F.struct("at", "mask")).alias("__verdicts"))  # copies of a row give the same ones
    )
    rows = docs.select(*document_key(id_col, text_col), F.struct(*docs.drop(text_col).columns).alias("__doc"), F.col(text_col).alias("__text"))
    marked = rows.join(verdicts, ["doc", "part"], "left").drop("doc", "part")
    own = docs.drop(text_col).schema.simpleString()
    done = marked.transform(bounded).mapInArrow(_remove(window), f"__doc {own}, __kept string, __n_words long, __n_removed long, __sha256 string")
    return done.select(
        F.col("__doc").alias("doc"), F.col("__kept").alias("kept"), F.col("__n_words").alias("n_words"),
        F.col("__n_removed").alias("n_removed"), F.col("__sha256").alias("kept_sha256"))
