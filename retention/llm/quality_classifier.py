"""Quality classifier: supervised subword embeddings.

Every word and its character 3- to 5-grams hash into one table of learned vectors; a word that
repeats the one before it adds a hashed bigram marker.  A document is the average of its vectors,
a softmax layer gives the class, and numpy stochastic gradient descent trains both.  As the output
layer is linear in the average, a trained model ships as one number per bucket and a bias.

Training reads a bounded, documented sample of the labelled rows: the ``max_docs`` with the
smallest id hash, whole texts.  It runs in one task over that sample, in an order fixed by id, so
a rerun gives the same model.  Scoring is one map-only stage over whole texts.

Defined results: null, empty and blank texts get the score of the bias alone; a null id counts as
not held out; without labelled rows, or with one class only, every score is that class's share
(0.5 without any); repeated rows score alike.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, with_fields
from .subword import Words, char_table, chunks

BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 17, 8, 6, 0.5, 7
SAME = 0  # bucket of the repeated-word marker, and its count for one repeat
SAME_COUNT = 8


@functools.cache
def word_chars() -> np.ndarray:
    return char_table(lambda c: c not in " \t\n\x0b\x0c\r")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, bucket) of every feature: words, their 3- to 5-grams, repeat markers."""
    words = Words(texts, word_chars())
    docs, buckets = [words.doc], [words.key]
    for n in (3, 4, 5):
        word, key = words.grams(n)
        docs.append(words.doc[word])
        buckets.append(key)
    same = np.flatnonzero((words.key[1:] == words.key[:-1]) & (words.doc[1:] == words.doc[:-1]))
    hashed = (np.concatenate(buckets) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    return (np.concatenate([*docs, np.repeat(words.doc[same], SAME_COUNT)]),
            np.concatenate([hashed, np.full(len(same) * SAME_COUNT, SAME)]))


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of all its features."""
    ids, n = np.unique(features([text])[1], return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def fit(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    """(score per bucket, bias) of label 1 against label 0."""
    y = np.array(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else (0.999 if y[0] == 1 else 0.001)
        return np.zeros(BUCKETS, np.float32), math.log(share / (1 - share))
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.log(np.array([np.mean(y == 0), np.mean(y == 1)], np.float32))
    docs = [_shares(t or "") for t in texts]
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            ids, share = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            vectors = emb[ids]
            hidden = share @ vectors if len(ids) else np.zeros(DIM, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # gradient of the logits
            back = out.T @ p
            out -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            if len(ids):  # each feature's step is scaled by its share, relative to an average feature
                emb[ids] = vectors - (rate * np.minimum(share * len(ids), 20.0))[:, None] * back
    return (emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts: list[str], weights: np.ndarray, bias: float) -> list[float]:
    """Probability of label 1 for each text."""
    doc, bucket = features(texts)
    total = np.bincount(doc, weights[bucket], minlength=len(texts))
    n = np.bincount(doc, minlength=len(texts))
    z = np.clip(total / np.maximum(n, 1) + bias, -500, 500)
    return (1 / (1 + np.exp(-z))).tolist()


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_docs: int = 4000) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_docs`` labelled rows that aren't held out, in one task."""
    chosen = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label").limit(max_docs)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # one text of each chosen row, the least, so a repeated id takes no other's place and reruns agree
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # chosen has max_docs rows at most
    sample = sample.select("id", "text", "label")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*frames, pd.DataFrame({"id": [], "text": [], "label": []})])
        rows = rows.assign(text=rows.text.fillna("")).sort_values(["id", "label", "text"])
        weights, bias = fit(list(rows.text), [int(x) for x in rows.label])
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    model = sample.repartition(1).mapInPandas(learn, "weights binary, bias double").collect()
    if not model:  # no task ran over an empty sample
        return fit([], [])
    return np.frombuffer(model[0]["weights"], np.float32), model[0]["bias"]


def predict(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    at, names = docs.columns.index(text_col), [*docs.columns, score_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            found = [x for run in chunks(batch.column(at).to_pylist()) for x in score_texts(run, weights, bias)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=names)

    return docs.transform(bounded).mapInArrow(score, with_fields(docs.schema, **{score_col: "double"}))
