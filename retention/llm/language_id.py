"""Language identification: word-first backoff.

A word seen in training is scored by its log frequency in each language, relative to the mean of
its frequencies in all.  An unseen word backs off to the longest order of its character n-grams (4,
then 3, 2, 1, word ends marked) of which any is known, and takes their mean.  A document's score per language is the mean over its
words; the reported score is the posterior of the winner over at most ``EVIDENCE`` words' weight.

Training reads a bounded, documented sample: ``max_docs`` rows of each language, smallest hash of
the id first, whole texts.  Every label is learned, and every word and n-gram of the sample is kept,
so no language's vocabulary depends on the rows of another.  Only counts that occur are stored: what
is shipped to the tasks grows with the sample's own vocabulary, 8 bytes a (language, entry) and 16
an entry, not with languages times entries.  Prediction is one map-only stage.

Smoothing: a language's frequencies are drawn towards the mean over all languages, with the weight of
``PRIOR`` occurrences.  So what only one language has seen always speaks for that language, however
few rows it has; an entry that a language has not seen costs it less the fewer rows it has.

Defined results: null texts and texts without a letter get ``und`` and score 0; a text of only
unknown characters gets the first language with an even score; ties go to the first language in
code point order; without training rows every text is ``und``; a null id counts as not held out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, with_fields
from .subword import Words, char_table, chunks

ORDERS = (4, 3, 2, 1)
EVIDENCE = 20
PRIOR = 100.0


@functools.cache
def letters() -> np.ndarray:
    """Words are runs of letters, lower-cased."""
    return char_table(str.isalpha)


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1):
    """The evaluation rows of a hash split; they never train."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: every word and n-gram (as hashes) with its count, per batch."""
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text.lower())
        for lang, texts in by_lang.items():
            for run in chunks(texts, 500_000):
                words = Words(run, letters())
                for kind in (0, *ORDERS):
                    keys, n = np.unique(words.key if kind == 0 else words.grams(kind)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), kind, np.int32)),
                         pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "kind", "gram", "n"])


def training_sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int) -> DataFrame:
    """At most ``max_docs`` rows of each language, smallest id hash first.  A hash threshold from the
    language's count drops most rows before anything is shuffled."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1.5 * max_docs)
    share = F.broadcast(counts.select("lang", (F.lit(1.5 * max_docs) / F.col("n")).alias("share")))  # only labels with that many rows
    key = F.xxhash64("id", "lang")
    first = Window.partitionBy("lang").orderBy("key", "id", "text")
    return (
        rows.join(share, "lang", "left").withColumn("key", key)
        .filter(F.pmod("key", F.lit(1_000_000)) < F.coalesce("share", F.lit(1.0)) * 1_000_000)
        .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= max_docs).select("lang", "text")
    )


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500) -> dict:
    """The model: languages, and per kind (word or n-gram order) a sparse table of its entries: sorted
    keys, where each one's languages begin, those languages and their scores; and each language's
    score for an entry that it has not seen."""
    usable = rows.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sample = training_sample(usable, id_col, text_col, lang_col, max_docs)
    found = (
        sample.transform(bounded).mapInArrow(_count, "lang string, kind int, gram long, n long")
        .groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")).toArrow()  # of the bounded sample
    )
    names = found.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    langs = sorted(names.dictionary.to_pylist())
    place = {x: i for i, x in enumerate(langs)}
    lang_of = np.array([place[x] for x in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()]
    kind_of, key_of, n_of = (found.column(c).to_numpy() for c in ("kind", "gram", "n"))
    tables = {}
    for kind in (0, *ORDERS):
        mine = np.flatnonzero(kind_of == kind)
        key, lang, n = key_of[mine].astype(np.int64).view(np.uint64), lang_of[mine], n_of[mine].astype(np.float64)
        order = np.lexsort((lang, key))
        key, lang, n = key[order], lang[order], n[order]
        keys, first = np.unique(key, return_index=True)
        starts = np.append(first, len(key)).astype(np.int64)
        size = np.bincount(lang, n, minlength=len(langs))
        entry = np.repeat(np.arange(len(keys)), np.diff(starts))
        mean = np.bincount(entry, n / np.maximum(size[lang], 1), minlength=len(keys)) / max(1, len(langs))
        unseen = np.log(PRIOR / (size + PRIOR))
        tables[kind] = keys, starts, lang, np.log1p(n / (PRIOR * mean[entry])).astype(np.float32), unseen
    return {"langs": langs, "tables": tables}


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key in the sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def score_texts(texts: list[str], model: dict) -> tuple[list[str], list[float]]:
    """Language and posterior of each text."""
    langs, tables = model["langs"], model["tables"]
    words = Words([t.lower() for t in texts], letters())
    if not len(words.key) or not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    total = np.zeros(len(texts) * len(langs))

    def add(kind: int, doc: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> None:
        """Adds the entries ``rows`` to the scores of their documents: what each language has not seen, and
        for those that have seen an entry what that earns."""
        _, starts, lang, value, unseen = tables[kind]
        many = starts[rows + 1] - starts[rows]
        at = np.repeat(starts[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())
        total[:] += np.bincount(np.repeat(doc, many) * len(langs) + lang[at], value[at] * np.repeat(weight, many), minlength=len(total))
        total[:] += np.outer(np.bincount(doc, weight, minlength=len(texts)), unseen).ravel()

    rows = _find(tables[0][0], words.key)
    missing = rows < 0
    add(0, words.doc[~missing], rows[~missing], np.ones(int((~missing).sum())))
    for kind in ORDERS:  # unseen words: the longest order with a known n-gram
        if not missing.any():
            break
        word, key = words.grams(kind)
        mine = missing[word]
        word, key = word[mine], key[mine]
        at = _find(tables[kind][0], key)
        word, at = word[at >= 0], at[at >= 0]
        hits = np.bincount(word, minlength=len(rows))
        add(kind, words.doc[word], at, 1.0 / hits[word])
        missing &= hits == 0
    n = np.bincount(words.doc, minlength=len(texts))
    mean = total.reshape(len(texts), len(langs)) / np.maximum(n, 1)[:, None]
    best = mean.argmax(axis=1)
    gap = mean - mean.max(axis=1, keepdims=True)
    posterior = 1.0 / np.exp(np.maximum(gap * np.minimum(n, EVIDENCE)[:, None], -700.0)).sum(axis=1)
    return ([langs[b] if k else "und" for b, k in zip(best, n, strict=True)],
            [float(p) if k else 0.0 for p, k in zip(posterior, n, strict=True)])


def predict(docs: DataFrame, model: dict, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary of train's bounded sample
    at = docs.columns.index(text_col)
    names = [*docs.columns, pred_col, score_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            # a run's scores are texts x languages: with many languages its runs are shorter
            for run in chunks(batch.column(at).to_pylist(), max(2000, 200_000 // max(1, len(model["langs"]) // 100))):
                found = score_texts(run, model)
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return docs.transform(bounded).mapInArrow(score, with_fields(docs.schema, **{pred_col: "string", score_col: "double"}))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             pred_col: str = "lang_pred", score_col: str = "lang_score", **bounds: int) -> DataFrame:
    """Train on the rows not held out, predict every row."""
    model = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, **bounds)
    return predict(docs, model, text_col, pred_col, score_col)
