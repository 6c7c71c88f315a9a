"""Rows that share an id but not their text, and many copies of one row: nothing is lost or mixed up."""

import collections
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from retention.llm import maxscore, ngram_jaccard, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_links_of_texts_that_share_an_id(spark):
    rnd = random.Random(1)
    a, b = _words(rnd, 60), _words(rnd, 60)
    rows = [(1, a), (1, b), (2, [*a, "x"]), (3, [*b, "x"]), (4, a), (4, _words(rnd, 50)), (4, _words(rnd, 50))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    found, pairs = ngram_jaccard.similar(docs, n=3, percent=90)
    by_text = {r["part"]: r for r in found.collect()}
    keyed = docs.select("doc_id", "text", *ngram_jaccard.document_key("doc_id", "text")).collect()
    got = collections.Counter((r["doc_id"], r["text"].split()[0], by_text[r["part"]]["component"], by_text[r["part"]]["n_links"]) for r in keyed)
    assert got == collections.Counter((i, w[0], 1 if w[0] in (a[0], b[0]) else 4, 1 if w[0] in (a[0], b[0]) else 0) for i, w in rows)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 2), (1, 3)]
    kept = ngram_jaccard.keep_one(docs, n=3, percent=90)
    assert collections.Counter((r["doc_id"], r["text"].split()[0]) for r in kept.collect()) == collections.Counter((i, w[0]) for i, w in [rows[0], rows[1], *rows[5:]])


def test_keep_one_loses_no_text(spark):
    """Whatever ids repeat, every document that goes has a linked one that stays."""
    rnd = random.Random(4)
    base = [_words(rnd, 80) for _ in range(8)]
    rows = []
    for k in range(120):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 2])):
            w[rnd.randrange(80)] = f"new{k}"
        rows.append((rnd.choice([None, *range(10)]), " ".join(w)))
    rows += [rows[0]] * 6 + [(None, None), (None, None), (3, ""), (5, "one")]
    kept = [tuple(r) for r in ngram_jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n=5, percent=80).collect()]
    assert not collections.Counter(kept) - collections.Counter(rows)
    sets = {t: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)} if (w := WORD.findall(t or "")) else set() for _, t in rows}
    near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    root = {t: t for t in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if near(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    stay = collections.Counter(root[t] for _, t in kept if sets[t])
    assert stay == {root[t]: 1 for t in sets if sets[t]}
    assert sorted((str(i), str(t)) for i, t in kept if not sets[t]) == [("3", ""), ("None", "None")]


def test_substring_dedup_of_texts_that_share_an_id(spark):
    rnd = random.Random(7)
    texts = [_words(rnd, 60) for _ in range(3000)]
    rows = [(1, " ".join(w)) for w in texts] + [(2, " ".join([*w, "and", "more"])) for w in texts[::2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = collections.Counter((r["doc"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(docs).collect())
    sha = lambda words: hashlib.sha256(" ".join(words).encode()).hexdigest()
    want = collections.Counter((1, 60, 0, sha(w)) if k % 2 else (1, 60, 60, sha([])) for k, w in enumerate(texts))
    want.update((2, 62, 60, sha(["and", "more"])) for _ in texts[::2])
    assert got == want


def test_substring_dedup_of_many_copies(spark):
    """The time of many copies of one long row grows with their number, not with its square."""
    text = " ".join(_words(random.Random(9), 1500))

    def run(n):
        docs = spark.range(n).select(F.lit(5).alias("doc_id").cast("long"), F.lit(text).alias("text")).repartition(4)
        start = time.perf_counter()
        rows = substring_dedup.dedup(docs).groupBy("n_words", "n_removed").count().collect()
        assert [tuple(r) for r in rows] == [(1500, 1500 if n > 1 else 0, n)]
        return time.perf_counter() - start

    run(1)
    assert run(2000) < 10 * run(100) + 20


def test_queries_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), *[(k, [k / 64, -k / 64]) for k in range(1, 8)]]
    found = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert collections.Counter((r["query_id"], r["rank"], r["vec_id"]) for r in found) == collections.Counter(
        [(50, k + 1, v) for k, v in enumerate([7, 6, 5, 4, 3])] + [(50, k + 1, v) for k, v in enumerate([1, 2, 3, 4, 5])])
