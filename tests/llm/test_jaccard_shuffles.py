"""The similarity join sends its shingles through one shuffle a step, and texts only where they are chosen."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retention.llm import ngram_jaccard

WORDS = [f"w{k}" for k in range(40)]


@pytest.fixture(scope="module")
def rows(spark):
    texts = [" ".join(WORDS), " ".join([*WORDS[:-1], "other"]), " ".join(WORDS), None, "", "a b", "a b", *(
        " ".join(f"own{d} {w}" for w in WORDS) for d in range(30))]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture
def written(monkeypatch):
    """The optimized plan of each scratch table by its name."""
    plans, write = {}, ngram_jaccard.materialize

    def keep(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(ngram_jaccard, "materialize", keep)
    return plans


def test_shingles_are_shuffled_once_a_step(rows, written):
    got = {r["doc"]: r["component"] for r in ngram_jaccard.similar(rows, n=3, percent=90)[0].filter(F.col("n_shingles") > 0).collect()}
    assert {d for d, c in got.items() if c == 0} == {0, 1, 2} and got[5] == got[6] == 5
    assert all(got[d] == d for d in range(7, 37))
    # an exploded list that is counted and then joined with its counts is read and shuffled twice
    assert written["jaccard-chosen"].count("Generate explode") == 1
    assert written["jaccard-ordered"].count("Generate explode") == 1


def test_texts_of_unchosen_rows_are_left_out_before_the_join(spark):
    keys = spark.range(2000).select(F.col("id").alias("doc"), F.xxhash64("id").alias("part"))
    chosen = keys.filter("doc % 10 = 0").withColumn("node", F.col("doc"))
    left = ngram_jaccard.marked(keys.union(spark.createDataFrame([(None, 1)], "doc long, part long")), chosen)
    assert left.columns == ["doc", "part"]
    assert left.join(chosen, ["doc", "part"]).count() == 200  # a chosen row is never lost
    assert left.count() < 300
    assert ngram_jaccard.marked(keys, chosen.limit(0)).count() == 0
    every_bit = ngram_jaccard.marked(keys.unionByName(keys), keys).count()
    assert every_bit == 4000  # also bit 63 of a word, and copies
