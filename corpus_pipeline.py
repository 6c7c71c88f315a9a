"""A corpus pipeline over the text operators: each stage reads what its predecessor kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its rows are written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retention.llm import language_id, mixing, ngram_jaccard, sp_viterbi, substring_dedup
from retention.llm.common import materialize, table

MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language no model supports with half the
    evidence or more."""
    found = language_id.identify(docs, pred_col="__lang", score_col="__score")
    return found.filter((F.col("__lang") != "und") & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return ngram_jaccard.keep_one(docs, n=5, percent=80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in 35-word windows that occur elsewhere; other texts stay as they are."""
    done = substring_dedup.dedup(docs)
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*[own[c].alias(c) if c in own else F.col("doc")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weights 5, 2, 1, repeating, at most 3 repeats: a row for each copy."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    coded = sp_viterbi.encode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # language ID and piece encoding are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
