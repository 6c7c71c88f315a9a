"""The registered queries of this package: thin digests of each operator over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup,
    html_extract,
    language_id,
    license_scan,
    maxscore,
    mixing,
    ngram_jaccard,
    quality_classifier,
    quality_rules,
    sp_viterbi,
    substring_dedup,
    token_alignment,
    va_clustering,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document; sources weigh 5, 2, 1, repeating, at most 3 repeats."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"))


@_query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.summarize(license_scan.scan(docs))


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the current policy's verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_policy(quality_rules.ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits", "base_failed", "kept")


@_query
def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors, by integer inner product, for every vector whose id is divisible by 50."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sp_viterbi.encode(docs, check_col="round_trip").select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@_query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.predict(docs, model).select(
        "doc_id", quality_classifier.held_out().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after repeated 35-word windows are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more, with
    the class (equal sets) of each and how many other classes that one is linked with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_jaccard.components(docs, n=3, percent=90)
    public = lambda c: F.when(F.col(c) < ngram_jaccard.NO_ID, F.col(c))
    return found.select(public("doc").alias("doc_id"), "n_shingles", public("component").alias("component_id"),
                        public("class").alias("class_id"), "n_links")


@_query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each group of equal texts stays, for every document."""
    return exact_dedup.ledger(table(spark, sf_dir, "documents"))


@_query
def op12_va_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings after 3 rounds from 16 hashed starts."""
    return va_clustering.clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment groups and links of two tokenizers over every document."""
    return token_alignment.align_corpus(table(spark, sf_dir, "documents"))


ORACLES["op11_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id)
"""

# one step for each round: nearest centroid (ties: smaller number), then the floor of the mean
_ROUND = """
a{r} AS (
  SELECT vec_id, arg_min(c, struct_pack(d := d, c := c)) AS c FROM (
    SELECT v.vec_id, k.c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d FROM v JOIN c{p} k ON v.i = k.i GROUP BY v.vec_id, k.c)
  GROUP BY vec_id),
c{r} AS (
  SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM c{p} k LEFT JOIN (
    SELECT a.c, v.i, floor(sum(v.x)::DECIMAL(38, 0) / count(*))::BIGINT AS x FROM a{r} a JOIN v ON a.vec_id = v.vec_id GROUP BY a.c, v.i) m
  ON k.c = m.c AND k.i = m.i),
"""
ORACLES["op12_va_clustering"] = """
WITH usable AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS (
  SELECT vec_id, unnest(range(64)) AS i, unnest([floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding]) AS x FROM usable),
chosen AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM usable QUALIFY c < 16),
c0 AS (SELECT chosen.c, v.i, v.x FROM chosen JOIN v ON chosen.vec_id = v.vec_id),
""" + "".join(_ROUND.format(r=r, p=r - 1) for r in (1, 2, 3)) + """
last AS (
  SELECT vec_id, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
    SELECT v.vec_id, k.c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d FROM v JOIN c3 k ON v.i = k.i GROUP BY v.vec_id, k.c)
  GROUP BY vec_id),
names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, last.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY last.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM last JOIN names ON last.c = names.c
"""

ORACLES["op2_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i,
         unnest([md5(array_to_string(w[j:j + 34], ' ')) FOR j IN range(1, len(w) - 33)]) AS h
  FROM d WHERE len(w) >= 35),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM repeated),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLES["op3_maxscore"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
