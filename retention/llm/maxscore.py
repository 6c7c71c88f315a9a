"""Exact top-k inner-product search with MaxScore.

A vector is a document whose terms are its components; the inner product is the sum of its term
scores.  Candidates are dealt by hash into shards, shards into groups, queries into blocks.  A task
holds the shards of one group, bounded by components, and the query blocks stream past them, so
neither side is ever held whole, in a task or in the driver.  For a block and a shard, per query:

* a term's bounds are its least and largest score over the shard;
* the threshold is the query's k-th best score so far, also over the group's shards before this one
  (first vectors of the first shard set it);
* terms stand in one order for the block, widest ranges first; the last ones, as long as their ranges
  together can't lift a vector over the threshold of any query, are non-essential; the others are
  essential;
* essential postings are traversed for all vectors of the shard at once, and the non-essential ones are
  probed, widest first, only for vectors whose partial score plus the remaining bound still
  reaches the threshold (equal scores stay, as ties go to the smaller id).

The survivors' scores are exact integers.  Each group returns at most k rows a query, and the merge
keeps the best k of those.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part;
vectors of different lengths compare over their common components; repeated rows are separate
candidates (a query never meets rows of its own id) but one query; rows that share an id but not their
vector are separate queries, each with its own k best; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded

# sums below each bound, and their differences, are exact in the type; beyond, whole numbers of any size
KINDS = [(2.0**23, np.float32), (2.0**52, np.float64), (float("inf"), object)]
HELD = 2**24  # components a task holds at once, about


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x), x as double, for vectors whose components are all finite, else null."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = (F.size(vector) > 0) & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def _kind(reach: float) -> int:
    return next(i for i, (bound, _) in enumerate(KINDS) if reach < bound)


def _most(m: np.ndarray) -> float:
    return max(float(m.max(initial=0)), -float(m.min(initial=0)))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows, shorter ones filled up with zeros."""
    offsets = vectors.offsets.to_numpy()
    flat, sizes = vectors.values.to_numpy()[offsets[0]:offsets[-1]], np.diff(offsets)
    if (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    m = np.zeros((len(sizes), sizes.max()), np.int64)
    m[np.arange(m.shape[1]) < sizes[:, None]] = flat
    return m


@dataclass
class Shard:
    """``postings`` is term-major (terms x vectors), with the least and largest component of each term;
    the vectors stand in order of their ids."""

    ids: np.ndarray
    postings: np.ndarray
    low: np.ndarray
    high: np.ndarray
    most: float

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Shard:
        order = np.argsort(ids, kind="stable")
        most = _most(vectors)
        postings = np.ascontiguousarray(vectors[order].T.astype(KINDS[_kind(most)][1]))
        return cls(ids[order], postings, postings.min(axis=1), postings.max(axis=1), most)

    def typed(self, kind: type) -> Shard:
        if self.postings.dtype == kind:
            return self
        # by way of integers, as whole numbers of any size must not be made of doubles
        to = lambda x: x.astype(np.int64).astype(kind)
        return Shard(self.ids, to(self.postings), to(self.low), to(self.high), self.most)


@dataclass
class Best:
    """The k best of each query of a block so far, best first; free places hold -inf."""

    ids: np.ndarray
    scores: np.ndarray

    @classmethod
    def none(cls, n: int, k: int, kind: type) -> Best:
        return cls(np.zeros((n, k), np.int64), np.full((n, k), -np.inf, kind))

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of the vectors ``ids`` for the queries in the places ``at``."""
        least = self.scores[at, -1]
        better = (scores > least) | ((scores == least) & (ids < self.ids[at, -1]) & (scores > -np.inf))
        at, ids, scores = at[better], ids[better], scores[better]
        if not len(at):
            return
        k = self.ids.shape[1]
        changed = np.unique(at)
        at = np.concatenate([np.repeat(changed, k), at])
        ids = np.concatenate([self.ids[changed].ravel(), ids])
        scores = np.concatenate([self.scores[changed].ravel(), scores])
        order = np.lexsort((ids, -scores, at))
        starts = np.searchsorted(at[order], changed)
        places = order[starts[:, None] + np.arange(k)]
        self.ids[changed], self.scores[changed] = ids[places], scores[places]


def search_shard(queries: np.ndarray, own: np.ndarray, shard: Shard, best: Best, first: int = 256, tile: int = 1024,
                 step: int = 32, few: float = 1 / 16) -> None:
    """MaxScore of a block of queries (rows) over one shard, added to ``best``.  ``tile`` vectors are
    scored at once, by ``step`` terms until no more than the share ``few`` of their scores is alive."""
    width, k = min(queries.shape[1], len(shard.postings)), best.ids.shape[1]
    queries = queries[:, :width]
    ends = queries * shard.low[:width], queries * shard.high[:width]
    floor, top = np.minimum(*ends), np.maximum(*ends)
    order = np.argsort(-(top - floor).sum(axis=0), kind="stable")  # widest first
    q, floor, top = (np.ascontiguousarray(x[:, order]) for x in (queries, floor, top))
    none = np.zeros((len(q), 1), q.dtype)
    rest = np.concatenate([np.cumsum(top[:, ::-1], axis=1)[:, ::-1], none], axis=1)  # bound of the terms from here on
    reach = np.concatenate([none, np.cumsum(floor, axis=1)], axis=1) + rest  # bound where the terms before are at their floors
    starts = range(0, len(shard.ids), tile) if (best.scores[:, -1] > -np.inf).all() else [0, *range(first, len(shard.ids), tile)]
    for start, end in zip(starts, [*starts[1:], len(shard.ids)], strict=True):
        ids, postings, threshold = shard.ids[start:end], shard.postings[order, start:end], best.scores[:, -1]
        # essential: all but the narrow terms that alone, on top of every other term's floor, stay below the threshold
        t = max(1, int((reach[:, :width] >= threshold[:, None]).sum(axis=1).max(initial=0)))
        partial = q[:, :t] @ postings[:t]
        mine = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i in np.flatnonzero(mine[0] < mine[1]).tolist():
            partial[i, mine[0][i]:mine[1][i]] = -np.inf  # a query never meets its own id
        if t == width and len(ids) > k and (threshold == -np.inf).any():
            threshold = np.maximum(threshold, np.partition(partial, len(ids) - k, axis=1)[:, len(ids) - k])
        while True:
            alive = partial >= (threshold - rest[:, t])[:, None]
            if t == width or np.count_nonzero(alive) <= few * alive.size:
                break
            more = min(width, t + step)
            partial += q[:, t:more] @ postings[t:more]
            t = more
        hit = np.flatnonzero(alive.any(axis=1))  # few queries: nonzero() of all is slow
        at, places = np.nonzero(alive[hit])
        at = hit[at]
        scores = partial[at, places]
        while t < width and len(at):
            more = min(width, t + 4)
            scores = scores + (q[at, t:more] * postings[t:more, places].T).sum(axis=1)
            t = more
            keep = scores + rest[at, t] >= threshold[at]
            at, places, scores = at[keep], places[keep], scores[keep]
        best.add(at, ids[places], scores)


def _pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            for row in range(batch.num_rows):
                values = {n: batch.column(n)[row] for n in batch.schema.names}
                if values["group"].as_py() != group:
                    held, group = [], values["group"].as_py()
                if len(values["ids"].values):  # the shards of a group come before its queries
                    held.append(Shard.of(values["ids"].values.to_numpy(), _matrix(values["vectors"].values)))
                    continue
                own, queries = values["query_ids"].values.to_numpy(), _matrix(values["queries"].values)
                reach = max((s.most * len(s.postings) for s in held), default=0.0) * _most(queries)
                kind = KINDS[max([_kind(reach), _kind(_most(queries)), *(_kind(s.most) for s in held)])][1]
                queries, best = queries.astype(kind), Best.none(len(own), k, kind)
                for shard in held:
                    search_shard(queries, own, shard.typed(kind), best)
                full = best.scores > -np.inf
                at = np.nonzero(full)[0]
                scores = [max(-(2**63), min(2**63 - 1, int(s))) for s in best.scores[full].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at], pa.int64()), pa.array(best.ids[full], pa.int64()), pa.array(scores, pa.int64()),
                     pa.array(values["asked"].values.to_numpy()[at], pa.int64())],
                    names=["query_id", "vec_id", "score", "asked"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          shard_rows: int = 4096, block_rows: int = 512, scale: int = 256, least_groups: int = 64, held: int = HELD) -> DataFrame:
    """The k best other rows for every row that the condition ``queries`` selects:
    query_id, rank, vec_id, score.

    Shards and query blocks hold about ``shard_rows`` and ``block_rows`` vectors each, groups of shards
    about ``held`` components or fewer, whatever the size of the table; their number grows with it.
    The table is counted first for that.  Each query block goes once to every group."""
    columns = F.col(id_col).cast("long").alias("id"), quantized(F.col(vec_col), scale).alias("v")
    usable = F.col("id").isNotNull() & F.col("v").isNotNull()
    n, asked, cells = vectors.select(
        F.count(F.lit(1)), F.count_if(queries), F.coalesce(F.sum(F.greatest(F.size(vec_col), F.lit(0))), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    groups = min(shards, max(least_groups, -(-cells // held)))
    # spread by hash of id, vector and number of the copy, so rows that share an id or a vector, or both, spread too
    pack = lambda rows, parts, name, **fields: (
        rows.groupBy(F.pmod(F.xxhash64("id", "v", "copy", F.lit(17)), F.lit(parts)).cast("int").alias(name))
        .agg(F.collect_list(F.struct(*[c.alias(f) for f, c in fields.items()])).alias("rows"))
        .select(name, *[F.col("rows")[f].alias(f) for f in fields]))
    # no answer holds more than k copies of a row, so k of them stand for any number
    copies = vectors.select(*columns).filter(usable).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))))
    cand = pack(copies, shards, "shard", ids=F.col("id"), vectors=F.col("v"))
    asks = pack(vectors.filter(queries).select(*columns).filter(usable).dropDuplicates(["id", "v"]).withColumn("copy", F.lit(1).cast("long")),
                blocks, "block", query_ids=F.col("id"), queries=F.col("v"), asked=F.xxhash64("v"))
    # each query block goes to every group: the pairs that an exact search over all rows must visit.  They meet in
    # a sorted stream, as Spark may broadcast the blocks of a join, all copies for all groups, through the driver
    no_ids, no_vectors = F.array().cast("array<long>"), F.array().cast("array<array<long>>")
    work = cand.select(
        F.pmod("shard", F.lit(groups)).alias("group"), F.lit(0).alias("turn"), "ids", "vectors",
        no_ids.alias("query_ids"), no_vectors.alias("queries"), no_ids.alias("asked"),
    ).union(asks.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("turn"), no_ids.alias("ids"), no_vectors.alias("vectors"),
        "query_ids", "queries", "asked"))
    work = bounded(work.repartitionById(groups, F.col("group"))).sortWithinPartitions("group", "turn").drop("turn")
    found = work.mapInArrow(_pairs(k), "query_id long, vec_id long, score long, asked long")
    place = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
