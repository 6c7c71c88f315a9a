"""Query blocks and shards meet in a stream: nothing goes through the driver, and groups of several shards give exact results."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from retention.llm import maxscore

SCHEMA = "vec_id long, embedding array<double>"


def _brute(rows, asks, k=5):
    quantized = sorted({(i, tuple(int(256 * x // 1) for x in v)) for i, v in rows})
    copies = collections.Counter((i, tuple(int(256 * x // 1) for x in v)) for i, v in rows)
    want = collections.Counter()
    for q, own in quantized:
        if asks(q):
            scored = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in quantized if i != q for _ in range(copies[i, v])]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k]))
    return want


def _found(df, condition, **kw):
    return collections.Counter(tuple(r) for r in maxscore.top_k(df, condition, **kw).collect())


def test_nothing_is_broadcast(spark):
    """Spark's estimate of the blocks, all copies for all shards, is far below their size: a join of them with the shards
    sends them to the driver."""
    rows = [(k, [float(k % 7), float(k % 11), 1.0]) for k in range(400)]
    found = maxscore.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 5 == 0, shard_rows=20, block_rows=10)
    assert collections.Counter(tuple(r) for r in found.collect()) == _brute(rows, lambda q: q % 5 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "mapInArrow" in plan or "MapInArrow" in plan
    assert "Broadcast" not in plan


def test_a_block_goes_once_to_a_group(spark, monkeypatch):
    """Blocks are repeated for each group of shards, and groups grow to ``held`` components."""
    rnd = random.Random(3)
    rows = [(k, [rnd.uniform(-1, 1) for _ in range(8)]) for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    ask = F.col("vec_id") % 20 == 0
    kw = {"shard_rows": 10, "block_rows": 10, "least_groups": 4, "held": 10**6}
    assert _found(df, ask, **kw) == _brute(rows, lambda q: q % 20 == 0)
    assert _found(df, ask, **kw | {"held": 8 * 60}) == _found(df, ask, **kw)

    def seen(k):
        import pyarrow as pa

        def run(batches):
            for b in batches:
                own = [len(x) for x in b.column("query_ids").to_pylist()]
                n, ids = pa.array(own, pa.int64()), pa.array([len(x) for x in b.column("ids").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), n, ids, ids], names=["query_id", "vec_id", "score", "asked"])

        return run

    monkeypatch.setattr(maxscore, "_pairs", seen)
    for held, groups in ((10**6, 4), (8 * 60, 10)):
        found = maxscore.top_k(df, ask, k=10**6, **kw | {"held": held}).collect()
        assert sum(r["vec_id"] for r in found) == 30 * groups and sum(r["score"] for r in found) == 600


@pytest.mark.parametrize("size", [1, 2**15, 2**21])
def test_exact_for_sums_of_any_size(spark, size):
    """Single, double and whole numbers of any size; lengths differ, many scores are equal, ids repeat."""
    rnd = random.Random(size)
    rows = [(rnd.randrange(150), [rnd.choice([0.0, 0.5, size, -size, rnd.uniform(-size, size)]) for _ in range(rnd.choice([3, 6, 6, 6]))]) for _ in range(300)]
    rows += [(500 + k, [size, 1.0]) for k in range(40)] + rows[:30]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _found(df, F.col("vec_id") % 10 == 0, shard_rows=60, block_rows=7, least_groups=2) == _brute(rows, lambda q: q % 10 == 0)


def test_terms_are_pruned_exactly():
    """Long vectors of uneven components, block by block against brute force: non-essential terms are probed for few vectors."""
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = np.floor(rng.normal(0, 1, (3000, 200)) * np.linspace(200, 1, 200) ** 1.3 / 10).astype(np.int64)
    ids, own = rng.permutation(3000), np.arange(0, 3000, 60)
    queries = vectors[np.searchsorted(np.sort(ids), own)]
    for kind in (np.float64, object):
        best = maxscore.Best.none(len(own), 5, kind)
        for a in range(0, 3000, 1500):
            shard = maxscore.Shard.of(ids[a:a + 1500], vectors[a:a + 1500]).typed(kind)
            maxscore.search_shard(queries.astype(kind), own, shard, best, tile=400)
        scores = queries @ vectors.T
        for i, q in enumerate(own):
            want = sorted((-int(s), int(v)) for s, v in zip(scores[i], ids) if v != q)[:5]
            assert [(-int(s), int(v)) for s, v in zip(best.scores[i], best.ids[i])] == want
