"""Exact dedup, VA-file clustering and token alignment against brute force on small fixtures, and their
registered queries against SQL or brute force on whole small tables."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from retention.llm import exact_dedup, token_alignment, va_clustering

SMALL = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, run int, sha string, first string, row long, block long, id long, n_a long"


def _rows(texts):
    return [(k, t, 1, "s", "f", 2, 3, 4, 5) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice(["ab", "cd", "e", "  fg", "h\t", "é", "日本"]) for _ in range(rnd.randint(1, 6))) for _ in range(120)]
    return base + [None, "", " \n", "\x0b\x0c\r", "a b", "ab", "a  b", " ab", "<|endoftext|>", "<s> x </s>", "▁x", "x" * 30000, "word " * 8000] + ["many"] * 300 + [" many"] * 40


def _dedup_brute(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = collections.Counter()
    for plain, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out[(m[3], members[0][3], len(members), k == 0, hashlib.sha256(plain.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("parts,fan_in", [(1, 16), (7, 2), (40, 3)])
def test_exact_dedup(spark, texts, parts, fan_in):
    rows = _rows(texts)
    rows += [rows[3]] * 5 + [(None, "ab", *rows[0][2:]), (None, "no id", *rows[0][2:]), (7, "seven again", *rows[0][2:]), (7, "se ven again", *rows[0][2:])]
    docs = spark.createDataFrame(rows, CLASH).repartition(parts)
    got = collections.Counter(tuple(r) for r in exact_dedup.ledger(docs, fan_in=fan_in).collect())
    assert got == _dedup_brute([r[:2] for r in rows])
    kept = exact_dedup.keep_one(docs, fan_in=fan_in)
    assert kept.columns == docs.columns
    want = collections.Counter(k[0] for k, n in got.items() if k[3] for _ in range(n))
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == want


def test_exact_dedup_empty(spark):
    nothing = spark.createDataFrame([], CLASH)
    assert exact_dedup.ledger(nothing).count() == 0 and exact_dedup.keep_one(nothing).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.ledger(nothing, fan_in=1)


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.ledger(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def _cluster_brute(rows, k, rounds, dims, scale):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) * scale < 2**27 for x in v)]
    if not kept:
        return [], np.zeros((0, dims), int)
    full = np.floor(scale * np.array([v for _, v in kept])).astype(np.int64)
    key = lambda j: (hashlib.sha256(f"1:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), full[j].tolist())
    centroids = full[sorted(range(len(kept)), key=key)[:k]].copy()
    for last in range(rounds + 1):
        distance = ((full[:, None, :] - centroids[None]) ** 2).sum(2)
        at = distance.argmin(1)
        if last < rounds:
            for c in range(len(centroids)):
                if (at == c).any():
                    centroids[c] = full[at == c].sum(0) // (at == c).sum()
    return [(kept[j][0], int(at[j]), int(distance[j, at[j]])) for j in range(len(kept))], centroids


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_clustering(spark, bits):
    rnd = random.Random(bits)
    rows = [(k, [rnd.gauss(k % 5, 1) for _ in range(6)]) for k in range(400)]
    rows += [(500 + k, list(rows[3][1])) for k in range(50)]  # repeated vectors under other ids
    rows += [rows[9], rows[9], (9, [0.0] * 6), (None, [1.0] * 6), (700, None), (701, []), (702, [1.0] * 5), (703, [None] * 6),
             (704, [float("nan")] * 6), (705, [float("inf")] * 6), (706, [1e300] * 6), (707, [-2.0e6] * 6), (708, [0.0, -0.0, 1e-9, -1e-9, 0.5, -0.5])]
    vectors = spark.createDataFrame([(i, v, "r", 1, "c") for i, v in rows], "vec_id long, embedding array<double>, row string, cluster int, cells string").repartition(5)
    got, centroids, fetched = va_clustering.cluster(vectors, k=7, rounds=3, dims=6, bits=bits, sample=100)
    want, expected = _cluster_brute(rows, 7, 3, 6, 64)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert (centroids == expected).all() and len(fetched) == 2
    if bits == 6:
        assert max(fetched) < len(want)  # the cells alone decide some


def test_clustering_small(spark):
    schema = "vec_id long, embedding array<double>"
    assert va_clustering.clustered(spark.createDataFrame([], schema)).count() == 0
    assert va_clustering.clustered(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    one = va_clustering.clustered(spark.createDataFrame([(1, [0.25] * 64)], schema)).collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, 0, hashlib.sha256(",".join(["16"] * 64).encode()).hexdigest())]


def test_cells():
    values = np.array([-5, -1, 0, 0, 1, 2, 90])
    for cells in (2, 4, 8, 256):
        bounds = va_clustering.split_range(-5, 91, values, cells)
        assert len(bounds) == cells + 1 and bounds == sorted(bounds) and bounds[0] == -5 and bounds[-1] == 91
    v = np.random.default_rng(1).integers(-50, 50, (200, 9))
    bounds = np.array([va_clustering.split_range(int(c.min()), int(c.max()) + 1, c, 16) for c in v.T])
    cells = va_clustering.to_cells(v, bounds)
    d = np.arange(9)
    assert ((bounds[d, cells] <= v) & (v < bounds[d, cells + 1])).all()
    assert (va_clustering.unpack(va_clustering.pack(cells, 4), 9, 4) == cells).all()
    centres = v[:5]
    least, greatest = va_clustering.intervals(cells, va_clustering.lookup(centres, bounds))
    exact = ((v[:, None] - centres[None]) ** 2).sum(2)
    assert (least <= exact).all() and (exact <= greatest).all()


def _align_brute(rows):
    a, b = (t.of for t in token_alignment.pair_of(token_alignment.TOKENIZERS))
    out, every = [], collections.Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = a.of.encode(" " + (text or ""), add_special_tokens=False).ids, b.of.encode(text or "")
        if not text or b"".join(a.bytes[k] for k in ids_a) != whole or b"".join(b.bytes[k] for k in ids_b) != whole:
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(t.bytes[k]) for k in ids]).tolist() for t, ids in ((a, ids_a), (b, ids_b))]
        links = [(x, y) for x, p, q in zip(ids_a, [0, *ends[0]], ends[0]) for y, s, e in zip(ids_b, [0, *ends[1]], ends[1]) if s < q and p < e]
        shared = sorted(set(ends[0]) & set(ends[1]))
        of = lambda ids, ends, low, high: ",".join(str(k) for k, e in zip(ids, ends) if low < e <= high)
        groups = ";".join(of(ids_a, ends[0], p, q) + "|" + of(ids_b, ends[1], p, q) for p, q in zip([0, *shared], shared))
        every.update(links)
        out.append((doc_id, len(ids_a), len(ids_b), len(shared), links, hashlib.sha256(groups.encode()).hexdigest()))
    top = {}
    for (_, y), n in every.items():
        top[y] = max(top.get(y, 0), n)
    return collections.Counter((d, x, y, g, len(p), sum(every[q] == top[q[1]] for q in p), sum(every[q] for q in p), h) for d, x, y, g, p, h in out)


def test_alignment(spark, texts):
    short = [t for t in texts if len(t or "") < 2000] + ["y" * 300, "many words " * 60, "\x00", "\U0001f600 é é", "a\r\n\tb  c  "]
    rows = _rows(short)
    rows += [rows[2], (5, "five again", *rows[0][2:]), (None, "no id", *rows[0][2:])]
    docs = spark.createDataFrame(rows, CLASH).repartition(4)
    want = _align_brute([r[:2] for r in rows])
    for size in (400, 10**6):
        assert collections.Counter(map(tuple, token_alignment.align_corpus(docs, block_chars=size).collect())) == want
    assert token_alignment.align_corpus(docs.filter("false")).count() == 0


def test_alignment_of_long_text(spark):
    docs = spark.createDataFrame([(1, "some words and numbers 12 " * 20000), (2, "z" * 50000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in token_alignment.align_corpus(docs).collect()}
    assert all(r["n_links"] >= max(r["n_a"], r["n_b"]) and r["n_groups"] > 0 for r in rows.values())


def test_ranks_equal_the_tokenizer_file():
    a = token_alignment.pair_of(token_alignment.TOKENIZERS)[0].of
    assert a.ranked is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"x{c}y {c} 1{c}2 !{c}? {c}{c}a  {c}  \n" for c in points] + [c * n for c in (" ", "\n", " \t", "x", "é1") for n in (9_999, 10_000, 400_000)]
    for start in range(0, len(texts), 50_000):
        part = texts[start:start + 50_000]
        assert a.encode(part) == [e.ids for e in a.of.encode_batch_fast([" " + t for t in part], add_special_tokens=False)]


def test_gallop():
    rnd = random.Random(2)
    for _ in range(200):
        long = sorted(rnd.sample(range(1, 400), rnd.randint(1, 300)))
        short = sorted(rnd.sample(range(1, 400), rnd.randint(1, 300)))
        short = [x for x in short if x <= long[-1]]
        assert token_alignment.gallop(short, long) == [sum(y < x for y in long) for x in short]


@pytest.mark.parametrize("name,table", [("op11_exact_dedup", "documents"), ("op12_va_clustering", "embeddings")])
def test_queries_equal_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    found = entry.queries()[name](spark, SMALL)
    want = con.sql(entry.oracle_sql()[name])
    assert found.columns == want.columns
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want.fetchall())


def test_alignment_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1] or "") < 1200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(map(tuple, token_alignment.align_corpus(docs).collect()))
    assert got == _align_brute(rows)
    assert entry.queries()["op13_token_alignment"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
