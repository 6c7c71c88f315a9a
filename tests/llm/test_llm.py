"""Text operators against brute force on small fixtures with nulls, empty and long texts, repeated
rows, ties, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from retention.llm import (
    html_extract, language_id, license_scan, maxscore, mixing, ngram_jaccard, quality_classifier, quality_rules, sp_viterbi, substring_dedup,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, doc string, part string, component long"


def _texts():
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    base, passage = words(150), words(60)
    out = [" ".join(base)] * 3 + [None, "", " \n\t ", "one", "One TWO", "a b\nc", "x " * 90 + "\n" + "x " * 90]
    for k in range(12):  # near copies of one text
        near = list(base)
        near[k * 9] = f"new{k}"
        out.append(" ".join(near))
    out += [" ".join(words(40) + passage + words(20 + k)) for k in range(6)]  # a shared passage
    out += [" ".join(words(rnd.choice([5, 36, 80, 200]))) for _ in range(25)]
    out.append(" ".join(words(6000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", "c", None][k % 4], len(t or ""), 1, "d", "p", 7) for k, t in enumerate(_texts())]
    rows += [rows[12], (None, "no id here at all " * 10, "en", "a", 1, 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(spark, docs, nothing):
    rows = mixing.mix_plan(docs, blocks=64).collect()
    assert len(rows) == docs.count()
    again = mixing.mix_plan(docs.repartition(3), blocks=64).collect()
    key = lambda r: (r["id"] is None, r["id"] or 0, r["size"], [tuple(p) for p in r["parts"]])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    by_source = {}
    for r in rows:
        taken = sum(p["words"] for p in r["parts"])
        assert taken <= 3 * r["size"] and all(0 <= p["shard"] < 16 for p in r["parts"])
        s = by_source.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += taken
        s[3] += r["size"]
    total = sum(s[0] for s in by_source.values())
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5]))
    want, capped = {}, set()
    while True:  # share, cap, share the excess again
        left = total - sum(3 * by_source[s][0] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        want = {s: 3 * by_source[s][0] if s in capped else left * w / free for s, w in weights.items()}
        over = {s for s in weights if s not in capped and want[s] > 3 * by_source[s][0] + 1e-9}
        if not over:
            break
        capped |= over
    for s, (size, target, taken, own) in by_source.items():
        assert size == own and target == pytest.approx(want[s]) and abs(taken - target) <= 1
    mixed = mixing.mix(docs, blocks=64)
    assert mixed.columns == docs.columns
    got = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {s: v[2] for s, v in by_source.items() if v[2]}
    assert mixing.mix_plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_splitting_tree_is_exact(spark):
    urn = spark.range(1).select(F.array(*[F.lit(n).cast("long") for n in (0, 1, 997, 40_000, 13)]).alias("q"))
    rows = mixing.splitting_tree(urn, 7, 1).collect()
    assert len(rows) == 35 and all(r["quota"] >= 0 for r in rows)
    for rank, n in enumerate((0, 1, 997, 40_000, 13)):
        assert sum(r["quota"] for r in rows if r["rank"] == rank) == n
    totals = [sum(r["quota"] for r in rows if r["shard"] == s) for s in range(7)]
    assert max(totals) - min(totals) <= 2
    big = [r["quota"] for r in rows if r["rank"] == 3]
    assert len(set(big)) > 1 and max(big) - min(big) < 400  # drawn, not dealt evenly, and near the mean


def test_substring_dedup(spark, docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    seen = {}
    for r in rows:
        w = WORD.findall(r["text"] or "")
        for i in range(len(w) - 34):
            seen[tuple(w[i:i + 35])] = seen.get(tuple(w[i:i + 35]), 0) + 1
    want = []
    for r in rows:
        w = WORD.findall(r["text"] or "")
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((str(r["doc_id"]), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    done = substring_dedup.dedup(docs)
    got = [(str(r["doc"]["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in done.collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
    assert substring_dedup.dedup(nothing).count() == 0


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_jaccard(spark, docs, nothing, n, percent):
    rows = docs.filter("doc_id is not null").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = WORD.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r["doc_id"]] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], moved = label[b], True
    found = ngram_jaccard.components(docs, n=n, percent=percent).collect()
    assert len(found) == docs.count()
    got = {r["doc"]: (r["n_shingles"], r["component"]) for r in found if r["doc"] < ngram_jaccard.NO_ID}
    assert got == {d: (len(sets[d]), label[d]) for d in sets}
    kept = ngram_jaccard.keep_one(docs, n=n, percent=percent)
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == sorted({label[d] for d in sets})
    assert kept.columns == docs.columns
    assert ngram_jaccard.components(nothing).count() == 0


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_jaccard_links(spark, docs, n, percent):
    """Every link between different texts, also inside a component, and their number for every row."""
    rnd = random.Random(11)
    base = [f"v{k}" for k in range(160)]
    texts = [" ".join(w if i not in gone else f"z{k}" for i, w in enumerate(base)) for k in range(60) for gone in [{rnd.randrange(160) for _ in range(k % 4)}]]
    more = spark.createDataFrame([(2000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    all_docs = docs.filter("doc_id is not null").select("doc_id", "text").union(more)
    sets = {}
    for r in all_docs.collect():
        w = WORD.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r["doc_id"]] = frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    reps = sorted(d for s, d in first.items() if s)
    want = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    rows, pairs = ngram_jaccard.similar(all_docs, n=n, percent=percent)
    got = [tuple(r) for r in pairs.select("a", "b").collect()]
    assert sorted(got) == sorted(want) and len(want) > 200
    for r in rows.collect():
        c = first[sets[r["doc"]]] if sets[r["doc"]] else r["doc"]
        assert (r["class"], r["n_links"]) == (c, sum(c in p for p in want))


def test_ngram_jaccard_blocks(spark):
    """Links inside a component are the same however small its blocks are."""
    rnd = random.Random(2)
    sets = {d: sorted(set(range(100)) - {rnd.randrange(100) for _ in range(rnd.choice([0, 3, 9]))} | {1000 + d}) for d in range(40)}
    first = spark.createDataFrame([(d, d // 37 * 37) for d in sets], "id long, component long")
    full = spark.createDataFrame(list(sets.items()), "doc long, grams array<long>")
    want = {(a, b) for a in sets for b in sets if a != b and a // 37 == b // 37
            and 100 * len({*sets[a]} & {*sets[b]}) >= 90 * len({*sets[a]} | {*sets[b]})}
    for size in (3, 256):
        found = ngram_jaccard.within(first, full, 90, 8, block_docs=size)
        assert sorted(tuple(r) for r in found.select("doc", F.explode("near")).collect()) == sorted(want)


def test_connected_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in ngram_jaccard.connected(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_maxscore(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.choice([-0.5, 0.0, 0.25, rnd.uniform(-1, 1)]) for _ in range(8)]) for k in range(700)]
    rows[3], rows[5], rows[9], rows[11] = (3, None), (5, [None] * 8), (9, [float("nan")] * 8), (11, [])
    rows += [(50, rows[50][1]), (701, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)]
    want = set()
    for q in {i for i, _ in usable if i % 50 == 0}:
        for own in [v for i, v in usable if i == q][:1]:
            best = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = {tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=90, block_rows=4).collect()}
    assert {(g[0], g[1], g[3]) for g in got} == {(w[0], w[1], w[3]) for w in want}
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_maxscore_repeated_ids(spark, monkeypatch):
    """A third of the rows share an id and another third are copies of one row: no shard outgrows the others."""
    rnd = random.Random(8)
    rows = [(k if k % 3 == 0 else 1, [1.0, 1.0] if k % 3 == 2 else [rnd.random(), rnd.random()]) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in maxscore.top_k(df, F.col("vec_id") == 300, shard_rows=100).orderBy("rank").collect()]
    own = [int(256 * x // 1) for x in rows[300][1]]
    best = sorted(((-sum(a * int(256 * x // 1) for a, x in zip(own, v)), i) for i, v in rows if i != 300))[:5]
    assert got == [(300, r + 1, i, -s) for r, (s, i) in enumerate(best)] and {i for _, i in best} == {1}

    def sizes(k):
        import pyarrow as pa

        def run(batches):
            for b in batches:
                n = pa.array([len(x) for x in b.column("ids").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([n, n, n, n], names=["query_id", "vec_id", "score", "asked"])

        return run

    monkeypatch.setattr(maxscore, "_pairs", sizes)
    largest = max(r["vec_id"] for r in maxscore.top_k(df, F.col("vec_id") == 300, shard_rows=100).collect())
    assert largest <= 200


def _best_pieces(model, text):
    """The best segmentation by a table over all boundaries of the whole text; ties go to the longest last piece."""
    w = " " + text
    scores = {p.replace("▁", " "): v for p, v in model["pieces"].items()}
    low = min(s for _, s in scores.values()) - 10 * sp_viterbi.UNIT
    longest = max(map(len, scores))
    best, back = [0.0], [None]
    for j in range(1, len(w) + 1):
        options = [(best[i] + scores[w[i:j]][1], -i, [scores[w[i:j]][0]]) for i in range(max(0, j - longest), j) if w[i:j] in scores]
        if w[j - 1] not in scores:
            options.append((best[j - 1] + low, 1 - j, [model["bytes"][x] for x in w[j - 1].encode()]))
        found = max(options)
        best.append(found[0])
        back.append((-found[1], found[2]))
    out, j = [], len(w)
    while j:
        out.append(back[j][1])
        j = back[j][0]
    return [x for ids in reversed(out) for x in ids]


def test_sentencepiece(spark, docs, nothing):
    rnd = random.Random(1)
    file = sp_viterbi.load()
    spanning = dict(file["pieces"])  # the same with pieces that cross spaces and line feeds
    for p in ("a▁t", "▁a▁the", "n▁▁", "e\nb", "\n", "he▁in▁a"):
        spanning[p] = (len(file["texts"]) + len(spanning), -float(rnd.randint(1, 9) * 1_000_000))
    for model in (file, sp_viterbi.load(scores="file"), file | {"pieces": spanning}):
        codec = sp_viterbi.Codec(model)
        texts = ["".join(rnd.choice("ab thein▁ \n\r\té日𐍈ly<>0x") for _ in range(rnd.randint(1, 80))) for _ in range(150)]
        texts += ["a the in a the\nbe " * 9, "=" * 300, "ab" * 400, "  \n\n  ", "\n", " ", "x" * 63 + " y", "x" * 64, "x" * 65]
        for s, ids in zip(texts, codec.encode_all(texts), strict=True):
            assert ids == _best_pieces(model, s), s
            assert ids == [x for some in codec.stream(s) for x in some]
            if model["pieces"] is not spanning:
                assert codec.decode(ids) == s
    codec = sp_viterbi.Codec(file)
    window = sp_viterbi.Window(codec)
    undecided = committed = 0
    words = "words go by and are committed on the way " * 50
    for c in " " + words:  # nothing waits for the end of the text
        committed += len(window.read(c))
        undecided = max(undecided, window.live[-1][2][2] - window.root[2])
    left = len(window.close())
    assert undecided <= 16 and left <= 2 and committed + left == len(codec.encode(words))
    long = "ab" * 5000
    assert codec.decode(codec.encode(long)) == long and codec.encode_all([None, ""]) == [None, []]
    clash = spark.createDataFrame([("a b", 7, "x")], "text string, ids int, decoded string")
    assert sp_viterbi.decode(sp_viterbi.encode(clash)).select("text", "decoded").collect() == [("a b", "a b")]
    with pytest.raises(ValueError):
        sp_viterbi.encode(clash, ids_col="text")
    coded = sp_viterbi.encode(docs.select("doc_id", "text"), check_col="same")
    back = sp_viterbi.decode(coded)
    assert back.filter(~F.col("text").eqNullSafe(F.col("decoded"))).isEmpty() and coded.filter("not same").isEmpty()
    assert sp_viterbi.encode(nothing).count() == 0


def test_license_scan(spark, nothing):
    texts = [None, "", "Plain words only", "Under the GNU General Public License, version 2.0 or later.", "CC BY-SA 4.0 and cc-by", "émit license",
             "MIT License. mit\nlicense!", "Licensed under the Apache License, Version 2.0. Apache license", "SPDX-License-Identifier: MPL-2.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.summarize(license_scan.scan(df)).collect()}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        places = sorted((i, lab) for p, lab in license_scan.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
        assert {x for _, x in places} <= set(r["labels"].split(","))
    assert "gpl-2.0-or-later" in got[3]["labels"] and "cc-by-sa-4.0" in got[4]["labels"] and "apache-2.0" in got[7]["labels"]
    assert got[8]["labels"] == "mpl-2.0" and got[5]["labels"] == ""
    for rule in license_scan.RULES:  # every keyword opens the gate
        assert any(w in rule["kw"] + rule["re"] for w in license_scan.GATE_WORDS) or rule["kw"].strip()[:3] in ("mpl", "epl", "cc ")
    assert license_scan.scan(nothing).count() == 0


def test_quality_rules(spark, docs, nothing):
    extra = spark.createDataFrame([(900, "a b c d e f a b c d e\n\nline x\nline x\n** $$"), (901, "!! " * 30)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    out = quality_rules.apply_policy(quality_rules.ledger(rows))
    for r in out.collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        cover = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)} if len(grams) < 500 else None
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        if cover is not None:
            assert r["n_repeat_words"] == len(cover)
            assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])
    rows_of = [r["failed_bits"] for r in out.collect()]
    for a in quality_rules.ablations(out).collect():
        mask, bit = quality_rules.POLICIES[a["policy"]], quality_rules.MASK[a["rule"]]
        assert a["failing"] == sum(b & bit != 0 for b in rows_of) and a["failing_only"] == sum(b & mask == bit for b in rows_of)
        assert a["kept"] == sum(b & mask == 0 for b in rows_of) and a["kept_without"] == sum(b & mask & ~bit == 0 for b in rows_of)
    assert quality_rules.ledger(nothing).count() == 0


def test_language_id(spark, nothing):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    edge = spark.createDataFrame([(5000, None, "en"), (5001, " 12 ?! ", "en"), (5002, "漢字", None), (None, "the", None)], df.schema)
    out = language_id.identify(df.union(edge)).collect()
    found = {r["doc_id"]: r for r in out}
    assert [found[d]["lang_pred"] for d in (5000, 5001)] == ["und", "und"] and found[5002]["lang_pred"] in ("de", "en", "es", "fr")
    test = [r for r in out if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] < 5000]
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.97 and all(0 <= r["lang_score"] <= 1 for r in out)
    assert language_id.identify(nothing).count() == 0


def test_language_id_few_rows_and_many_labels(spark):
    """A language of two rows keeps its words beside one with a vocabulary of 70,000, and every label is learned."""
    letters = lambda k, first: first + "".join(chr(97 + k // 26**i % 26) for i in range(4))
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    train_ids = [d for d in range(100_000) if not held(d)]
    test_id = next(d for d in range(100_000, 100_100) if held(d))
    large = [" ".join(letters(k, first) for k in range(a, a + 1000)) for first in ("", "x") for a in range(0, 70_000, 1000)] * 2
    own = " ".join(letters(k * 37, "x")[::-1] + "q" for k in range(200))
    rows = [(d, t, "large") for d, t in zip(train_ids, large)] + [(train_ids[-1], own, "small"), (train_ids[-2], own, "small"), (test_id, own, "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = language_id.train(df.filter(F.col("doc_id") != test_id))["tables"][0][0]
    assert len(words) == len({w for _, t, _ in rows for w in t.split()})  # none is cut
    out = language_id.identify(df)
    assert [r["lang_pred"] for r in out.filter(F.col("doc_id") == test_id).collect()] == ["small"]
    names = [letters(k, "") for k in range(1100)]
    rows = [(d, f"{x} {x}", x) for d, x in zip(train_ids, names)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == sorted(names)
    assert language_id.score_texts(names[::100], model)[0] == names[::100]


def test_quality_classifier(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.train(docs, labels)
    edge = spark.createDataFrame([(-1, None), (-2, ""), (None, "words")], docs.schema)
    out = quality_classifier.predict(docs.union(edge), model).join(labels, "doc_id", "left").withColumn("out", quality_classifier.held_out()).collect()
    assert all(0 <= r["quality_score"] <= 1 for r in out)
    test = [r for r in out if r["out"] and r["quality"] is not None]
    assert sum((r["quality_score"] >= 0.7) == (r["quality"] == 1) for r in test) / len(test) > 0.85
    empty = quality_classifier.train(docs.limit(0), labels.limit(0))
    assert quality_classifier.predict(nothing, empty).count() == 0


def test_quality_classifier_repeated_id(spark):
    """A labelled id with many rows takes no other label's place in training."""
    ids = [d for d in range(1000) if zlib.crc32(str(d).encode()) % 4 != 2][:40]
    rows = [(ids[0], f"plain words of the hot one {k % 7}") for k in range(2000)]
    rows += [(d, "good clean sentences of prose" if k % 2 else "buy cheap pills now") for k, d in enumerate(ids) if k]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(d, k % 2) for k, d in enumerate(ids)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels, max_docs=40)
    good, bad = quality_classifier.score_texts(["good clean sentences of prose", "buy cheap pills now"], *model)
    assert good > bad + 0.2
    again = quality_classifier.train(docs.repartition(5), labels, max_docs=40)
    assert (again[0] == model[0]).all() and again[1] == model[1]


def test_html_extract(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href="/x">Home</a></nav>
      <div class="ad">Buy this now</div><article><h1>Big  title</h1><p>First <b>para</b>graph &amp; more.<br>Next line<p>Short.
      <aside>Side words here</aside><form><p>Your mail</p></form><section class="comments"><p>Nice post</p></section></article><footer>&copy; x</footer></body></html>"""
    plain = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><p>" + "word " * 60 + "</p><p>" + "more " * 50 + "</p></body>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", page[:page.index("Short") + 3]), (5, "u", plain), (5, "u", plain), (6, "u", "<p>cut <a hre")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    text = {r["page_id"]: r["text"] for r in got.collect()}
    assert text[1] == "Big title First paragraph & more. Next line Short."
    assert text[2] == text[3] == "" and text[4] == "Big title First paragraph & more. Next line Sho"
    assert text[5] == " ".join(["word"] * 60 + ["more"] * 50)
    rows = html_extract.LABELLED
    assert all(html_extract.keeps(r[:-1]) == bool(r[-1]) for r in rows)
