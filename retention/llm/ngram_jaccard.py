"""N-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct n-word shingles.  Rows with equal sets form
a class, and only one of its rows goes on, under a number of the class; rows are told apart by their id
and a 64-bit hash of their text, so rows that share an id but not their text are different documents.

1. Filter, in hash order.  If two sets are linked, their prefixes (the shingles one of them may
   lack, plus ``slack``) share at least ``slack`` shingles.  Prefix shingles are counted once; a
   set with fewer shared prefix shingles than that has no partner and stops here.  The texts of the
   others are shuffled anew, those that stopped being left out by a table of bits before that.
2. The sets left are ordered anew by exact document frequency, rarest first (then by hash): the
   global order.  Only shingles of the common prefix filter become postings, so passages and
   phrases that many documents share are not traversed unless a document has little else.
3. Candidates of a posting list are first paired with two centres only, verified, and the links
   joined into components.  Then every remaining pair of a list that lies in different components is
   verified too, so no link between components is lost.
4. Verification is vertical: the global order is cut into ``fragments`` ranges at the document
   frequencies 4, 8, 16, ... (a shingle found once can't overlap and is in none); each (pair, fragment)
   counts its partial overlap separately, and partial counts are summed per pair before the threshold.
5. Inside a component of three or more, all pairs are verified, so no link between different texts
   is lost.  The component is dealt by hash into blocks of bounded size; a pair of blocks counts the
   partial overlaps of all its pairs at once, fragment by fragment, and gives each set's links as a list.

The result is the links between classes (the pairs of different sets) and the class, the number of
links of that class, and the component of every row.

Defined results: a text with fewer words than n has its whole sequence as its one shingle; empty
and null texts have an empty set and link with nothing; repeated rows are copies, and so are rows of
equal sets under any ids; rows that share an id but not their text each have their own class and links;
a null id takes part under a hash of its text above all ids, and its component is null where no id is
in it; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize
from .subword import Words, char_table, chunks, mix64

NO_ID = 2**62  # keys from here on stand for rows without an id
MARKS = 2**25
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def word_chars() -> np.ndarray:
    return char_table(lambda c: c not in " \t\n\x0b\x0c\r")


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased first."""
    words = Words([t.encode().lower().decode() for t in texts], word_chars())
    cuts = np.searchsorted(words.doc, np.arange(len(texts) + 1))
    out = []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        key = words.key[a:z]
        size = min(n, len(key))
        if size == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        h = key[:len(key) - size + 1].copy()
        for k in range(1, size):
            h = h * _BASE + key[k:len(key) - size + 1 + k]
        out.append(np.unique(mix64(h + np.uint64(size))))
    return out


def missing(size: int, percent: int) -> int:
    """How many shingles of a set of this size a linked set may lack."""
    return size - -(-percent * size // 100)


def slack(size: int) -> int:
    return max(1, size // 12)


def _prefixes(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, k1, k2, prefix = [], [], [], []
            for texts in chunks(batch.column("text").to_pylist()):
                for s in shingle_sets(texts, n):
                    sizes.append(len(s))
                    k1.append(s.sum(dtype=np.uint64))
                    k2.append(mix64(s ^ _BASE).sum(dtype=np.uint64))
                    prefix.append(s[:missing(len(s), percent) + slack(len(s))])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *prefix]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("part"), pa.array(sizes, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)),
                 pa.array(np.array(k2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc", "part", "n", "k1", "k2", "prefix"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for texts in chunks(batch.column("text").to_pylist()) for s in shingle_sets(texts, n)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc", "grams"])

    return run


def document_key(id_col: str, text_col: str) -> list[Column]:
    """(doc, part): the id, or a hash of the text above all ids where it is null, and a hash of the text."""
    text = F.xxhash64(F.lit(13), F.col(text_col))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.pmod(text, F.lit(NO_ID))).alias("doc"), text.alias("part")]


def marked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` without most of those whose (doc, part) is not in ``chosen``, before a join shuffles them: a
    key's bit is set in a table of ``MARKS`` bits at most, so that what is broadcast has a bound.  A key can meet
    another's bit; the join after it decides."""
    mark = F.pmod(F.xxhash64("doc", "part"), F.lit(MARKS))
    word, bit = F.shiftright(mark, 6).alias("word"), F.pmod(mark, F.lit(64)).cast("int").alias("bit")
    words = chosen.select(word, bit).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return rows.select("*", word, bit).join(F.broadcast(words), "word").filter(F.getbit("bits", F.col("bit")) == 1).select(*rows.columns)


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the least id that links reach.  Labels move to
    the least of the neighbours' and then jump to their own label's label, until none changes."""
    both = materialize(links.select(F.col("a").alias("id"), F.col("b").alias("near")).union(
        links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialize(both.groupBy("id").agg(F.least(F.min("near"), F.col("id")).alias("component")), "labels")
    while True:
        near = labels.select(F.col("id").alias("near"), F.col("component").alias("theirs"))
        least = both.join(near, "near").groupBy("id").agg(F.min("theirs").alias("least"))
        moved = labels.join(least, "id").select("id", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        of = moved.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = materialize(
            moved.join(of, "component").select("id", F.col("root").alias("component"), "old"), "labels")
        if jumped.filter("component <> old").isEmpty():
            return jumped.drop("old")
        labels = jumped.drop("old")


def verify(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b, na, nb): overlaps counted per fragment, then summed."""
    left = segments.select(F.col("doc").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("doc").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return total.filter(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _overlaps(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], rows: int, columns: int) -> np.ndarray:
    """How many shingles each set of ``x`` shares with each of ``y``; both are (place of the set, shingle,
    fragment)."""
    both = np.zeros((rows, columns), np.int64)
    for f in np.unique(x[2]):
        (dx, gx), (dy, gy) = (x[0][x[2] == f], x[1][x[2] == f]), (y[0][y[2] == f], y[1][y[2] == f])
        common = np.intersect1d(gx, gy)
        for start in range(0, len(common), 8192):
            part = common[start:start + 8192]
            sides = []
            for d, g, size in ((dx, gx, rows), (dy, gy, columns)):
                at = np.minimum(np.searchsorted(part, g), len(part) - 1)
                hit = part[at] == g
                side = np.zeros((size, len(part)), np.float32)  # sums below 2**24 are exact
                side[d[hit], at[hit]] = 1
                sides.append(side)
            both += (sides[0] @ sides[1].T).astype(np.int64)
    return both


def _block_links(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """The links between two blocks, or within one, from both ends: (doc, near)."""
        block = group.column("block").to_numpy()
        docs = group.column("doc").to_numpy()
        grams = group.column("grams").combine_chunks()
        grams = grams.combine_chunks() if isinstance(grams, pa.ChunkedArray) else grams
        sizes, lengths = group.column("n").to_numpy(), np.diff(grams.offsets.to_numpy())
        flat = grams.flatten().to_numpy().view(np.uint64)
        owner = np.repeat(np.arange(len(docs)), lengths)
        cuts = np.array(group.column("cuts").to_pylist(), np.int64).reshape(len(docs), -1)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        fragment = sum((at >= c[owner] for c in cuts.T), np.zeros(len(flat), np.int64))
        low, high = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        place = np.zeros(len(docs), np.int64)
        place[low], place[high] = np.arange(len(low)), np.arange(len(high))
        own = [(place[owner[m]], flat[m], fragment[m]) for m in (np.isin(owner, low), np.isin(owner, high))]
        both = _overlaps(*own, len(low), len(high))
        linked = both * 100 >= percent * (sizes[low][:, None] + sizes[high][None, :] - both)
        linked &= docs[low][:, None] != docs[high][None, :]
        ends = [(low, high, linked)] if block.min() == block.max() else [(low, high, linked), (high, low, linked.T)]
        doc = [int(docs[a[k]]) for a, _, m in ends for k in range(len(a)) if m[k].any()]
        near = [docs[z[m[k]]] for a, z, m in ends for k in range(len(a)) if m[k].any()]
        return pa.table({"doc": pa.array(doc, pa.int64()), "near": pa.array(near, pa.list_(pa.int64()))})

    return run


def within(first: DataFrame, full: DataFrame, percent: int, fragments: int, block_docs: int = 256, block_grams: int = 2**18) -> DataFrame:
    """(doc, near): the links of every set inside its component, for components (``first``) of three sets or
    more.  Blocks hold about ``block_docs`` sets and ``block_grams`` shingles at most, or one larger set.
    ``full`` has doc and grams; n (the size of the whole set) and cuts (the places in grams where the
    fragments after the first begin) where it is written by ``ranges``, else one fragment holds all."""
    if "cuts" not in full.columns:
        full = full.select("doc", F.size("grams").cast("long").alias("n"), "grams", F.array().cast("array<int>").alias("cuts"))
    member = first.select(F.col("id").alias("doc"), "component")
    groups = (
        member.join(full.select("doc", F.size("grams").alias("held")), "doc").groupBy("component")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("held").alias("grams")).filter("docs > 2")
        .select("component", F.ceil(F.greatest(F.col("docs") / block_docs, F.col("grams") / block_grams)).alias("blocks"))
    )
    dealt = (
        member.join(groups, "component").withColumn("block", F.pmod(F.xxhash64("doc", F.lit(5)), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("doc", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    return dealt.join(full, "doc").groupBy("component", "low", "high").applyInArrow(
        _block_links(percent), "doc long, near array<long>")


def ranges(ordered: Column, fragments: int) -> Column:
    """Where in an ordered array of (df, gram) each fragment after the first begins: at df 4, 8, 16, ..."""
    return F.transform(F.sequence(F.lit(1), F.lit(fragments - 1)), lambda f: F.size(F.filter(ordered, lambda x: x["df"] < F.pow(F.lit(2.0), f + 1))))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
               fragments: int = 8) -> DataFrame:
    """The rows of ``similar``."""
    return similar(docs, id_col, text_col, n, percent, fragments)[0]


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
            fragments: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rows and pairs.  One row per document: ``doc`` and ``part`` (its key), n_shingles, ``component`` (the
    least id reached), ``class`` (the least id with the same set), n_links (other classes its class is
    linked with) and ``stays`` (it is the row of its component with the least key, or a copy of that one).
    One pair for every link between different sets: their classes ``a`` < ``b``, with the classes' own
    numbers ``node_a``, ``node_b``, which tell classes apart where ids repeat."""
    texts = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"))
    sets = materialize(texts.transform(bounded).mapInArrow(_prefixes(n, percent), "doc long, part long, n long, k1 long, k2 long, prefix array<long>"), "jaccard-sets")
    classes = materialize(
        sets.groupBy("n", "k1", "k2").agg(F.min(F.struct("doc", "part")).alias("first")).filter("n > 0")
        .select("n", "k1", "k2", F.col("first.doc").alias("first"), F.col("first.part").alias("part"))
        # numbers in order of id: the centre of a list is then its oldest document, of which the others are copies
        .orderBy("first", "part").withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    # 1. filter: how many shingles of each prefix are found in another prefix: all but those counted once, whose
    # only owner is known from the count, so that the prefixes are shuffled once and joined with nothing
    alone = (
        sets.select("doc", "n", F.explode("prefix").alias("gram"))
        .groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("doc").alias("doc"), F.min("n").alias("n")).filter("df = 1")
        .groupBy("doc", "n").agg(F.count(F.lit(1)).alias("alone"))
    )
    partner = F.ceil(F.col("n") * percent / 100)  # size of the smallest set it can be linked with
    # texts that share an id and a size are counted together here, which only lets more of them through
    likely = (
        sets.groupBy("doc", "n").agg(F.sum(F.size("prefix")).alias("held")).join(alone, ["doc", "n"], "left")
        .filter(F.col("held") - F.coalesce("alone", F.lit(0)) >= F.greatest(F.lit(1), F.floor(partner / 12))).select("doc", "n")
    )
    # written before the texts are joined: the shuffles of the prefixes are gone by then
    chosen = materialize(
        classes.select(F.col("first").alias("doc"), "part", "n", "node").join(likely, ["doc", "n"], "left_semi").select("doc", "part", "node"),
        "jaccard-chosen")
    # a class has one (doc, part): its copies are dropped where the join has put them
    full = materialize(
        marked(texts, chosen).join(chosen, ["doc", "part"]).dropDuplicates(["doc", "part", "node"]).select(F.col("node").alias("doc"), "text")
        .transform(bounded).mapInArrow(_sets(n), "doc long, grams array<long>"), "jaccard-full")
    # 2. the global order: document frequency, then hash
    tokens = full.select("doc", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("gram"))
    frequency = F.count(F.lit(1)).over(Window.partitionBy("gram"))  # one shuffle of the tokens
    lead = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("grams"))  # after the grams found once
    ordered = materialize(
        tokens.withColumn("df", frequency).filter("df > 1")
        # two plain lists are half the size of a list of structs in the shuffle
        .groupBy("doc", "n").agg(F.collect_list("df").alias("df"), F.collect_list("gram").alias("gram"))
        .select("doc", "n", F.sort_array(F.arrays_zip("df", "gram")).alias("ordered"))
        .select("doc", "n", F.col("ordered.gram").alias("grams"), ranges(F.col("ordered"), fragments).alias("cuts")), "jaccard-ordered")
    postings = materialize(
        ordered.filter(lead > 0)
        .select("doc", "n", (F.col("n") - F.size("grams")).alias("single"), F.posexplode(F.slice("grams", F.lit(1), lead.cast("int"))).alias("at", "gram"))
        .select("doc", "n", (F.col("single") + F.col("at")).alias("before"), "gram"), "jaccard-postings")
    bound = lambda k: F.when(k == 0, 0).when(k == fragments, F.size("grams")).otherwise(F.get("cuts", k - 1))
    segments = ordered.select("doc", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(fragments - 1)),
        lambda f: F.struct(f.alias("fragment"), F.slice("grams", bound(f) + 1, bound(f + 1) - bound(f)).alias("grams")))).alias("s")
    ).select("doc", F.col("s.fragment").alias("fragment"), F.col("s.grams").alias("grams")).filter(F.size("grams") > 0)
    # sizes allow a link, and so do the shingles from this one on: of a linked pair, this holds at the
    # first shingle they share, as all before it (counted by ``before``) are in one of them only
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (
        F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    # 3a. every document of a list against two centres of it
    centre = F.struct("doc", "n", "before")
    mixed = F.struct(F.xxhash64("doc").alias("h"), "doc", "n", "before")
    lists = postings.groupBy("gram").agg(F.min(centre).alias("low"), F.max(mixed).alias("other"), F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    pairs = (
        postings.join(lists, "gram").select("doc", F.col("n").alias("na"), F.col("before").alias("pa"), F.explode(F.array(
            F.col("low"), F.struct(F.col("other.doc").alias("doc"), F.col("other.n").alias("n"), F.col("other.before").alias("before")))).alias("c"))
        .select("doc", "na", "pa", F.col("c.doc").alias("other"), F.col("c.n").alias("nb"), F.col("c.before").alias("pb"))
        .filter((F.col("doc") != F.col("other")) & near)
        .select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b"),
                F.when(F.col("doc") < F.col("other"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                F.when(F.col("doc") < F.col("other"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
        .distinct()
    )
    links = materialize(verify(materialize(pairs, "jaccard-pairs"), segments, percent), "jaccard-links")
    first = connected(links)
    # 3b. every pair of a list whose documents are still in different components
    placed = postings.join(first.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_lists = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("gram")
    open_ = materialize(placed.join(open_lists, "gram"), "jaccard-open")
    x = open_.select("gram", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("before").alias("pa"), F.col("component").alias("ca"))
    y = open_.select("gram", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("before").alias("pb"), F.col("component").alias("cb"))
    rest = x.join(y, (x["gram"] == y["gram"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near).select("a", "b", "na", "nb").distinct()
    cross = materialize(verify(materialize(rest, "jaccard-rest"), segments, percent), "jaccard-more")
    final = connected(links.union(cross))
    # 5. the links inside the components of 3a; one of two sets has just the link that made it
    twos = first.join(first.groupBy("component").agg(F.count(F.lit(1)).alias("docs")).filter("docs = 2"), "component", "left_semi")
    single = links.join(twos.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b").union(cross)
    ends = single.select(F.col("a").alias("doc"), F.array("b").alias("near")).union(single.select("b", F.array("a")))
    linked = materialize(within(first, ordered, percent, fragments).union(ends), "jaccard-linked")
    number = lambda name: classes.select(F.col("node").alias(f"node_{name}"), F.col("first").alias(name))
    pairs = (
        linked.select(F.col("doc").alias("node_a"), F.explode("near").alias("node_b")).join(number("a"), "node_a").join(number("b"), "node_b")
        .filter((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("node_a") < F.col("node_b")))).select("a", "b", "node_a", "node_b"))
    counts = linked.groupBy("doc").agg(F.sum(F.size("near")).alias("n_links")).withColumnRenamed("doc", "node")
    placed = classes.join(final.select(F.col("id").alias("node"), F.col("component").alias("root")), "node", "left").join(counts, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    # a linked component is named by its least id, and the row that has it stays
    least = placed.groupBy("root").agg(F.min(F.struct("first", "part")).alias("least"))
    by_class = materialize(placed.join(least, "root").select("n", "k1", "k2", "first", "n_links", "least"), "jaccard-named")
    rows = sets.drop("prefix").join(by_class, ["n", "k1", "k2"], "left").select(
        "doc", sets["part"], F.col("n").alias("n_shingles"), F.coalesce("least.first", "doc").alias("component"),
        F.coalesce("first", "doc").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce((F.col("least.first") == F.col("doc")) & (F.col("least.part") == sets["part"]), F.lit(True)).alias("stays"))
    return rows, pairs


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id, then text hash."""
    found = components(docs, id_col, text_col, n, percent)
    keepers = materialize(found.filter("stays").select("doc", "part").distinct(), "jaccard-keepers")
    keyed = docs.select(F.struct("*").alias("row"), *document_key(id_col, text_col)).join(keepers, ["doc", "part"], "left_semi")
    once = Window.partitionBy("doc", "part").orderBy("part")  # copies of one row; a row number of 1 is found before the shuffle
    return keyed.withColumn("copy", F.row_number().over(once)).filter("copy = 1").select("row.*")
