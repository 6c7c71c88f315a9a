"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by hash into a fixed number of blocks (hash cells, so a
source with a third of all rows is spread like any other).  The target of a source, in words,
fixes its exact block quota: every block once per whole round, then a permuted prefix of blocks
for the remainder, the last of them cut at the word that reaches the target.  The quotas of all
sources form one urn.  A binary tree splits it among the output shards: at each node the left
half's share of every source is one multivariate-hypergeometric draw, so every shard receives
exact integer quotas that add up to the urn.  Each source's block instances, permuted by hash,
are then handed to the shards in disjoint runs of those lengths, and a shard's documents are
ordered by a local random key.

Everything is DataFrame and SQL functions.  Only narrow rows (id, source, size) are shuffled to
plan; the plan itself has at most ``blocks * max_repeat`` rows a source.

Defined results: null text has size 0; documents of size 0 are never placed; a null source is a
source of its own (last in order); repeated rows and null ids are separate documents; an empty
table gives an empty plan.  Only the named id, text and source columns are read, so extra
columns pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize, word_count

WEIGHTS = (5, 2, 1)  # fixed by the contract: repeated over the sources in code point order


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """One row per source: rank, source_size, target.

    Sources share all words by weight; a source stops at ``max_repeat`` times its own words and
    what it can't use is shared again by weight.  In order of ``cap / weight`` that is one pass:
    the first source whose cap holds the level left by those before it fixes the level of all."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights)))
        .withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    )
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_words") - F.col("before")) / F.col("left_weight"))
        .withColumn("holds", F.col("level") * F.col("weight") <= F.col("cap") * (1 + 1e-12))
    )
    level = F.coalesce(F.min(F.when(F.col("holds"), F.struct("before", "level"))).over(everything)["level"], F.lit(float("inf")))
    return levels.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select(
        "skey", "source", "rank", "source_size", "target"
    )


def _hypergeometric(u: str) -> str:
    """SQL for one draw: of ``z.need`` picks without return from ``z.rest`` items, how many are
    among ``k`` marked ones.  Inversion over 10 standard deviations around the mode, by the ratio
    of neighbouring probabilities; what lies outside is below double precision."""
    step = "w.w * (cast(p.k - j as double) * (p.need - j)) / (cast(j + 1 as double) * (p.rest - p.k - p.need + j + 1))"
    return f"""
    transform(transform(transform(array(named_struct(
        'k', k, 'need', z.need, 'rest', z.rest, 'u', {u},
        'lo', greatest(0L, z.need - z.rest + k), 'hi', least(z.need, k),
        'mid', cast(floor(cast(z.need + 1 as double) * (k + 1) / (z.rest + 2)) as bigint),
        'wide', 2L + cast(ceil(10 * sqrt(greatest(0D, cast(z.need as double) * k * (z.rest - k) * (z.rest - z.need)
                 / (greatest(1D, cast(z.rest as double)) * greatest(1D, cast(z.rest as double)) * greatest(1D, z.rest - 1D))))) as bigint))),
      p -> named_struct('k', p.k, 'need', p.need, 'rest', p.rest, 'u', p.u,
        'steps', sequence(greatest(p.lo, least(p.mid, p.hi) - p.wide), least(p.hi, greatest(p.mid, p.lo) + p.wide)))),
      p -> named_struct('k', p.k, 'need', p.need, 'rest', p.rest, 'steps', p.steps, 'goal', p.u * aggregate(p.steps,
        named_struct('w', 1D, 't', 0D), (w, j) -> named_struct('w', {step}, 't', w.t + w.w), w -> w.t))),
      p -> aggregate(p.steps, named_struct('w', 1D, 't', 0D, 'x', p.steps[0]),
        (w, j) -> named_struct('w', {step}, 't', w.t + w.w,
          'x', if(w.t + w.w < p.goal and j < element_at(p.steps, -1), j + 1, w.x)), w -> w.x))[0]"""


def splitting_tree(urn: DataFrame, shards: int, seed: int) -> DataFrame:
    """Exact quotas (rank, shard, quota) from one row ``q``: the block instances of each source."""
    nodes = urn.select(
        F.lit(0).alias("lo"), F.lit(shards).alias("width"), F.col("q"),
        F.aggregate("q", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"),
    )
    u = f"(shiftrightunsigned(xxhash64({seed}L, lo, width, size(z.out)), 11) + 0.5D) / 9007199254740992D"
    drawn = f"""aggregate(q,
        named_struct('need', total * cast(width / 2 as int) div width, 'rest', total, 'out', cast(array() as array<bigint>)),
        (z, k) -> transform(array({_hypergeometric(u)}), x -> named_struct(
            'need', z.need - x, 'rest', z.rest - k, 'out', concat(z.out, array(x))))[0],
        z -> z.out)"""
    depth = max(0, (shards - 1).bit_length())
    for _ in range(depth):
        split = nodes.withColumn("left", F.expr(f"if(width > 1, {drawn}, q)"))
        nodes = split.select(F.expr("""inline(if(width > 1, array(
            named_struct('lo', lo, 'width', cast(width / 2 as int), 'q', left,
                         'total', aggregate(left, 0L, (a, b) -> a + b)),
            named_struct('lo', lo + cast(width / 2 as int), 'width', width - cast(width / 2 as int),
                         'q', transform(q, (v, i) -> v - left[i]),
                         'total', total - aggregate(left, 0L, (a, b) -> a + b))),
            array(named_struct('lo', lo, 'width', width, 'q', q, 'total', total))))"""))
    return nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("rank", "quota"))


def plan_blocks(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3,
                shards: int = 16, seed: int = 42) -> DataFrame:
    """The mixing plan, one row per (source, block): target, whole rounds, words of the last round,
    and the shard of every instance."""
    cells = materialize(
        sized.groupBy("skey", "source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    sources = source_targets(
        cells.groupBy("skey", "source").agg(F.sum("words").alias("source_size")), weights, max_repeat)
    wanted = F.round("target").cast("bigint")
    sources = sources.withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("bigint")
    ).withColumn("rest", wanted - F.col("rounds") * F.col("source_size"))
    drawn = Window.partitionBy("skey").orderBy("draw", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        cells.drop("source").join(sources, "skey")
        .withColumn("draw", F.xxhash64(F.lit(seed + 2), "skey", "block"))
        .withColumn("prior", F.coalesce(F.sum("words").over(drawn), F.lit(0)))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("prior"))))
    )
    blocks = materialize(blocks.drop("draw", "prior", "rest", "words"), "mix-draw")
    turns = F.col("rounds") + F.when(F.col("extra") > 0, 1).otherwise(0)
    slot = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 3), "skey", "block", "round"), "block", "round")
    instances = (
        blocks.filter(turns > 0)
        .select("skey", "rank", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), turns - 1)).alias("round"))
        .withColumn("slot", F.row_number().over(slot) - 1)
    )
    urn = (
        blocks.groupBy("rank").agg(F.sum(turns).alias("n"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n"))), lambda x: x["n"]).alias("q"))
    )
    runs = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        splitting_tree(urn, shards, seed).withColumn("end", F.sum("quota").over(runs))
        .groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))
    )
    placed = (
        instances.join(ends, "rank")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("slot"))))
        .groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.struct("round", "shard"))).alias("turns"))
    )
    return materialize(blocks.join(placed, ["skey", "block"], "left").drop("source", "rank"), "mix-plan")


def _sized(docs: DataFrame, id_col: str, source_col: str, size: Column, blocks: int, seed: int, extra: list[Column]) -> DataFrame:
    return (
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), *extra)
        .withColumn("skey", _source_key(F.col("source")))
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.lit(blocks)).cast("int"))
    )


def _placed(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Every document with its ``parts``: (round, shard, words) for each copy the mix takes."""
    inside = (
        Window.partitionBy("skey", "block").orderBy(F.xxhash64(F.lit(seed + 1), "id", "size"), "id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = (
        sized.join(plan, ["skey", "block"])
        .withColumn("prior", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("prior"))))
    )
    parts = F.transform(
        F.coalesce(F.col("turns"), F.array().cast("array<struct<round:bigint,shard:int>>")),
        lambda t: F.struct(t["round"].alias("round"), t["shard"].alias("shard"),
                           F.when(t["round"] < F.col("rounds"), F.col("size")).otherwise(F.col("last")).alias("words")))
    return joined.withColumn("parts", F.filter(parts, lambda p: p["words"] > 0))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3, shards: int = 16, blocks: int = 4096,
             seed: int = 42) -> DataFrame:
    """What the mix takes of each document: id, source, size, source_size, target, parts."""
    sized = materialize(_sized(docs, id_col, source_col, word_count(F.col(text_col)), blocks, seed, []), "mix-sizes")
    plan = plan_blocks(sized, weights, max_repeat, shards, seed)
    return _placed(sized, plan, seed).select("id", "source", "size", "source_size", "target", "parts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3, shards: int = 16, blocks: int = 4096,
        cells: int = 64, seed: int = 42) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row per copy taken, rows of a shard
    together and in a random order within each of its ``cells``.  The one document per source that
    reaches the target is cut after the word that does."""
    size = word_count(F.col(text_col))
    plan = plan_blocks(_sized(docs, id_col, source_col, size, blocks, seed, []), weights, max_repeat, shards, seed)
    whole = _sized(docs, id_col, source_col, size, blocks, seed, [F.struct(*docs.columns).alias("doc")])
    copies = _placed(whole, plan, seed).select("doc", "size", "id", F.explode("parts").alias("part"))
    key = F.xxhash64(F.lit(seed + 4), "id", "size", F.col("part")["round"])
    words = F.regexp_extract_all(F.col("doc")[text_col], F.lit(rf"([{SPACE}]*{WORD})"), F.lit(1))
    text = F.when(F.col("part")["words"] < F.col("size"),
                  F.array_join(F.slice(words, F.lit(1), F.col("part")["words"].cast("int")), "")
                  ).otherwise(F.col("doc")[text_col])
    placed = copies.select(
        "doc", text.alias("text"), F.col("part")["shard"].alias("shard"), key.alias("key"),
        F.pmod(key, F.lit(cells)).alias("cell"))
    local = placed.repartition("shard", "cell").sortWithinPartitions("shard", "cell", "key")
    return local.select(*[
        (F.col("text") if c == text_col
         else F.length("text").cast(docs.schema[c].dataType) if c == "n_chars"
         else F.col("doc")[c]).alias(c) for c in docs.columns])
