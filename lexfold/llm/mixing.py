"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents fall into blocks by hash.  A source whose target is r
times its size gives whole epochs of all blocks, floor(r) of them, and a
permuted part of one more that comes as near the rest as whole blocks can.  The
blocks so given are the source's quota, and they stand in one permuted sequence.

The quotas are split among the output shards by a binary tree: at each node the
left half of the shards draws its share of blocks from the node's quotas by a
multivariate hypergeometric draw, and the right half gets what remains.  Each
node has its own seeded generator, so a task finds the exact numbers of a range of
shards, and where their disjoint ranges begin in each source's sequence, by
walking from the root alone.  A shard is then shuffled by itself.

Sources may be any number: their sizes, targets and quotas are tables.  A node
first splits the quotas of groups of sources, whose totals alone all tasks know, and a
task splits those of one group by what the group got; such a draw in two
steps is the same draw.  Only sources with many documents are broadcast
to the rows, the others are joined.

Edge cases: a null text has size 0; a null source is one of its own and sorts
last; a source without words has target 0 and gives no documents; rows of equal id
and text fall into one block; an empty table gives no rows; columns of the
input are kept by ``mixed_rows`` and ignored by ``mixed_digest``; the names
``mix_shard`` and ``mix_order`` replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfold.llm.common import WS_CLASS, cut, over_batches

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Times its size that a source, and so a document, is taken at most.
MOST_TIMES = 3
#: Words to a block, and blocks that a source has at least (four to a document, if those are fewer).
BLOCK_WORDS = 1 << 16
LEAST_BLOCKS = 1024
#: Of many sources each has fewer at least, so that these do not sum to more than this.
LEAST_BLOCKS_OF_ALL = 1 << 29
#: Blocks permuted together.
CHUNK_BLOCKS = 4096
#: Words to an output shard.
SHARD_WORDS = 1 << 20
#: Sources to a group of the splitting tree; and one in so many documents makes a source large, so that no more than this are broadcast.
GROUP_SOURCES = 50_000
#: Shards that a task deals at most, and blocks that it deals about.
TASK_SHARDS, TASK_BLOCKS = 1024, 1 << 20
SEED = 7


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS_CLASS}]+")), F.lit(0)).cast("bigint")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES) -> DataFrame:
    """``sources`` (number, size) with ``target``: shares of the whole by weight; what exceeds ``times`` a source's size is shared anew among the others by weight.

    A source is over if the level, words to a unit of weight, gives it more than ``times`` its size; every round the level of the others rises until no more are over.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    over, known = F.lit(False), 0
    whole = sources.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    left, total = whole.size or 0, whole.weight or 1
    while True:
        share = F.col("weight") * (left / total)
        over = share > times * F.col("size")
        r = sources.where(over).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
        if r.n <= known or r.weight == whole.weight:
            return sources.withColumn("target", F.when(over, (times * F.col("size")).cast("double")).otherwise(share)).drop("weight")
        known, left, total = r.n, whole.size - times * r.size, whole.weight - r.weight


@dataclass
class Mix:
    """``documents``: slim rows (number, block, ...) of the input; ``draws``: (number, block, epoch, shard), one row for each block taken."""

    documents: DataFrame
    draws: DataFrame
    shards: int


def _mixed(*parts: Column | int) -> Column:
    return F.xxhash64(*(F.lit(p) if isinstance(p, int) else p for p in parts))


def nearest(words: np.ndarray, goal: float) -> np.ndarray:
    """Which blocks to take: in the given order those that still fit, then single additions, removals and swaps while they come nearer the goal."""
    taken = np.zeros(len(words), bool)
    gap = goal
    for k, w in enumerate(words.tolist()):
        if w <= gap:
            taken[k] = True
            gap -= w
    for _ in range(20):
        mine, others = np.nonzero(taken)[0], np.nonzero(~taken)[0]
        mine = mine[np.argsort(words[mine], kind="stable")]
        best = (abs(gap), -1, -1)
        # what comes in, and the block that goes out for it whose size is nearest to what is too much (-1: none)
        for j, w in [(-1, 0), *zip(others.tolist(), words[others].tolist())]:
            best = min(best, (abs(gap - w), j, -1))
            at = int(np.searchsorted(words[mine], w - gap))
            for k in (at - 1, at):
                if 0 <= k < len(mine):
                    best = min(best, (abs(gap - w + int(words[mine[k]])), j, int(mine[k])))
        if best[0] >= abs(gap):
            break
        _, j, i = best
        if j >= 0:
            taken[j] = True
            gap -= words[j]
        if i >= 0:
            taken[i] = False
            gap += words[i]
    return taken


def _nearest(t: pa.Table) -> pa.Table:
    """The blocks of one chunk, in permuted order, that come nearest to what the source lacks there."""
    t = t.sort_by([("at", "ascending"), ("block", "ascending")])
    taken = nearest(t.column("words").to_numpy(), t.column("lacks")[0].as_py())
    return t.select(["number", "block"]).filter(pa.array(taken))


def walk(totals: np.ndarray, group: int, quotas: np.ndarray, shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each shard from ``first`` to ``last`` - 1 with where its range begins in the sequence of each source of the group, and how many blocks it has there.

    ``totals`` are the quotas of all groups, ``quotas`` those of the sources of the one.
    """
    draw = lambda colors, share, *at: np.random.default_rng([seed, *at]).multivariate_hypergeometric(colors, share, method="marginals")
    nodes = [(0, shards, totals.astype(np.int64), np.zeros(len(quotas), np.int64), quotas.astype(np.int64))]
    while nodes:
        low, high, groups, begin, counts = nodes.pop()
        if high <= first or last <= low:
            continue
        if high - low == 1:
            yield low, begin, counts
            continue
        middle = (low + high) // 2
        to_left = draw(groups, int(groups.sum()) * (middle - low) // (high - low), low, high)
        left = draw(counts, int(to_left[group]), low, high, group + 1)
        nodes.append((middle, high, groups - to_left, begin + left, counts - left))
        nodes.append((low, middle, to_left, begin, left))


def _numbered(sources: DataFrame) -> DataFrame:
    """``number`` in the order of names by code point, null last; a row for each partition reaches the driver."""
    held = cut(sources.orderBy(F.asc_nulls_last("name"))).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    before, starts = 0, {}
    for r in sorted(held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts[r.part] = before
        before += r.n
    if not starts:
        return held.withColumnRenamed("at", "number")
    start = F.create_map(*(F.lit(x).cast("bigint") for pair in starts.items() for x in pair))[part]
    return held.withColumn("number", start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def _join_sources(slim: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """The rows with what is known of their sources: the large ones, ``most`` at most, are broadcast, and rows of the others, none of which is hot, are joined."""
    docs = sources.agg(F.sum("docs")).first()[0] or 0
    known = sources.withColumnRenamed("name", "known")
    same = F.col("name").eqNullSafe(F.col("known"))
    large = F.col("docs") * most > docs
    if not sources.where(~large).limit(1).count():
        return slim.join(F.broadcast(known), same).drop("known", "docs")
    found = slim.join(F.broadcast(known.where(large)), same, "left")
    rest = found.where(F.col("number").isNull()).select(slim.columns).join(known.where(~large), same)
    return found.where(F.col("number").isNotNull()).unionByName(rest).drop("known", "docs")


def plan(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", keys: dict[str, Column] | None = None, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS,
         least_blocks: int = LEAST_BLOCKS, shard_words: int = SHARD_WORDS, chunk_blocks: int = CHUNK_BLOCKS, group_sources: int = GROUP_SOURCES, task_shards: int = TASK_SHARDS, seed: int = SEED) -> Mix:
    """Decide what the mix takes; ``keys`` are columns that ``documents`` carries besides."""
    slim = cut(df.select(F.col(source).alias("name"), size_of(F.col(text)).alias("size"), _mixed(seed, F.col(id), F.col(text)).alias("h"), *(c.alias(k) for k, c in (keys or {}).items())))
    sources = with_targets(_numbered(slim.groupBy("name").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))), weights)
    least_blocks = max(1, min(least_blocks, LEAST_BLOCKS_OF_ALL // max(1, sources.count())))
    wanted = F.greatest(F.lit(1), F.least(F.lit(least_blocks), 4 * F.col("docs")), F.ceil(F.col("size") / block_words)).cast("bigint")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("size", F.lit(0))), F.lit(0)).cast("int")
    sources = cut(sources.withColumn("blocks", wanted).withColumn("epochs", epochs).withColumnRenamed("size", "source_size"))
    slim = _join_sources(slim, sources.drop("epochs"), group_sources)
    documents = slim.withColumn("block", F.pmod("h", "blocks")).drop("h", "blocks", "name")
    blocks = cut(documents.groupBy("number", "block").agg(F.sum("size").alias("words")))
    blocks = blocks.withColumn("chunk", F.floor(F.col("block") / chunk_blocks)).withColumn("at", _mixed(seed, F.col("number"), F.col("block")))

    # in order, chunks fill what remains of the target beyond whole epochs; the first that does not fit gives some of its blocks
    chunks = blocks.groupBy("number", "chunk").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    chunks = chunks.join(sources.select("number", "epochs", "target", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("goal")), "number")
    earlier = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    chunks = chunks.withColumn("before", sum_before("n")).withColumn("lacks", F.col("goal") - sum_before("words")).withColumn("in_epoch", F.sum("n").over(Window.partitionBy("number")))
    chunks = chunks.withColumn("full", (F.col("target") > 0) & (F.col("words") <= F.col("lacks")))
    # the first chunk that does not fit: all before it do
    fitted = F.coalesce(F.min("full").over(earlier), F.lit(True))
    chunks = cut(chunks.withColumn("some", (F.col("target") > 0) & ~F.col("full") & fitted).drop("goal", "target", "words"))
    blocks = blocks.join(chunks.drop("n"), ["number", "chunk"])
    some = cut(blocks.where("some").select("number", "chunk", "block", "words", "at", "lacks").groupBy("number", "chunk").applyInArrow(_nearest, "number bigint, block bigint"))

    # quotas: blocks that a source gives
    quotas = chunks.groupBy("number").agg((F.first("epochs") * F.first("in_epoch") + F.sum(F.when(F.col("full"), F.col("n")).otherwise(0))).alias("quota"))
    quotas = quotas.unionByName(some.groupBy("number").agg(F.count("*").alias("quota"))).groupBy("number").agg(F.sum("quota").alias("quota")).withColumn("group", F.floor(F.col("number") / group_sources))
    quotas = cut(quotas)
    last_source = quotas.agg(F.max("group")).first()[0]
    totals = np.zeros((0 if last_source is None else last_source) + 1, np.int64)
    for r in quotas.groupBy("group").agg(F.sum("quota").alias("n")).collect():  # a row for GROUP_SOURCES sources
        totals[r.group] = r.n

    chosen = some.withColumn("chosen", F.lit(True))
    given = blocks.join(chosen, ["number", "block"], "left")
    last = F.when(F.col("full") | F.coalesce("chosen", F.lit(False)), 1).otherwise(0)
    given = given.withColumn("epoch", F.explode(F.filter(F.sequence(F.lit(0), F.col("epochs") + last), lambda e: e > 0)))
    permuted = Window.partitionBy("number", "epoch", "chunk").orderBy(_mixed(seed, F.col("epoch"), F.col("number"), F.col("block")), "block")
    given = given.select("number", "block", "epoch", ((F.col("epoch") - 1) * F.col("in_epoch") + F.col("before") + F.row_number().over(permuted) - 1).alias("i"))

    words = sources.agg(F.sum("target")).first()[0] or 0
    shards = max(1, -(-int(words) // shard_words))
    at_once = max(1, min(task_shards, TASK_BLOCKS * shards // max(1, int(totals.sum()))))

    def deal(t: pa.Table) -> pa.Table:
        t = t.sort_by("number")
        names, first = t.column("number").to_numpy(), t.column("part")[0].as_py() * at_once
        out = [np.zeros((3, 0), np.int64)]
        for shard, begin, counts in walk(totals, t.column("group")[0].as_py(), t.column("quota").to_numpy(), shards, first, first + at_once, seed):
            i = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - begin, counts)
            out.append(np.stack([np.repeat(names, counts), i, np.full(len(i), shard)]))
        number, i, shard = np.concatenate(out, axis=1)
        return pa.table({"number": number, "i": i, "shard": shard})

    parts = F.explode(F.sequence(F.lit(0), F.lit(-(-shards // at_once) - 1)))
    dealt = quotas.withColumn("part", parts).groupBy("group", "part").applyInArrow(deal, "number bigint, i bigint, shard bigint")
    return Mix(documents, given.join(dealt, ["number", "i"]).select("number", "block", "epoch", "shard"), shards)


def mixed_digest(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, taken) of every row; taken counts the words of all its copies in the mix."""
    mix = plan(df, id, text, source, {"__id": F.col(id)}, **options)
    copies = mix.draws.groupBy("number", "block").agg(F.count("*").alias("copies"))
    return mix.documents.join(copies, ["number", "block"], "left").select(F.col("__id").alias(id), "size", "source_size", "target", (F.col("size") * F.coalesce("copies", F.lit(0))).alias("taken"))


def mixed_rows(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of ``df`` with ``mix_shard`` and ``mix_order``, a row for each copy taken, every shard shuffled."""
    whole = df.drop("mix_shard", "mix_order")
    seed = options.get("seed", SEED)
    hashed = F.xxhash64(F.lit(seed), F.col(id), F.col(text)).alias("hash")
    mix = plan(whole, id, text, source, {"of": F.col(source), "hash": hashed}, **options)
    # what each document's hash, source and block give: a row for each copy, shared by equal rows
    taken = mix.documents.select("number", "block", "of", "hash").distinct().join(mix.draws, ["number", "block"]).select(F.col("of").alias("of_"), F.col("hash").alias("hash_"), "epoch", "shard")
    # the row travels as one column, so that no name of it can clash
    rows = whole.select(F.struct(*(F.col(f"`{c}`") for c in whole.columns)).alias("row"), hashed, F.col(source).alias("of"))
    rows = rows.join(taken, (F.col("hash") == F.col("hash_")) & F.col("of").eqNullSafe(F.col("of_"))).withColumn("mix_order", F.xxhash64(F.lit(seed), "shard", "hash", "epoch"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "mix_order")
    return rows.select("row.*", F.col("shard").alias("mix_shard"), "mix_order")
