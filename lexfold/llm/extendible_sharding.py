"""Sharding by extendible hashing, with DataFrame operations only.

A row's hash has 60 bits.  A histogram of bytes over the first bits of the hash
is rolled up level by level.  A bucket that exceeds the byte limit splits on
its next bit; one that fits stays whole, so shards lie at different depths.  The
directory has an entry for each value of the first ``depth`` bits, several of
them naming the same shallow shard, and rows find their shard by an equi-join
with it.  Where a bucket still exceeds the limit at the directory's depth, its
rows alone go through a further round with more bits.

Rows that no bit parts (equal id and text) fill pages of a shard up to the
limit.  One row above the limit is a shard or page of its own.

Edge cases: a null or empty text has no bytes; a null id is hashed as the empty
string; repeated rows have the same hash; an empty table gives no rows; other
columns are passed by ``assign`` if named in ``keys`` and ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexfold.llm.common import cut, unused

HASH_BITS = 60
#: Bits of the first directory beyond those that evenly filled shards would need.
SPARE_BITS = 4
#: Bits that each further round adds, and levels rolled up together.
STEP_BITS = 8


def _hashed(df: DataFrame, id: str, text: str, keys: list[str]) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit("\x01"), body).cast("binary"))
    return df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("h"), F.octet_length(body).cast("bigint").alias("bytes"))


def _levels(rows: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """Every non-empty bucket of the levels above..depth: d, prefix, bytes, docs, whether it stays whole, and whether it holds one hash."""
    sums = [F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high")]
    base = rows.select(F.shiftright("h", HASH_BITS - depth).alias("prefix"), "bytes", F.lit(1).cast("bigint").alias("docs"), F.col("h").alias("low"), F.col("h").alias("high")).groupBy("prefix").agg(*sums)
    out, bottom = None, depth
    while True:
        top = max(above, bottom - STEP_BITS + 1)
        here = base.withColumn("d", F.explode(F.sequence(F.lit(top), F.lit(bottom))))
        here = here.groupBy("d", F.call_function("shiftright", F.col("prefix"), F.lit(bottom) - F.col("d")).alias("prefix")).agg(*sums)
        out = here if out is None else out.union(here)
        if top == above:
            break
        base = base.groupBy(F.shiftright("prefix", bottom - top + 1).alias("prefix")).agg(*sums)
        bottom = top - 1
    return out.select("d", "prefix", "bytes", "docs", (F.col("low") == F.col("high")).alias("one"), ((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).alias("fits"))


def assign(df: DataFrame, limit: int, id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keys, doc_bytes, shard, depth, page, shard_bytes, shard_docs) of every row.

    ``shard`` is the hash prefix in binary digits (empty: the only shard);
    bytes and rows are those of the shard's page.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = cut(_hashed(df, id, text, list(keys)))
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    above, depth = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    placed = None
    while True:
        levels = cut(_levels(rows, above, depth, limit))
        parent = levels.where("not fits").select((F.col("d") + 1).alias("d"), F.col("prefix").alias("up"))
        whole = levels.where("fits").withColumn("up", F.shiftright("prefix", 1))
        # all buckets above this round's levels are split, or the round would not have their rows
        leaves = whole.where(F.col("d") == above).unionByName(whole.join(parent, ["d", "up"], "left_semi").select(whole.columns))
        span = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(depth) - F.col("d"))
        directory = leaves.select("d", "prefix", "one", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), F.explode(F.sequence(F.col("prefix") * span, (F.col("prefix") + 1) * span - 1)).alias("entry"))
        keyed = rows.withColumn("entry", F.shiftright("h", HASH_BITS - depth))
        found = keyed.join(directory, "entry").drop("entry")
        placed = found if placed is None else placed.unionByName(found)
        over = levels.where((F.col("d") == depth) & ~F.col("fits")).select(F.col("prefix").alias("entry"))
        if depth == HASH_BITS or over.isEmpty():
            break
        rows = keyed.join(over, "entry", "left_semi").drop("entry")
        above, depth = depth + 1, min(HASH_BITS, depth + STEP_BITS)
    paged = F.col("one") & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    crowded = placed.where(paged)
    if crowded.isEmpty():
        placed = placed.withColumn("page", F.lit(0).cast("bigint"))
    else:
        placed = placed.where(~paged).withColumn("page", F.lit(0).cast("bigint")).unionByName(_pages(crowded, limit))
    room = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1).cast("bigint"))))
    on_page = F.when(paged, F.least(room, F.col("shard_docs") - F.col("page") * room)).otherwise(F.col("shard_docs"))
    return placed.select(
        *(F.col(n).alias(k) for n, k in zip(names, keys)), F.col("bytes").alias("doc_bytes"),
        F.when(F.col("d") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("d"), F.lit("0"))).alias("shard"),
        F.col("d").cast("bigint").alias("depth"), "page", F.when(paged, on_page * F.col("bytes")).otherwise(F.col("shard_bytes")).alias("shard_bytes"), on_page.alias("shard_docs"))


def _pages(crowded: DataFrame, limit: int) -> DataFrame:
    """Page numbers of rows that share one hash, counted partition by partition, so that no task gets all of them."""
    rows = cut(crowded.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    before = rows.groupBy("h", "part").agg(F.count("*").alias("here"))
    before = before.withColumn("before", F.sum("here").over(Window.partitionBy("h").orderBy("part")) - F.col("here")).drop("here")
    nth = F.row_number().over(Window.partitionBy("h", "part").orderBy("at"))
    room = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(limit) / F.col("bytes")))
    return rows.withColumn("nth", nth).join(before, ["h", "part"]).withColumn("page", F.floor((F.col("before") + F.col("nth") - 1) / room)).drop("at", "part", "nth", "before")


def write_shards(df: DataFrame, path: str, limit: int, id: str = "doc_id", text: str = "text") -> None:
    """Write all rows of ``df`` as Parquet, a folder for each shard and page.

    Rows travel once, with their shard, to the task that writes it; a task holds
    no more than its open files.  The folders are named by ``shard`` and ``page``, with
    an underscore after a name that the rows have themselves.
    """
    packed = df.select(F.col(id).alias("id"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    placed = assign(packed, limit, "id", "text", keys=("row",))
    shard, page = unused(df, "shard", "page")
    dealt = placed.repartition("shard", "page").sortWithinPartitions("shard", "page")
    dealt.select("row.*", F.concat(F.lit("s"), "shard").alias(shard), F.col("page").alias(page)).write.partitionBy(shard, page).parquet(path)
