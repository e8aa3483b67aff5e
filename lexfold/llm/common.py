"""Helpers that the operators share: checkpoints, Arrow batches, tokens."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.sources.corpus import spread

#: White space as all operators here understand it: space and U+0009 to U+000D.
WS_CLASS = r"\x20\x09-\x0D"

#: Rows in one Arrow batch.  Texts average a few KB, and a worker holds two or three batches.
ARROW_ROWS = 1000
#: Bytes of texts that an operator works on at once, if they are not of one text.
SLICE_BYTES = 6 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; set one only in a local session that names none, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexfold-checkpoint-"))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that begin with the stems and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now into the shared checkpoint folder and cut its lineage.

    The result is the checkpoint's rows alone.  What checkpoint() returns also carries what the
    optimizer had inferred about the plan; from round to round of a loop that
    grows beyond all bounds.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    held = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def drop_old_rounds(spark: SparkSession) -> None:
    """Let the driver find what nobody holds any more, so that files of past rounds of a loop are deleted now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts within a worker's memory, unless the session chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10000:
        spark.conf.set(key, str(ARROW_ROWS))


def give_back() -> None:
    """Return a worker's free memory to the system; workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has few bytes of texts, or one row: what is made of a text is many times its size."""
    for b in batches:
        texts = [c for c in b.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        if not texts or b.num_rows < 2 or b.nbytes <= SLICE_BYTES:
            yield b
            continue
        size = np.cumsum(sum(np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64) for c in texts))
        begin = 0
        while begin < b.num_rows:
            end = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + SLICE_BYTES, side="right"))
            end = max(end, begin + 1)
            yield b.slice(begin, end - begin)
            begin = end


def over_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` whose tasks give their memory back when they end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(in_slices(batches))
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the column's decimal text modulo ``modulus``; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column in UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
