"""Exact deduplication by Grace hashing.

Texts are equal when they are identical after each run of white space has
become one space.  Two rounds do the same thing at different places: first
every input partition reduces its own rows, so that a text that a third of all
rows share leaves each partition once; then the representatives meet by hash.
A round reads records into an open-addressing table that compares complete
content.  What does not fit the table's byte limit goes to spill files, dealt
by the next bits of the hash, and each file is treated the same way.

Edge cases: a null text counts as empty; an empty table gives no rows; a null
``id`` is larger than any other and, alone in its group, gives a null
``keep_id``; of rows that repeat the smallest id exactly one stays; other
columns of the input, whatever their names, are ignored by ``dedup_members``
and returned as they are by ``dedup_rows``.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexfold.llm.common import WS_CLASS, over_batches, small_batches, text_bytes, unused

#: Bytes of distinct content that one table holds before records go to spill files.
TABLE_BYTES = 64 << 20
#: Spill files on each level, and the bits of the hash that choose one.
FAN_OUT_BITS = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS_CLASS}]+", " ")


def normalise(text: bytes) -> bytes:
    """``normalised`` for UTF-8: its white space is that of bytes.split()."""
    words = text.split()
    if not words:
        return b" " if text else b""
    body = b" ".join(words)
    return (b" " if text[:1].isspace() else b"") + body + (b" " if text[-1:].isspace() else b"")


class OpenTable:
    """Open addressing with linear probing; an entry matches only if its whole content does."""

    def __init__(self) -> None:
        self.slots, self.mask = [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.states: list[list] = []
        self.digests: list[bytes] = []
        self.bytes = 0

    def find(self, digest: bytes, content: bytes) -> int:
        """The entry of this content, or ~slot where it would go."""
        key = int.from_bytes(digest[:8], "big")
        i = key & self.mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == key:
                if self.contents[e] == content:
                    return e
                if self.digests[e] == digest:
                    raise RuntimeError("two different texts share a SHA-256 digest")
            i = (i + 1) & self.mask
        return ~i

    def insert(self, slot: int, digest: bytes, content: bytes, state: list) -> None:
        self.slots[slot] = len(self.hashes)
        self.hashes.append(int.from_bytes(digest[:8], "big"))
        self.digests.append(digest)
        self.contents.append(content)
        self.states.append(state)
        self.bytes += len(content)
        if 2 * len(self.hashes) > self.mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for e, key in enumerate(self.hashes):
            i = key & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e


def merge_state(a: list, b: list) -> None:
    """[smallest id, rows that have it, all rows, payload of the first of these]."""
    if b[0] == a[0]:
        a[1] += b[1]
    elif a[0] is None or b[0] is not None and b[0] < a[0]:
        a[0], a[1], a[3] = b[0], b[1], b[3]
    a[2] += b[2]


Record = tuple[bytes, bytes, list]


def _spilled(path: Path) -> Iterator[Record]:
    with path.open("rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def grace(records: Iterable[Record], limit: int = TABLE_BYTES, depth: int = 0) -> Iterator[Record]:
    """One record for each distinct content, with merged states.

    The table takes new content up to ``limit`` bytes; rows that repeat
    an entry are merged at once, so a hot text is never spilled twice.
    Content of equal length is always either taken or spilled, as the table
    only grows, and so equal texts never part.  Each level stores at least one
    text, so that the recursion ends even where all hashes agree.
    """
    held = OpenTable()
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files: dict[int, object] = {}
        for digest, content, state in records:
            e = held.find(digest, content)
            if e >= 0:
                merge_state(held.states[e], state)
            elif not held.hashes or held.bytes + len(content) <= limit:
                held.insert(~e, digest, content, state)
            else:
                bits = int.from_bytes(digest[8:], "big") >> (FAN_OUT_BITS * (depth % 40)) & ((1 << FAN_OUT_BITS) - 1)
                if bits not in files:
                    files[bits] = open(f"{folder}/{bits}", "wb")
                pickle.dump((digest, content, state), files[bits], protocol=5)
        for f in files.values():
            f.close()
        yield from zip(held.digests, held.contents, held.states)
        del held
        for bits in sorted(files):
            path = Path(folder, str(bits))
            yield from grace(_spilled(path), limit, depth + 1)
            path.unlink()


def _out(records: Iterable[Record], build, rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    batch, held = [], 0
    for r in records:
        batch.append(r)
        held += len(r[1])
        if len(batch) >= rows or held >= size:
            yield build(batch)
            batch, held = [], 0
    if batch:
        yield build(batch)


def _local(limit: int, id_type: pa.DataType):
    schema = pa.schema([("h", pa.int64()), ("sha", pa.binary()), ("content", pa.binary()), ("min_id", id_type), ("ties", pa.int64()), ("n", pa.int64())])

    def build(batch: list[Record]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t.type) for x, t in zip((
                [int.from_bytes(d[:8], "big", signed=True) for d, _, _ in batch], [d for d, _, _ in batch], [c for _, c, _ in batch],
                *([s[k] for _, _, s in batch] for k in range(3))), schema)],
            schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                    content = normalise(text)
                    yield hashlib.sha256(content).digest(), content, [i, 1, 1, None]

        yield from _out(grace(records(), limit), build)

    return run


def _global(limit: int, id_type: pa.DataType):
    schema = pa.schema([("sha", pa.string()), ("keep_id", id_type), ("ties", pa.int64()), ("group_size", pa.int64())])

    def build(batch: list[Record]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(([d.hex() for d, _, _ in batch], *([s[k] for _, _, s in batch] for k in range(3))), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for b in batches:
                for _, sha, content, min_id, ties, n in zip(*(c.to_pylist() for c in b.columns)):
                    yield sha, content, [min_id, ties, n, None]

        yield from _out(grace(records(), limit), build, rows=5000)

    return run


def dedup_groups(df: DataFrame, id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """A row for each distinct text: sha (hex), keep_id, ties (rows with that id), group_size.  Ids are of any type with an order."""
    small_batches(df.sparkSession)
    picked = df.select(F.col(id), F.col(text))
    kind = picked.schema[0].dataType
    of, arrow = kind.simpleString(), to_arrow_type(kind)
    reps = over_batches(picked, _local(table_bytes, arrow), f"h bigint, sha binary, content binary, min_id {of}, ties bigint, n bigint")
    return over_batches(reps.repartition("h"), _global(table_bytes, arrow), f"sha string, keep_id {of}, ties bigint, group_size bigint")


def dedup_members(df: DataFrame, id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row's id with keep_id, group_size, kept and text_sha256.

    Rows carry only id and digest to their group, and that join may be split
    where a group is hot.
    """
    groups = dedup_groups(df, id, text, table_bytes)
    rows = df.select(F.col(id).alias("id"), F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("sha"))
    nth = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.lit(0)))
    return rows.withColumn("nth", nth).join(groups, "sha").select(
        F.col("id").alias(id), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup_rows(df: DataFrame, id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, whole, with the columns of ``df``.

    The row of the smallest id travels beside its content through both rounds,
    so nothing has to be joined back.
    """
    small_batches(df.sparkSession)
    at_id, at_text, width = df.columns.index(id), df.columns.index(text), len(df.columns)
    key = unused(df, "__h")[0]

    def round_of(keyed: bool):
        """The first round adds the hash as a last column, the second drops it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema: list[pa.Schema] = []

            def records() -> Iterator[Record]:
                for b in batches:
                    schema[:] = [pa.schema(list(b.schema)[:width])]
                    texts = text_bytes(b.column(at_text))
                    for row, text in zip(zip(*(c.to_pylist() for c in b.columns[:width])), texts):
                        content = normalise(text)
                        yield hashlib.sha256(content).digest(), content, [row[at_id], 1, 1, row]

            def build(batch: list[Record]) -> pa.RecordBatch:
                columns = [pa.array(x, f.type) for x, f in zip(zip(*(s[3] for _, _, s in batch)), schema[0])]
                names = schema[0].names
                if keyed:
                    columns.append(pa.array([int.from_bytes(d[:8], "big", signed=True) for d, _, _ in batch], pa.int64()))
                    names = [*names, key]
                return pa.RecordBatch.from_arrays(columns, names=names)

            yield from _out(grace(records(), table_bytes), build)

        return run

    reps = over_batches(df, round_of(True), T.StructType([*df.schema.fields, T.StructField(key, T.LongType())]))
    return over_batches(reps.repartition(key), round_of(False), df.schema)
