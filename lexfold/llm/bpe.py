"""Byte-level BPE encoding and decoding with an index of pair occurrences.

The distinct words of a batch lie in one row of symbols.  An index maps each
adjacent pair that has a merge rank to all its positions.  The active ranks are
taken in ascending order; each merges all its positions at once (of overlapping
ones the left) and updates the lists of the pairs to the left and right.  A pair that a merge makes
always has a later rank, so this gives each word what merging it alone gives.

Edge cases: a null or empty text has no tokens and decodes to the empty text;
long texts are encoded whole; equal rows give equal rows; an empty table gives
none; other columns are ignored.  A string of an added special token in a text
becomes that token, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfold.llm.common import over_batches, small_batches

#: Words whose tokens a worker remembers, in either of two generations.
REMEMBERED_WORDS = 200_000
#: Ids that are written or decoded at once.
PIECE = 1 << 16

#: How byte-level BPE cuts a text into words (fixed value of the vocabulary's format).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The printable letter by which the vocabulary file writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class PairIndexBpe:
    """A vocabulary, its encoder and its decoder.  ``spec`` is the tokenizer's JSON file as a dict."""

    def __init__(self, spec: dict) -> None:
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.pieces = Strings(self.bytes_of)
        self.decimals = Strings({i: b"%d," % i for i in self.bytes_of})
        self.first = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        self.partners_right = self._partners(self.left, self.right)
        self.partners_left = self._partners(self.right, self.left)
        byte_id = {int(t): b for b, t in enumerate(self.first)}
        self.byte_rank = np.full((256, 256), -1, np.int64)
        for r, (a, b) in enumerate(zip(self.left, self.right)):
            if a in byte_id and b in byte_id:
                self.byte_rank[byte_id[a], byte_id[b]] = r
        self.words = regex.compile(WORD_PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    @staticmethod
    def _partners(of: list[int], other: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each token: the tokens it merges with on one side, sorted, and the ranks."""
        order = np.lexsort((other, of))
        tokens, first = np.unique(np.array(of)[order], return_index=True)
        return dict(zip(tokens.tolist(), zip(np.split(np.array(other)[order], first[1:]), np.split(order, first[1:]))))

    def merge(self, words: list[str]) -> list[str]:
        """The tokens of each word, as a string whose characters are their ids."""
        coded = [w.encode() for w in words]
        row = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        n = len(row)
        if not n:
            return ["" for _ in words]
        ranks = np.append(self.byte_rank[row[:-1], row[1:]], -1)
        ranks[ends[ends > 0] - 1] = -1  # no pair reaches into the next word
        at = np.nonzero(ranks >= 0)[0]
        heap: list[int] = []
        index: dict[int, list[np.ndarray]] = {}

        def add(found: np.ndarray, places: np.ndarray) -> None:
            """Enter places under their pairs' ranks."""
            order = np.argsort(found, kind="stable")
            found, places = found[order], places[order]
            first = np.nonzero(found[1:] != found[:-1])[0] + 1
            for r, p in zip(found[np.append(0, first)].tolist(), np.split(places, first)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heappush(heap, r)

        if len(at):
            add(ranks[at], at)
        # symbols in a list linked both ways; place n stands for "none"
        symbols = np.append(self.first[row], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends[:-1]] = n
        before[0] = after[n] = n
        while heap:
            r = heappop(heap)
            a, b, new = self.left[r], self.right[r], self.made[r]
            places = index.pop(r)
            p = places[0] if len(places) == 1 else np.concatenate(places)
            if a == b:
                p = np.unique(p)
            q = after[p]
            good = (symbols[p] == a) & (symbols[q] == b)
            if not good.all():
                p, q = p[good], q[good]
            if a == b and len(p) > 1:  # in a run of equal symbols every other pair is free
                chain_begins = np.append(True, q[:-1] != p[1:])
                nth = np.arange(len(p))
                nth -= np.maximum.accumulate(np.where(chain_begins, nth, 0))
                p, q = p[nth % 2 == 0], q[nth % 2 == 0]
            if not len(p):
                continue
            symbols[p] = new
            symbols[q] = -1
            q = after[q]
            after[p] = q
            before[q] = p
            for partners, beside, places in ((self.partners_right, q, p), (self.partners_left, before[p], before[p])):
                if new in partners:
                    tokens, rank = partners[new]
                    near = symbols[beside]
                    k = np.minimum(np.searchsorted(tokens, near), len(tokens) - 1)
                    hit = tokens[k] == near
                    if hit.any():
                        add(rank[k[hit]], places[hit])
        alive = symbols[:n] >= 0
        flat = symbols[:n][alive].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        cuts = np.append(0, np.cumsum(alive))[ends].tolist()
        return [flat[i:j] for i, j in zip([0, *cuts], cuts)]

    def codes(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as an array."""
        cut = [[(x, x in self.special) for x in self.cut.split(t) if x] if self.cut and any(s in t for s in self.special) else [(t, False)] for t in texts]
        split = [[chr(self.special[x]) if special else self.words.findall(x) for x, special in parts] for parts in cut]
        new = set(chain.from_iterable(w for parts in split for w in parts if isinstance(w, list)))
        new.difference_update(self.known)
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            # keep what has been met since the last time
            new.update(chain.from_iterable(w for parts in split for w in parts if isinstance(w, list)))
            self.older, self.known = self.known, {}
        for w in new.intersection(self.older):
            self.known[w] = self.older[w]
            new.discard(w)
        if new:
            ordered = list(new)
            self.known.update(zip(ordered, self.merge(ordered)))
        known = self.known.__getitem__
        for parts in split:
            written = "".join(["".join(map(known, w)) if isinstance(w, list) else w for w in parts])
            yield np.frombuffer(written.encode("utf-32-le", "surrogatepass"), "<u4")

    def encode_batch(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for ids in self.codes(texts):
            yield ids.tolist()

    def decode(self, ids: Iterable[int], skip_special: bool = False) -> str:
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        if skip_special:
            ids = ids[~np.isin(ids, list(self.special.values()))]
        return self.pieces.joined(ids).decode("utf-8", "replace")

    def written(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimals.joined(ids)[:-1]


class Strings:
    """Byte strings by number, laid out so that many are joined by one gather."""

    def __init__(self, strings: dict[int, bytes]) -> None:
        laid = [strings.get(i, b"") for i in range(max(strings, default=-1) + 1)]
        self.sizes = np.array([len(x) for x in laid], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.row = np.frombuffer(b"".join(laid), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        out = []
        for k in range(0, len(numbers), PIECE):
            part = numbers[k : k + PIECE]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            at = np.repeat(self.begins[part] - ends + sizes, sizes)
            at += np.arange(len(at))
            out.append(self.row[at].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _loaded(spec: str) -> PairIndexBpe:
    return PairIndexBpe(json.loads(spec))


def _run(df: DataFrame, id: str, text: str, path: str, names: list[str], types: list[pa.DataType], ddl: str, row) -> DataFrame:
    """The vocabulary (a file of fixed size) is read on the driver and broadcast, so workers need no such path."""
    small_batches(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [row(bpe, ids) for ids in bpe.codes(texts)]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[id, *names])

    picked = df.select(id, text)
    return over_batches(picked, run, f"`{id}` {picked.schema[0].dataType.simpleString()}, {ddl}")


def encode(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    return _run(df, id, text, path, ["ids"], [pa.list_(pa.int32())], "ids array<int>", lambda bpe, ids: (ids.astype(np.int32),))


def decode(df: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give null."""
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id, "text"])

    picked = df.select(id, F.col(ids).cast("array<int>"))
    return over_batches(picked, run, f"`{id}` {picked.schema[0].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: its ids, and the text decoded from them, as digests."""

    def row(bpe: PairIndexBpe, ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(bpe.written(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return _run(df, id, text, path, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()],
                "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)
