"""Language-model scoring from a log-frequency Bloom filter.

Training counts the n-grams of all training texts, exactly, by 64-bit hash.  A
count c is quantised to the level 1 + floor(log2 c), and the filter holds the
n-gram once for each level up to its own.  A reader probes level 1, 2, 3, ...
until one is missing, takes the middle of the last level as the count, and
interpolates the orders with Dirichlet smoothing.  The filter consists of
segments, by the n-gram's hash, each built by one task.  Their sizes follow the
number of n-grams, 8 bits an entry however many there are.  A filter within the
byte limit is broadcast; of a larger one the segments stay where they are, only the levels of the
commonest words are broadcast, the other distinct n-grams of each batch of texts
are sent to the segments, and the levels come back to the batch.  A count is never taken for more than the tokens learned
from, nor an n-gram's for more than its beginning's.

The base score beside it needs the exact count of every token.  The commonest
words (a fixed number) are broadcast with their counts; all other
words of a text are joined with the table of counts, where no word is common.

Edge cases: a null or blank text has one token, its end; a null id is never
held out by the caller's rule, and rows with a null or repeated id are scored
one by one; without training texts every count is zero and N is 0; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfold.llm.common import cut, mix64, over_batches, small_batches, text_bytes

ORDER = 2
#: Weight of the lower order, in counts.
DIRICHLET = 200.0
#: Bits for each entry of the filter, and hash functions.
ENTRY_BITS = 8
HASHES = 4
#: Bytes that the filter may have to be broadcast; n-grams are sent to the segments of a larger one.
FILTER_BYTES = 128 << 20
#: Commonest words that are broadcast with their counts.
COMMON_WORDS = 250_000
#: Bytes that all of them have together at most.
COMMON_BYTES = 16 << 20
#: Tokens for which a segment is laid out, about, and segments at least.
SEGMENT_TOKENS = 1_000_000
LEAST_SEGMENTS = 64
#: Words or n-grams that a task counts before it hands them on.
HELD_WORDS = 250_000
HELD_NGRAMS = 2_000_000
#: Levels that a count of 64 bits can have; probing ends there even where all bits are set.
MOST_LEVELS = 64
#: In the place of a level: the n-gram's segment must be asked.
ASKED = 255
#: The token that ends each text; no word is empty.
END = b""

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_BEFORE = np.uint64(0x5851F42D4C957F2D)
_LOWER = np.uint64(0xFFFFFFFF)


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), then the end."""
    found = text.lower().split()
    found.append(END)
    return found


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 17)


def ngram_hashes(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order: the hash of the n-gram that ends at each token; texts begin at ``starts``."""
    with np.errstate(over="ignore"):
        out = [mix64(words + _GOLDEN)]
        for n in range(1, order):
            context = np.empty_like(out[-1])
            context[1:] = out[-1][:-1]
            context[starts] = _BEFORE * np.uint64(n)
            out.append(mix64(context * _FOLD + words))
        return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; level 0 is the count 0."""
    top = np.exp2(levels)
    return np.where(levels > 0, (1.5 * top - 1) / 2, 0.0)


def _probes(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an n-gram's hash functions begin at a level, and their step; each takes the lower 32 bits of what it comes to."""
    with np.errstate(over="ignore"):
        x = mix64(h + np.uint64(level) * _GOLDEN)
    return x >> np.uint64(32), (x & _LOWER) | np.uint64(1)


def build_segment(h: np.ndarray, counts: np.ndarray, entry_bits: int = ENTRY_BITS) -> np.ndarray:
    """The bits of one segment, as bytes; their number is a multiple of 1024."""
    levels = levels_of(counts)
    size = 1024 * max(1, -(-int(levels.sum()) * entry_bits // 1024))
    bits = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        x, step = _probes(h[levels >= level], level)
        for _ in range(HASHES):
            bits[(x & _LOWER) * np.uint64(size) >> np.uint64(32)] = 1
            x += step
    return np.packbits(bits, bitorder="little")


def fold(segment: np.ndarray) -> np.ndarray:
    """Half as many bits: each joins two neighbours."""
    bits = np.unpackbits(segment, bitorder="little")
    return np.packbits(bits[::2] | bits[1::2], bitorder="little")


@dataclass
class Filter:
    """All segments in one array of bytes; ``offsets`` and ``sizes`` in bits; a segment is chosen by a hash's top bits."""

    bits: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing one level after the other."""
        out = np.zeros(len(h), np.int64)
        if not len(self.sizes):
            return out
        one = len(self.sizes) == 1
        shift = np.uint64(64 - (len(self.sizes).bit_length() - 1))
        segment = None if one else (h >> shift).astype(np.int64)
        alive = np.arange(len(h))
        level = 0
        while len(alive) and level < MOST_LEVELS:
            level += 1
            x, step = _probes(h[alive], level)  # an n-gram is hashed once for a level
            size, offset = (np.uint64(self.sizes[0]), self.offsets[0]) if one else (self.sizes[segment[alive]].astype(np.uint64), self.offsets[segment[alive]])
            for _ in range(HASHES):
                at = ((x & _LOWER) * size >> np.uint64(32)).astype(np.int64) + offset
                found = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                if not found.all():
                    alive, x, step = alive[found], x[found], step[found]
                    size, offset = (size, offset) if one else (size[found], offset[found])
                x += step
            out[alive] = level
        return out


@dataclass
class Common:
    """The commonest words, joined by spaces (the end of a text is the empty word), and their counts."""

    words: bytes
    counts: np.ndarray

    def listed(self) -> list[bytes]:
        return self.words.split(b" ") if len(self.counts) else []


@dataclass
class Model:
    """What training gives: the filter, the numbers of the base model, and the table of all counts."""

    filter: Filter | None  # None if too large to be broadcast
    segments: DataFrame
    segment_bits: int
    order: int
    n: int
    distinct: int
    texts: int
    common: Common
    counts: DataFrame
    dirichlet: float = DIRICHLET

    @property
    def scale(self) -> float:
        return self.n + 0.5 * (self.distinct + 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])

    _LAST[:] = None, None  # the scorer of an earlier model is of no use any more
    held: Counter = Counter()
    for b in batches:
        for text in text_bytes(b.column(0)):
            held.update(tokens(text))
            if len(held) > HELD_WORDS:
                yield out(held)
                held = Counter()
    yield out(held)


def _hash_batch(texts: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all tokens, and where each text begins."""
    words: list[bytes] = []
    starts = []
    for text in texts:
        starts.append(len(words))
        words += tokens(text)
    for w in set(words).difference(known):
        known[w] = word_hash(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > HELD_WORDS:
        known.clear()
    return h, np.array(starts, np.int64)


def _merged(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _by_segment(h: np.ndarray, segment_bits: int) -> tuple[np.ndarray, list[int]]:
    """The segment of each of some sorted hashes, and where each segment begins."""
    segment = (h >> np.uint64(64 - segment_bits)).astype(np.int64)
    return segment, np.nonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))[0].tolist()


def _count_ngrams(order: int, segment_bits: int):
    """Rows (segment, hashes, counts): packed arrays of the n-grams that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
            held.clear()
            if not len(h):
                return
            segment, first = _by_segment(h, segment_bits)
            for k in range(0, len(first), 64):
                cuts = [*first[k : k + 64], (first + [len(h)])[min(k + 64, len(first))]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment[cuts[:-1]].astype(np.int32)), pa.array([h[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                     pa.array([n[i:j].astype(np.uint32).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["segment", "h", "n"])

        for b in batches:
            texts = text_bytes(b.column(0))
            h, starts = _hash_batch(texts, known)
            if len(h):
                held += ngram_hashes(h, starts, order)
            if sum(map(len, held)) > HELD_NGRAMS:
                yield from out()
        yield from out()

    return run


def _build(entry_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for s, h, n in zip(*(c.to_pylist() for c in b.columns)):
                parts.setdefault(s, []).append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64)))
        for s in sorted(parts):
            x = parts.pop(s)
            bits = build_segment(*_merged(np.concatenate([h for h, _ in x]), np.concatenate([n for _, n in x])), entry_bits)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def _folded(times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, bits in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(bits, np.uint8)
                for _ in range(times):
                    if len(x) > 1:
                        x = fold(x)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def _commonest(counts: DataFrame, most: int, most_bytes: int = COMMON_BYTES) -> Common:
    """The words, however long, above the lowest count that at most ``most`` words of so many bytes reach, to a sixteenth of a doubling."""
    step = F.floor(F.log2("n") * 16)
    words, size, least = 0, 0, None
    sums = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum(F.octet_length("token").cast("bigint")).alias("bytes"))
    for r in sorted(sums.collect(), key=lambda r: -r.step):  # a thousand rows at most
        words += r.words
        size += r.bytes
        if words > most or size > most_bytes:
            break
        least = r.step
    if least is None:
        return Common(b"", np.zeros(0, np.int64))
    found = counts.where(step >= least).toArrow()
    return Common(b" ".join(found["token"].cast(pa.binary()).to_pylist()), found["n"].to_numpy())


def train(df: DataFrame, text: str = "text", order: int = ORDER, filter_bytes: int | None = None, entry_bits: int = ENTRY_BITS, common_words: int = COMMON_WORDS, dirichlet: float = DIRICHLET, broadcast_bytes: int = FILTER_BYTES) -> Model:
    """Learn from all rows of ``df``.

    A caller who gives ``filter_bytes`` wants a smaller filter with more false
    positives: neighbouring bits are joined until it fits.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(F.col(text))
    counts = cut(over_batches(texts, _count_words, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("token") == "", F.col("n"))), F.lit(0)).alias("texts")).first()
    common = _commonest(counts, common_words)
    bits = (max(LEAST_SEGMENTS, -(-total.n // SEGMENT_TOKENS)) - 1).bit_length()
    packed = over_batches(texts, _count_ngrams(order, bits), "segment int, h binary, n binary")
    segments = cut(over_batches(packed.repartition(1 << bits - 1, "segment"), _build(entry_bits), "segment int, bits binary"))
    size = segments.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    times = 0
    while filter_bytes is not None and size >> times > filter_bytes:
        times += 1
    if times:
        segments = over_batches(segments, _folded(times), "segment int, bits binary")
    if size >> times > broadcast_bytes:
        return Model(None, segments, bits, order, total.n, total.v, total.texts, common, counts, dirichlet)
    parts = {r.segment: np.frombuffer(r.bits, np.uint8) for r in segments.toLocalIterator()}
    least = np.zeros(1, np.uint8)  # of a segment without n-grams
    laid = [parts.get(s, least) for s in range(1 << bits)]
    sizes = np.array([8 * len(x) for x in laid], np.int64)
    held = Filter(np.concatenate(laid), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return Model(held, segments, bits, order, total.n, total.v, total.texts, common, counts, dirichlet)


def text_scores(counts: list[np.ndarray], begin: np.ndarray, n: int, scale: float, texts: int, dirichlet: float) -> np.ndarray:
    """The model's score of each text from the counts of the n-grams, n = 1, 2, ..., that end at each token."""
    count = np.minimum(counts[0], n)
    p = (count + 0.5) / scale
    for found in counts[1:]:
        context = np.empty_like(count)
        context[1:] = count[:-1]
        context[begin] = texts
        count = np.minimum(found, context)
        p = (count + dirichlet * p) / (context + dirichlet)
    return np.add.reduceat(np.log10(p), begin)


class _Words(dict):
    """Numbers of the common words; any other is -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Scorer:
    """Scores batches on a worker."""

    def __init__(self, filter: Filter | None, order: int, n: int, scale: float, texts: int, common: Common, dirichlet: float, levels: np.ndarray | None = None) -> None:
        self.filter, self.order, self.rest = filter, order, (n, scale, texts, dirichlet)
        words = common.listed()
        self.number = _Words(zip(words, range(len(words))))
        self.hash = np.fromiter(map(word_hash, words), np.uint64, len(words))
        self.log = np.log10((common.counts + 0.5) / scale)
        self.uni = count_of(filter.levels(mix64(self.hash + _GOLDEN))) if filter else None
        self.levels = levels if levels is not None else np.zeros(0, np.uint8)

    def _counts(self, h: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(h, return_inverse=True)
        return count_of(self.filter.levels(distinct))[back]

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Counter], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, common tokens, their base score, the model's score (0 without a filter here), the other words, its beginning; and of all words the hashes and, without a filter here, the levels (ASKED: not common)."""
        words: list[bytes] = []
        starts = []
        for text in texts:
            starts.append(len(words))
            words += tokens(text)
        begin = np.array(starts, np.int64)
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        rare = np.nonzero(number < 0)[0]
        rest = [words[i] for i in rare.tolist()]
        h = self.hash[number] if len(self.hash) else np.zeros(len(words), np.uint64)
        h[rare] = [word_hash(w) for w in rest]
        base = self.log[number] if len(self.hash) else np.zeros(len(words))
        base[rare] = 0
        score = np.zeros(len(texts))
        if self.filter:
            hashes = ngram_hashes(h, begin, self.order)
            count = self.uni[number] if len(self.hash) else np.zeros(len(words))
            count[rare] = self._counts(hashes[0][rare])
            score = text_scores([count, *map(self._counts, hashes[1:])], begin, *self.rest)
        size = np.diff(np.append(begin, len(words)))
        cuts = np.searchsorted(rare, np.append(begin, len(words)))
        others = [Counter(rest[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return size, size - np.diff(cuts), np.add.reduceat(base, begin), score, others, begin, h, np.where(number < 0, ASKED, self.levels[number] if len(self.levels) else 0).astype(np.uint8)


#: The scorer of the broadcast that this worker used last.
_LAST: list = [None, None]


def _scorer(value: tuple) -> Scorer:
    if _LAST[0] is not value:
        filter, *rest = value
        _LAST[:] = value, Scorer(filter and Filter(*filter), *rest)
    return _LAST[1]


def _common_levels(model: Model) -> np.ndarray:
    """The levels of the common words, from their segments; they are broadcast, so that no batch asks for them."""
    h = mix64(np.fromiter(map(word_hash, model.common.listed()), np.uint64, len(model.common.counts)) + _GOLDEN)
    order = np.argsort(h)
    shared, bits = model.segments.sparkSession.sparkContext.broadcast(h[order]), model.segment_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        segment = (held >> np.uint64(64 - bits)).astype(np.int64)
        for b in batches:
            for s, x in zip(*(c.to_pylist() for c in b.columns)):
                i, j = np.searchsorted(segment, [s, s + 1]).tolist()
                one = Filter(np.frombuffer(x, np.uint8), np.zeros(1, np.int64), np.array([8 * len(x)]))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([one.levels(held[i:j]).astype(np.uint8).tobytes()], pa.binary())], names=["first", "levels"])

    out = np.zeros(len(h), np.uint8)
    if len(h):
        for r in model.segments.select("segment", "bits").mapInArrow(run, "first bigint, levels binary").toLocalIterator():
            out[order[r.first : r.first + len(r.levels)]] = np.frombuffer(r.levels, np.uint8)
    return out


def _asked(words: np.ndarray, begin: np.ndarray, known: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes whose segments must be asked: of words that are not common, then of all longer n-grams; and the places of these words."""
    hashes, rare = ngram_hashes(words, begin, order), np.nonzero(known == ASKED)[0]
    return np.concatenate([hashes[0][rare], *hashes[1:]]), rare


def _from_segments(batches_of_words: DataFrame, model: Model) -> DataFrame:
    """(row, score) from batches (row of the first text, hashes of words, beginnings of texts, levels of common words), whose other n-grams are sent to their segments."""
    order, bits, rest = model.order, model.segment_bits, (model.n, model.scale, model.texts, model.dirichlet)
    read = lambda x, kind: np.frombuffer(x, kind)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, words, begin, known in zip(*(c.to_pylist() for c in b.columns)):
                h = np.unique(_asked(read(words, np.uint64), read(begin, np.int64), read(known, np.uint8), order)[0])
                if not len(h):
                    continue
                segment, first = _by_segment(h, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), row)), pa.array(segment[first].astype(np.int32)), pa.array([h[i:j].tobytes() for i, j in zip(first, [*first[1:], len(h)])], pa.binary())], names=["first", "segment", "h"])

    def probe(asked: pa.Table, segment: pa.Table) -> pa.Table:
        held = read(segment.column("bits")[0].as_py(), np.uint8) if segment.num_rows else np.zeros(1, np.uint8)
        one = Filter(held, np.zeros(1, np.int64), np.array([8 * len(held)]))
        found = [one.levels(read(h.as_py(), np.uint64)).astype(np.uint8).tobytes() for h in asked.column("h")]
        return pa.table({"first": asked.column("first"), "segment": asked.column("segment"), "levels": pa.array(found, pa.binary())})

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = count_of(np.arange(ASKED + 1))
        for b in batches:
            for row, words, begin, known, levels in zip(*(c.to_pylist() for c in b.columns)):
                begin, known = read(begin, np.int64), read(known, np.uint8)
                asked, rare = _asked(read(words, np.uint64), begin, known, order)
                _, back = np.unique(asked, return_inverse=True)
                count = counts[read(b"".join(levels or []), np.uint8)][back]  # segments follow the order of hashes
                single = counts[known]
                single[rare] = count[: len(rare)]
                longer = [count[len(rare) + k * len(known) : len(rare) + (k + 1) * len(known)] for k in range(order - 1)]
                score = text_scores([single, *longer], begin, *rest)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(begin))), pa.array(score)], names=["row", "score"])

    asked = over_batches(batches_of_words, ask, "first bigint, segment int, h binary")
    found = asked.groupBy("segment").cogroup(model.segments.groupBy("segment")).applyInArrow(probe, "first bigint, segment int, levels binary")
    levels = found.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("segment", "levels"))).alias("found"))
    held = batches_of_words.join(levels, F.col("row") == F.col("first"), "left").select("row", "words", "begin", "known", "found.levels")
    return held.mapInArrow(tell, "row bigint, score double")


def score(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keys, n_tokens, n_known, base_score, score) of every row.

    A text's own row and a row for each of its rarer words go through one join
    with the counts, keyed by the word (the text's own by a key that no word
    has), and come together again by the text's number.  Where the filter is too
    large to be broadcast, scores from its segments join them there.
    """
    spark = df.sparkSession
    small_batches(spark)
    f = model.filter
    shared = spark.sparkContext.broadcast((f and (f.bits, f.offsets, f.sizes), model.order, model.n, model.scale, model.texts, model.common, model.dirichlet, None if f else _common_levels(model)))
    ids = [id, *keys]
    width = len(ids)
    names = [*(f"k{i}" for i in range(width)), "row", "own", "token", "times", "n_tokens", "n_known", "base_score", "score"] + ([] if f else ["words", "begin", "known"])
    types = (pa.bool_(), pa.string(), *[pa.int64()] * 3, *[pa.float64()] * 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            size, known, base, total, others, begin, h, levels = scorer.batch(text_bytes(b.column(0)))
            numbers = np.arange(row, row + b.num_rows)
            row += b.num_rows
            per = np.fromiter(map(len, others), np.int64, b.num_rows)
            of = np.repeat(np.arange(b.num_rows), per)
            take = pa.array(np.concatenate([np.arange(b.num_rows), of]))
            rarer = len(of)
            own = pa.array(np.concatenate([np.ones(b.num_rows, bool), np.zeros(rarer, bool)]))
            words = pa.array([f" {x}".encode() for x in numbers.tolist()] + [w for c in others for w in c], pa.binary()).cast(pa.string())
            times = np.concatenate([np.zeros(b.num_rows, np.int64), np.fromiter((x for c in others for x in c.values()), np.int64, rarer)])
            full = [np.concatenate([x, np.zeros(rarer, x.dtype)]) for x in (size, known, base, total)]
            columns = [c.take(take) for c in b.columns[1:]]
            columns += [pa.array(np.concatenate([numbers, numbers[of]])), own, words, *map(pa.array, (times, *full))]
            yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(own), pa.binary())] * (len(names) - len(columns)), names=names)
            if not scorer.filter:
                none = [pa.nulls(1, c.type) for c in b.columns[1:]]
                yield pa.RecordBatch.from_arrays([*none, pa.array(numbers[:1]), *(pa.nulls(1, t) for t in types), *(pa.array([x.tobytes()], pa.binary()) for x in (h, begin, levels))], names=names)

    picked = df.select(F.col(text).alias("__text"), *ids)
    head = ", ".join(f"`k{i}` {f.dataType.simpleString()}" for i, f in enumerate(picked.schema.fields[1:]))
    rows = over_batches(picked, run, f"{head}, row bigint, own boolean, token string, times bigint, n_tokens bigint, n_known bigint, base_score double, score double" + ("" if f else ", words binary, begin binary, known binary"))
    if not f:
        rows = cut(rows)
        told = _from_segments(rows.where("words is not null").select("row", "words", "begin", "known"), model)
        rows = rows.where("words is null").drop("words", "begin", "known")
    n = F.coalesce(F.col("n"), F.lit(0))
    joined = rows.join(model.counts, "token", "left").select(
        *(F.when(F.col("own"), F.col(f"k{i}")).alias(f"k{i}") for i in range(width)), "row", "n_tokens", "score",
        (F.col("n_known") + F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base_score") + F.col("times") * F.log10((n + 0.5) / F.lit(model.scale))).alias("base_score"))
    if not f:
        joined = joined.unionByName(told, allowMissingColumns=True)
    summed = joined.groupBy("row").agg(*(F.max(f"k{i}").alias(f"k{i}") for i in range(width)), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return summed.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(ids)), "n_tokens", "n_known", "base_score", "score")

