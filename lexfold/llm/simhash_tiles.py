"""SimHash near-duplicates by tiled exact comparison.

``near_duplicates`` links fingerprints within a few bits; ``similar`` links texts
whose shingles agree to a given share: texts that have one of their rarest
shingles in common make blocks of candidates, fingerprints find loose groups
within these, and the shingles decide inside the groups.

A fingerprint has a bit for each in which over half of the text's shingle
hashes have one.  The distinct fingerprints are dealt into tiles by the
population counts of their two halves.  Two fingerprints within the radius
differ by no more than it in these counts together, so tile pairs beyond that
are skipped; within a pair numpy compares all with exclusive-or and bit counts.
A pair returns links that span its components, never all its matches.

Edge cases: a null or blank text has no shingle and the fingerprint zero, which
links like any other; a text of fewer words than a shingle has one, the whole
sequence; an empty table gives no rows; repeated rows and equal fingerprints
fall together; a null id is never the smallest of a component unless all are
null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfold.llm.common import cut, drop_old_rounds, mix64, over_batches, small_batches, text_bytes, unused
from lexfold.llm.graph import connected_components, local_roots

SHINGLE_WORDS = 3
RADIUS = 3
#: Similar texts: words to a shingle, least Jaccard similarity of the sets of shingles, lanes of 64 bits to a fingerprint.
SIMILAR_WORDS, SIMILARITY, SIMILAR_LANES = 5, 0.8, 6
#: Lanes that are compared first; the others only for pairs that these leave.
COARSE_LANES = 4
#: Share of pairs at the least similarity that a radius may lose, and shingles of two sets together up to which their bits are reckoned exactly.
LOST, EXACT_UNION = 1e-12, 64
SEED = 42
#: Fingerprints that a tile holds; larger classes of equal counts become several tiles.
TILE_ROWS = 4096
WIDE_TILE_ROWS = 16384
#: Lanes of the fingerprints that order the comparisons inside a loose group, and rows of a block of a large group.
WIDE_LANES, BLOCK_ROWS = 16, 4096
#: Blocks that a group is dealt in before its blocks grow to that size, and the part of it that a block has at least.
FIRST_BLOCKS, LEAST_PART = 16, 8
#: Words whose hashes a task keeps, and shingles that it counts, or lists by segment, before it hands them on.
HELD_WORDS, HELD_SHINGLES = 250_000, 2_000_000
#: Shingles that are broadcast as common at most, and times that one is met twice in a task's shingles before it may be.
COMMON_SHINGLES, COMMON_TIMES = 1 << 19, 8
#: Rarest shingles for which a segment is laid out, about, and segments at least (as bits).
SEGMENT_SHINGLES, LEAST_SEGMENT_BITS = 500_000, 6
#: Pairs of fingerprints in a block that are compared at once.
PAIRS = 1 << 18
#: Of each text, its nearest that are compared before all others.
NEAREST = 4
#: Rows of a tile compared at once against the other tile.
STRIPE = 256
#: Shingles whose hashes are held at once; a longer text is counted piece by piece.
PIECE = 1 << 18

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = len(found) - words + 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros((8, 8), np.int64)
    for k in range(0, n, PIECE):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[k : k + PIECE], ends[k : k + PIECE])], np.uint64)
        if len(h) < 1000:
            votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64).reshape(8, 8)
        else:
            octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
            for b in range(8):
                votes[b] += np.bincount(octets[:, b], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(votes.reshape(64) * 2 > n).tobytes(), "big")


class _Hashes(dict):
    """Hashes of words, kept for the next text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_hashes(text: bytes, words: int, known: _Hashes | None = None) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; each from the hashes of its words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    known = _Hashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    factor = 1
    with np.errstate(over="ignore"):
        for k in range(size):
            factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
            out += h[k : k + n] * np.uint64(factor)
        return np.unique(mix64(out))


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> list[int]:
    """A fingerprint of 64 bits for each lane from a set of hashes, as signed integers; the lanes mix the hashes differently."""
    out = []
    for lane in range(lanes):
        votes = np.zeros((8, 8), np.int64)
        for k in range(0, len(hashes), PIECE):
            h = hashes[k : k + PIECE]
            with np.errstate(over="ignore"):
                h = mix64(h + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)) if lane else h
            octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
            for b in range(8):
                votes[b] += np.bincount(octets[:, b], minlength=256) @ _BITS
        out.append(int.from_bytes(np.packbits(votes.reshape(64) * 2 > len(hashes)).tobytes(), "big", signed=True))
    return out


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed bigint.  ``id`` may be a list of columns."""
    small_batches(df.sparkSession)
    ids = [id] if isinstance(id, str) else list(id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in text_bytes(b.column(0))), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps)], names=[*ids, "fp"])

    picked = df.select(F.col(text).alias("__text"), *ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return over_batches(picked, run, f"{schema}, fp bigint")


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links i-j at distance d among n nodes, those of a minimum spanning forest: nearest links first."""
    order = np.argsort(d, kind="stable")
    i, j, d = i[order], j[order], d[order]
    roots, kept = np.arange(n), []
    place = np.arange(len(i))
    while True:
        x, y = roots[i[place]], roots[j[place]]
        apart = x != y
        if not apart.any():
            kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            return i[kept], j[kept], d[kept]
        place, x, y = place[apart], x[apart], y[apart]
        nearest = np.full(n, len(i))
        np.minimum.at(nearest, x, place)
        np.minimum.at(nearest, y, place)
        chosen = np.unique(nearest[nearest < len(i)])
        kept.append(chosen)
        roots = local_roots(n, i[chosen], j[chosen], roots)


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int, coarse: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, then b) of the links that span the components of two tiles' fingerprints, nearest first.

    a, b: [fingerprint, lane].  ``coarse`` is the radius of the first COARSE_LANES lanes.
    """
    n = len(a) if same else len(a) + len(b)
    shift = 0 if same else len(a)
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    first = b.shape[1] if coarse is None else min(COARSE_LANES, b.shape[1])
    columns = [np.ascontiguousarray(b[:, lane])[None, :] for lane in range(first)]
    for k in range(0, len(a), STRIPE):
        away = np.bitwise_count(a[k : k + STRIPE, :1] ^ columns[0])
        if first > 3:  # more bits than a byte counts
            away = away.astype(np.uint16)
        for lane in range(1, first):
            away += np.bitwise_count(a[k : k + STRIPE, lane : lane + 1] ^ columns[lane])
        i, j = np.nonzero(away <= (radius if first == b.shape[1] else coarse))
        d = away[i, j].astype(np.int64)
        if first < b.shape[1]:
            d += np.bitwise_count(a[i + k, first:] ^ b[j, first:]).sum(axis=1, dtype=np.int64)
            i, j, d = i[d <= radius], j[d <= radius], d[d <= radius]
        if same:
            i, j, d = i[i + k < j], j[i + k < j], d[i + k < j]
        if len(i):
            held = forest(n, *(np.concatenate(x) for x in zip(held, (i + k, j + shift, d))))
    return held[0], held[1]


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, lanes: tuple[str, ...] = ("fp",), node: str = "fp", coarse: int | None = None) -> DataFrame:
    """(u, v): links that span the components of distinct fingerprints.

    ``lanes`` are the columns of 64 bits that make up a fingerprint, ``node`` the
    column that names it.  The population counts of two halves choose the tile:
    of a single lane its own halves, else of the first lanes and the others.
    """
    spark = distinct.sparkSession
    # some 200 * lanes / width^2 classes hold nearly all fingerprints; they are wide enough to fill tiles
    width = max(1, (radius + 1) // 4, math.isqrt(100 * len(lanes) * tile_rows // max(1, distinct.count())))
    if len(lanes) == 1:
        half = [F.bit_count(F.shiftrightunsigned(F.col(lanes[0]), s).bitwiseAND(F.lit(0xFFFFFFFF))) for s in (32, 0)]
    else:
        middle = len(lanes) // 2
        half = [sum((F.bit_count(c) for c in part[1:]), F.bit_count(part[0])) for part in (lanes[:middle], lanes[middle:])]
    classed = distinct.select(F.col(node).alias("node"), F.array(*lanes).alias("fp"), *(F.floor(h / width).cast("int").alias(c) for h, c in zip(half, ("hi", "lo"))))
    # their number is bounded by the counts of bits
    sizes = {(r.hi, r.lo): -(-r.n // tile_rows) for r in classed.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "u bigint, v bigint")
    least = lambda x, y: max(0, (abs(x - y) - 1) * width + 1) if x != y else 0  # noqa: E731  difference of counts in two classes
    pairs = [(h, l, n, h2, l2, m) for (h, l), n in sorted(sizes.items()) for (h2, l2), m in sorted(sizes.items()) if least(h, h2) + least(l, l2) <= radius]
    near = spark.createDataFrame(pairs, "hi int, lo int, n int, hi2 int, lo2 int, m int")
    parts = F.create_map(*[x for (h, l), n in sizes.items() for x in (F.lit(h * 1024 + l), F.lit(n))])
    tiles = (classed.withColumn("sub", F.pmod(F.xxhash64("node"), parts[F.col("hi") * 1024 + F.col("lo")]).cast("int"))
             .groupBy("hi", "lo", "sub").agg(F.collect_list(F.struct("node", "fp")).alias("fps")))
    mine, other = F.struct("hi", "lo", "sub"), F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("sub2").alias("sub"))
    dealt = (tiles.join(F.broadcast(near), ["hi", "lo"]).withColumn("sub2", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
             .select(F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b"), F.col("fps.node").alias("nodes"), F.flatten("fps.fp").alias("bits")))
    # a pair of tiles is little data and much work, so that partitions are not joined by their size
    tasks = min(20_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(n * m for _, _, n, _, _, m in pairs) // 8))

    def run(t: pa.Table) -> pa.Table:
        nodes = [np.asarray(x.values).astype(np.int64) for x in t.column("nodes").combine_chunks()]
        bits = [np.asarray(x.values).astype(np.int64).view(np.uint64).reshape(-1, len(lanes)) for x in t.column("bits").combine_chunks()]
        same = t.column("a")[0].as_py() == t.column("b")[0].as_py()
        u, v = compare(bits[0], bits[-1], same, radius, coarse) if same or len(bits) == 2 else (np.zeros(0, np.int64),) * 2
        every = nodes[0] if same else np.concatenate(nodes)
        return pa.table({"u": every[u], "v": every[v]})

    return dealt.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(run, "u bigint, v bigint")


def rarest(hashes: np.ndarray, similarity: float, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Of a sorted set the first shingles by (level, hash), of which it shares one with every set of this Jaccard similarity.

    Such a set has ``similarity`` of the shingles of either in common, so that not all that are left over come before the first common one.
    Any order that all sets follow will do; the rarer come first, so that few sets meet.
    """
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(np.where(common[at] == hashes, level[at], 0), kind="stable")]
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def _common_shingles(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that are met most often, and the logarithms of their counts; they only order the shingles."""
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, n in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(n, np.uint32).astype(np.int64))], names=["h", "n"])

    level = F.floor(F.log2("n")).cast("tinyint")
    counts = cut(counted.mapInArrow(flat, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_TIMES).select("h", level.alias("level")))
    total, least = 0, 127
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r.level):
        total += r["count"]
        if total > COMMON_SHINGLES:
            break
        least = r.level
    found = counts.where(F.col("level") >= least).toArrow()
    h = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found["level"].to_numpy()[order]


def _blocks(rarest_of: DataFrame, bits: int) -> DataFrame:
    """(key, nodes): the sets that have a rare shingle in common, each combination of sets once; from rows (segment, hashes, nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for s, h, node in zip(*(c.to_pylist() for c in b.columns)):
                parts.setdefault(s, []).append((h, node))
        for s in sorted(parts):
            x = parts.pop(s)
            h, node = np.frombuffer(b"".join(h for h, _ in x), np.uint64), np.frombuffer(b"".join(n for _, n in x), np.int64)
            order = np.lexsort((node, h))
            h, node = h[order], node[order]
            new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
            h, node = h[new], node[new]
            first = np.append(np.nonzero(np.append(True, h[1:] != h[:-1]))[0], len(h))
            shared = np.nonzero(np.diff(first) > 1)[0]
            found = list({node[i:j].tobytes() for i, j in zip(first[shared].tolist(), first[shared + 1].tolist())})
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(x, SEED) - (1 << 63) for x in found], pa.int64()), pa.array(found, pa.binary())], names=["key", "nodes"])

    dealt = rarest_of.repartition(1 << bits - 2, "segment")
    return over_batches(dealt, run, "key bigint, nodes binary").dropDuplicates(["key", "nodes"])


def spanning(bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that span the components of fingerprints [fingerprint, lane]; what a component has reached is compared no more with it."""
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    reached, left = np.zeros(1, np.int64), np.arange(1, len(bits))
    while len(left):
        if not len(reached):
            reached, left = left[:1], left[1:]
            continue
        stripe = max(1, PAIRS // len(left))
        now, reached = reached[:stripe], reached[stripe:]
        away = np.zeros((len(now), len(left)), np.uint16)
        for lane in range(bits.shape[1]):
            away += np.bitwise_count(bits[now, lane][:, None] ^ bits[left, lane][None, :])
        near = away <= radius
        hit = near.any(axis=0)
        if hit.any():
            u.append(now[near[:, hit].argmax(axis=0)])
            v.append(left[hit])
            reached, left = np.concatenate([reached, left[hit]]), left[~hit]
    return np.concatenate(u), np.concatenate(v)


def links_within(blocks: DataFrame, distinct: DataFrame, radius: int, lanes: tuple[str, ...], tile_rows: int = WIDE_TILE_ROWS) -> DataFrame:
    """(u, v): links that span the components of the fingerprints in each block (key, nodes); ``distinct`` has node and lanes.

    A block of more than ``tile_rows`` is dealt in tiles, and every pair of its tiles is a unit of its own.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for key, nodes in zip(*(c.to_pylist() for c in b.columns)):
                nodes = np.frombuffer(nodes, np.int64)
                part = np.arange(len(nodes)) // tile_rows
                for other in range(int(part[-1]) + 1):
                    for c, x in zip(out, (np.full(len(nodes), key), np.minimum(part, other), np.maximum(part, other), nodes)):
                        c.append(x)
                    if sum(map(len, out[0][-1:])) >= tile_rows:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "a", "b", "node"])
                        out = [[], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "a", "b", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> tuple[np.ndarray, np.ndarray]:
            x = np.concatenate(held)
            u, v = spanning(x[:, 1:].view(np.uint64), radius)
            return x[u, 0], x[v, 0]

        for b in batches:
            columns = np.column_stack([c.to_numpy() for c in b.columns])
            units, rest = columns[:, :3], np.ascontiguousarray(columns[:, 3:])
            first = [0, *(np.nonzero((units[1:] != units[:-1]).any(axis=1))[0] + 1).tolist(), len(units)]
            found = []
            for i, j in zip(first, first[1:]):
                if j > i:
                    if (unit := tuple(units[i].tolist())) != now:
                        if held:
                            found.append(out())
                        now, held = unit, []
                    held.append(rest[i:j])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["u", "v"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out()], names=["u", "v"])

    dealt = over_batches(blocks.select("key", "nodes"), deal, "key bigint, a bigint, b bigint, node bigint")
    dealt = dealt.join(distinct.select("node", *lanes), "node").select("key", "a", "b", "node", *lanes)
    return over_batches(dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node"), run, "u bigint, v bigint")


def _with_components(rows: DataFrame, distinct: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``rows`` with component (smallest id reachable) and root (smallest node); ``distinct`` has (node, low)."""
    rooted = cut(connected_components(edges)).withColumnRenamed("node", "__node")
    alone = distinct.join(rooted, F.col(node) == F.col("__node"), "left").select(node, "low", F.coalesce("root", node).alias("root"))
    lowest = cut(alone.groupBy("root").agg(F.min("low").alias("component")))
    of = cut(alone.join(lowest, "root").select(node, "component", "root"))
    return rows.join(of, node)


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component, root) of every row; links are fingerprints of 64 bits that differ in ``radius`` bits at most.

    ``component`` is the smallest id reachable, ``root`` the smallest fingerprint.
    """
    rows = cut(fingerprints(df, id, text, words))
    distinct = cut(rows.groupBy("fp").agg(F.min(id).alias("low")))
    return _with_components(rows, distinct, links(distinct.select("fp"), radius), "fp").select(id, "fp", "component", "root")


def _flip_rate(common: int, a: int, b: int) -> float:
    """The chance that a bit differs between sets with ``common`` shingles in common and a, b of their own."""
    chances = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n

    def one(own: int) -> np.ndarray:
        """That the bit is 1, by the votes of the common shingles."""
        least = np.append(np.cumsum(chances(own)[::-1])[::-1], 0.0)
        return least[np.clip((common + own) // 2 + 1 - np.arange(common + 1), 0, own + 1)]

    x, y = one(a), one(b)
    return float(chances(common) @ (x * (1 - y) + y * (1 - x)))


@lru_cache
def flip_rate(similarity: float) -> float:
    """The most that a bit may differ in between two sets of this Jaccard similarity at least: small sets exactly, then the limit of large ones."""
    rates = [math.acos(2 * similarity / (1 + similarity)) / math.pi]
    for union in range(1, EXACT_UNION + 1):
        for common in range(math.ceil(similarity * union - 1e-9), union + 1):
            rates += [_flip_rate(common, a, union - common - a) for a in range((union - common) // 2 + 1)]
    return max(rates)


@lru_cache
def radius_for(similarity: float, bits: int) -> int:
    """Bits in which the fingerprints of two sets of this Jaccard similarity, however small, differ at most, but for a share LOST of pairs."""
    p, beyond = flip_rate(similarity), 0.0
    for k in range(bits, 0, -1):
        beyond += math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(p) + (bits - k) * math.log1p(-p))
        if beyond > LOST:
            return k
    return 0


def similar(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, lanes: int = SIMILAR_LANES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, key, node, component, root) of every row; links are texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    Two such texts share one of their rarest shingles (``rarest``), whose number is a fifth of all, so that only texts that do are compared.
    Fingerprints join what may be similar of these, within a radius that one
    such pair in 10^12 exceeds, whatever the sizes of its sets, to loose groups.  Inside a group all pairs whose
    wider fingerprints are near enough are compared by their shingles, nearest first,
    unless links found so far join them already.  A large group is dealt in
    blocks, and every pair of its blocks is a task.  ``key`` hashes the text,
    ``node`` the set of shingles.
    """
    small_batches(df.sparkSession)
    named = df.select(id, F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    id_type = named.schema[0].dataType.simpleString()
    columns = [f"l{k}" for k in range(lanes)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = _Hashes(), []

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            packed = [h[n > 1].tobytes(), n[n > 1].astype(np.uint32).tobytes()]
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), *(pa.array([x], pa.binary()) for x in packed)], names=names)

        types: list[pa.DataType] = []
        for b in batches:
            types = [b.column(0).type, *[pa.int64()] * (3 + lanes)]
            sets = [shingle_hashes(t, words, known) for t in text_bytes(b.column(2))]
            wide = np.array([wide_fingerprint(h, lanes) for h in sets], np.int64).reshape(-1, lanes)
            described = [b.column(0), b.column(1), pa.array([_node(h) for h in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), *(pa.array(wide[:, k]) for k in range(lanes))]
            yield pa.RecordBatch.from_arrays([*described, *[pa.nulls(b.num_rows, pa.binary())] * 2], names=names)
            held += sets
            if sum(map(len, held)) > HELD_SHINGLES:
                yield counted()
        if held:
            yield counted()

    def list_rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, nodes = _Hashes(), [], []
        common, level = shared.value

        def out() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held)
            segment = (h & np.uint64((1 << bits) - 1)).astype(np.int32)  # the top bits go into the order of the shingles
            order = np.argsort(segment, kind="stable")
            segment, h, node = segment[order], h[order], np.repeat(nodes, list(map(len, held)))[order]
            held.clear()
            nodes.clear()
            first = [*np.nonzero(np.append(True, segment[1:] != segment[:-1]))[0].tolist(), len(h)]
            for k in range(0, len(first) - 1, 64):
                cuts = first[k : k + 65]
                yield pa.RecordBatch.from_arrays([pa.array(segment[cuts[:-1]]), *(pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in (h, node))], names=["segment", "h", "nodes"])

        for b in batches:
            for t in text_bytes(b.column(0)):
                if len(h := shingle_hashes(t, words, known)):
                    held.append(rarest(h, similarity, common, level))
                    nodes.append(_node(h))
            if sum(map(len, held)) > HELD_SHINGLES:
                yield from out()
        if held:
            yield from out()

    def list_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            sets = [shingle_hashes(t, words, known) for t in text_bytes(b.column(2))]
            wide = [np.array(wide_fingerprint(h, WIDE_LANES), np.int64).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in sets], pa.int64()), pa.array(wide, pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["node", "wide", "shingles"])

    names = [id, "key", "node", "size", *columns, "h", "n"]
    described = cut(over_batches(named, describe, f"`{id}` {id_type}, key bigint, node bigint, size bigint, " + ", ".join(f"{c} bigint" for c in columns) + ", h binary, n binary"))
    rows = described.where("node is not null").drop("h", "n")
    shared = df.sparkSession.sparkContext.broadcast(_common_shingles(described.where("node is null").select("h", "n")))
    distinct = cut(rows.groupBy("node").agg(F.min(id).alias("low"), *(F.min(c).alias(c) for c in columns), F.min(F.struct(id, "key")).alias("one")))
    listed = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * (1 - similarity)
    bits = max(LEAST_SEGMENT_BITS, int(listed / SEGMENT_SHINGLES).bit_length())
    blocks = cut(_blocks(over_batches(named.select("text"), list_rarest, "segment int, h binary, nodes binary"), bits))
    drop_old_rounds(df.sparkSession)
    loose = cut(connected_components(links_within(blocks, distinct, radius_for(similarity, 64 * lanes), tuple(columns))))
    n = F.count("*")
    room = F.least(F.lit(block_rows), F.greatest(F.lit(max(1, block_rows // LEAST_PART)), F.ceil(n / FIRST_BLOCKS)))
    sizes = cut(loose.groupBy("root").agg(F.ceil(n / room).cast("int").alias("blocks")))
    grouped = cut(loose.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    shown = distinct.join(grouped.select("node"), "node", "left_semi").select(F.col(f"one.{id}").alias("__id"), F.col("one.key").alias("__key"))
    texts = named.join(shown, F.col(id).eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left_semi")
    sets = over_batches(texts, list_sets, "node bigint, wide binary, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = grouped.join(sets, "node").withColumn("other", other).select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node", "wide", "shingles")
    dealt = dealt.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "node")
    return _with_components(rows, distinct, over_batches(dealt, _confirmed(similarity), "u bigint, v bigint"), "node").select(id, "key", "node", "component", "root")


def _confirmed(similarity: float):
    """Links among the nodes of each (root, a, b), which follow each other, by their sets of shingles."""
    radius = radius_for(similarity, 64 * WIDE_LANES)

    def confirm(group: dict[int, tuple[bytes, bytes]]) -> tuple[list[int], list[int]]:
        nodes, u, v = list(group), [], []
        wide = np.array([np.frombuffer(w, np.uint64) for w, _ in group.values()]).reshape(len(nodes), WIDE_LANES)
        sets = [np.frombuffer(s, np.uint64) for _, s in group.values()]
        of = np.arange(len(nodes))

        def try_links(i: np.ndarray, j: np.ndarray, away: np.ndarray) -> None:
            """Nearest first, unless links found so far join the two already."""
            order = np.argsort(away, kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if of[x] != of[y] and jaccard(sets[x], sets[y]) >= similarity:
                    low, high = sorted((of[x], of[y]))
                    of[of == high] = low
                    u.append(nodes[x])
                    v.append(nodes[y])

        # each one's nearest come first, so that copies of one text meet through it
        nearest = []
        for k in range(len(nodes)):
            away = np.bitwise_count(wide ^ wide[k]).sum(axis=1, dtype=np.int32)
            away[k] = radius + 1
            at = np.argpartition(away, NEAREST)[:NEAREST] if len(away) > NEAREST else np.arange(len(away))
            at = at[away[at] <= radius]
            nearest.append(np.column_stack([away[at], np.full(len(at), k), at]))
        first = np.concatenate(nearest)
        try_links(first[:, 1], first[:, 2], first[:, 0])
        for k in range(len(nodes) - 1):
            apart = k + 1 + np.nonzero(of[k + 1 :] != of[k])[0]
            if len(apart):
                away = np.bitwise_count(wide[apart] ^ wide[k]).sum(axis=1, dtype=np.int32)
                at = apart[away <= radius]
                try_links(np.full(len(at), k), at, away[away <= radius])
        return u, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in confirm(group)], names=["u", "v"])

        for b in batches:
            for root, x, y, node, wide, shingles in zip(*(c.to_pylist() for c in b.columns)):
                if (root, x, y) != now:
                    if len(group) > 1:
                        yield out()
                    now, group = (root, x, y), {}
                group[node] = wide, shingles
        if len(group) > 1:
            yield out()

    return run


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def keep_first(df: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, whole, but of each component of similar texts only one: that with the smallest id, then the smallest hash of its text.

    Rows to drop are named by id and hash, and leave by an anti-join, so that
    the texts move at most once.  Only where a row that stays is repeated are
    equal rows brought together.
    """
    found = similar(df, id, text, **options)
    first = F.col(id).eqNullSafe(F.col("component"))
    best = cut(found.where(first).groupBy("root").agg(F.min("key").alias("best")))
    marked = found.join(best, "root").withColumn("stays", first & (F.col("key") == F.col("best")))
    hashed, gone_id, gone_key = unused(df, "__key", "__id", "__gone")
    gone = marked.where("not stays").select(F.col(id).alias(gone_id), F.col("key").alias(gone_key)).distinct()
    named = df.withColumn(hashed, F.xxhash64(F.col(text)))
    kept = named.join(gone, F.col(id).eqNullSafe(F.col(gone_id)) & (F.col(hashed) == F.col(gone_key)), "left_anti")
    if marked.where("stays").groupBy("root").count().where("count > 1").isEmpty():
        return kept.drop(hashed)
    return kept.dropDuplicates([id, hashed]).drop(hashed)
