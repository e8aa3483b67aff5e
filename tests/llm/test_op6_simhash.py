import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexfold.llm.graph import local_roots
from lexfold.llm.queries import op6_simhash_neardup
from lexfold.llm.simhash_tiles import fingerprint, keep_first, links, links_within, near_duplicates, radius_for, rarest, similar, spanning, wide_fingerprint


def slow_fingerprint(text, k=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius=3):
    """rows: (id, fp); the smallest id reachable of each row."""
    of = list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                of[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return [low.get(root(k)) for k in range(len(rows))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "É", "foo", "\xa0", "zz\x85"]), max_size=12), st.sampled_from([" ", "\n\t ", "\x0b"]))
def test_fingerprint_of_any_text(words, gap):
    assert fingerprint(gap.join(words).encode()) == slow_fingerprint(gap.join(words))


def test_fingerprint_of_long_texts(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(5000))
    assert fingerprint(text.encode()) == slow_fingerprint(text)
    monkeypatch.setattr("lexfold.llm.simhash_tiles.PIECE", 1300)
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_messy_rows(messy):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in messy.collect()]
    want = sorted(((i, f, c) for (i, f), c in zip(rows, slow_components(rows))), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component) for r in near_duplicates(messy).collect()), key=str)
    assert got == want


def test_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_whole_table(spark, sf):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(rows, slow_components(rows)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in op6_simhash_neardup(spark, sf).collect()) == want


def test_tiles_lose_no_link(spark):
    """Chains of one to three flipped bits, over many small tiles."""
    rng = np.random.default_rng(3)
    fps = [int(rng.integers(0, 1 << 63)) for _ in range(60)]
    for f in fps[:25]:
        for _ in range(12):
            for b in rng.choice(63, rng.integers(1, 5), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for tile_rows in (3, 4096):
        of = {f: f for f in fps}

        def root(x):
            while of[x] != x:
                x = of[x]
            return x

        for r in links(df, tile_rows=tile_rows).collect():
            assert bin(r.u ^ r.v).count("1") > 0
            a, b = root(r.u), root(r.v)
            of[max(a, b)] = min(a, b)
        assert [root(f) for f in fps] == slow_components([(f, f) for f in fps])


def slow_set(text, k=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def slow_similar(rows, least=0.8, k=5):
    """rows: (id, text); the position of the first row of each row's component."""
    sets = [slow_set(t, k) for _, t in rows]
    of = list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= least * len(sets[i] | sets[j]):
                of[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(rows))]


def stay(rows, of):
    low = {}
    for (i, _), c in zip(rows, of):
        low.setdefault(c, []).append(i)
    return sorted((min((i for i in ids if i is not None), default=None) for ids in low.values()), key=str)


def test_one_row_of_each_component_stays(messy, empty, spark):
    kept = keep_first(messy)
    assert kept.schema == messy.schema
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == stay(rows, slow_similar(rows))
    assert keep_first(empty).collect() == []
    alike = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, None), (None, ""), (6, "A b c d")], "doc_id bigint, text string")
    assert sorted(((r.doc_id, (r.text or "")) for r in keep_first(alike).collect()), key=str) == [(5, "a b c d"), (None, "")]


@pytest.mark.parametrize("block_rows", [4096, 512, 40])
def test_a_large_group_around_one_text(spark, block_rows):
    """Copies that resemble the original enough, but not each other."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(1000, " ".join(base))]
    for k in range(250):
        words = list(base)
        for i in rng.choice(300, 5 if k % 5 else 9, replace=False):
            words[i] = f"x{rng.integers(0, 10**9)}"
        rows.append((k, " ".join(words)))
    want = {i: rows[c][0] for (i, _), c in zip(rows, slow_similar(rows))}
    lowest = {}
    for i, c in want.items():
        lowest[c] = min(lowest.get(c, i), i)
    found = {r.doc_id: r.component for r in similar(spark.createDataFrame(rows, "doc_id bigint, text string"), block_rows=block_rows).collect()}
    wrong = [i for i in want if found[i] != lowest[want[i]]]
    assert len(set(want.values())) < 120 and len(wrong) <= 2, len(wrong)


def test_similar_texts_around_the_threshold(spark):
    """Groups of copies with some words replaced, of every similarity; links are found where brute force finds them, and nowhere else."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(30, 400))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.integers(1, 5)):
            words = list(base)
            for k in rng.integers(0, len(words), int(len(words) * rng.choice([0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1]))):
                words[k] = f"x{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(words)))
    of = slow_similar(rows)
    found = {r.doc_id: r.component for r in similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {i: rows[c][0] for (i, _), c in zip(rows, of)}
    merged = sum(c != i for i, c in want.items())
    assert merged > 60
    wrong = [i for i in want if found[i] != want[i]]
    assert len(wrong) <= 0.01 * merged, wrong
    # what is linked is linked rightly
    assert all(want[i] == want[found[i]] for i in want)


def test_wide_fingerprints_estimate_similarity():
    rng = np.random.default_rng(1)
    away = []
    for _ in range(60):
        both, a, b = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        x, y = (np.array(wide_fingerprint(np.unique(np.concatenate([both, z])), 2), np.int64) for z in (a, b))
        away.append(int(np.bitwise_count((x ^ y).view(np.uint64)).sum()))
    assert max(away) <= radius_for(0.8, 128) and 17 < np.mean(away) < 22


def test_recall_by_number_of_shingles(spark):
    """Pairs at or just above the threshold, for sets of 1 to 40 shingles: every one is found."""
    rng = np.random.default_rng(21)
    rows = []
    for n in range(1, 41):
        for _ in range(20):
            words = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
            rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join(words + [f"x{x}" for x in range(int(n / 0.8 + 1e-9) - n)])))  # n shingles of at most n / 0.8
    want = slow_similar(rows)
    got = {r.doc_id: r.component for r in similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    linked = sum(c != k for k, c in enumerate(want))
    assert linked == 40 * 20 and got == {i: rows[c][0] for (i, _), c in zip(rows, want)}


def test_no_similar_pair_of_short_texts_is_lost(spark):
    """Texts of 5 to 20 words, and each with a word more, or one less at an end, as often as the similarity allows."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(600):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 8 if k % 2 else rng.integers(5, 21))]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words + ["more"] if k % 4 < 3 else words[1:])))
    want = slow_similar(rows)
    assert len(set(want)) < 0.8 * len(rows)
    got = {r.doc_id: r.component for r in similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: rows[c][0] for (i, _), c in zip(rows, want)}
    assert radius_for(0.8, 1024) >= 192 + 3 * 12.5  # 4 of 5 shingles: 0.1875 a bit


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


def test_texts_with_a_common_passage_are_not_compared(spark):
    """Texts half of which is one passage resemble each other loosely, all of them; what moves stays in proportion to them."""
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{x}" for x in range(300))
    rows = [(k, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 300))) for k in range(1500)]
    rows += [(10_000 + k, rows[k][1] + " more") for k in range(0, 1500, 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = shuffled(spark)
    found = {r.doc_id: r.component for r in similar(df).collect()}
    moved = sum(n for k, n in shuffled(spark).items() if k not in before)
    assert found == {i: i % 10_000 for i, _ in rows}
    assert moved < 2 * sum(len(t) for _, t in rows), moved


@pytest.mark.parametrize("pairs", [1, 50, 1 << 18])
def test_spanning_links_keep_components(pairs, monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr("lexfold.llm.simhash_tiles.PAIRS", pairs)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    for f in fps[:12]:
        for _ in range(9):
            for b in rng.choice(63, rng.integers(1, 5), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = sorted(set(fps))
    u, v = spanning(np.array(fps, np.uint64)[:, None], 3)
    of = local_roots(len(fps), u, v)
    assert [fps[k] for k in of] == slow_components([(f, f) for f in fps])


@pytest.mark.parametrize("tile_rows", [2, 3, 100])
def test_blocks_of_any_size_lose_no_link(spark, tile_rows):
    fps = [sum(1 << b for b in range(k)) for k in range(0, 21, 2)] + [1 << 40, 1 << 41, 63 << 50]
    nodes = spark.createDataFrame(list(enumerate(fps)), "node bigint, fp bigint")
    blocks = spark.createDataFrame([(1, np.arange(11).tobytes()), (2, np.array([11, 12]).tobytes()), (3, np.array([10, 13]).tobytes())], "key bigint, nodes binary")
    got = [(r.u, r.v) for r in links_within(blocks, nodes, 2, ("fp",), tile_rows).collect()]
    u, v = (np.array(x) for x in zip(*got))
    assert local_roots(14, u, v).tolist() == [0] * 11 + [11, 11, 13]


def test_similar_sets_share_one_of_their_rarest():
    rng = np.random.default_rng(6)
    common = np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    level = rng.integers(0, 9, 500)
    for _ in range(300):
        both = int(rng.integers(1, 60))
        own = rng.multinomial(int(both / 0.8 + 1e-9) - both, [0.5, 0.5])
        pool = rng.permutation(np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 500, dtype=np.uint64)])))
        x = np.sort(pool[: both + own[0]])
        y = np.sort(np.concatenate([pool[:both], pool[both + own[0] : both + own.sum()]]))
        assert set(rarest(x, 0.8, common, level)) & set(rarest(y, 0.8, common, level))
