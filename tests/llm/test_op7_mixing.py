import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexfold.llm import mixing
from lexfold.llm.queries import op7_source_mixing


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def slow_targets(sizes):
    """Exact water-filling: the level at which capped shares use up all words."""
    w = [(1, 2, 3)[i % 3] for i in range(len(sizes))]
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(3 * sizes[i] for i in capped)
        level = Fraction(rest, sum(w[i] for i in free)) if free else 0
        new = {i for i in free if w[i] * level > 3 * sizes[i]}
        if not new:
            return [float(3 * s if i in capped else w[i] * level) for i, s in enumerate(sizes)]
        capped |= new


@pytest.mark.parametrize("sizes", [[], [0], [0, 0, 0], [5], [1, 1, 1], [1, 1000], [1000, 1, 1, 1], [10_000, 0, 3, 70, 9, 2], [1, 3, 9, 27, 81, 243, 729, 2187, 6561], [7, 7, 0, 7, 100, 1, 2, 3, 5000, 12, 4]])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "number bigint, size bigint")
    got = [r.target for r in sorted(mixing.with_targets(df).collect())]
    assert got == pytest.approx(slow_targets(sizes))
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s for t, s in zip(got, sizes))


def dealt(groups, shards, ranges, seed):
    """[group][shard] -> (begin, counts), each range of shards walked by itself."""
    totals = np.array([sum(g) for g in groups])
    return [{shard: (begin, counts) for low, high in zip(ranges, ranges[1:]) for shard, begin, counts in mixing.walk(totals, k, np.array(g), shards, low, high, seed)} for k, g in enumerate(groups)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=6), min_size=1, max_size=4), st.integers(1, 9), st.integers(1, 4), st.integers(0, 5))
def test_tree_deals_every_block_once(groups, shards, at_once, seed):
    found = dealt(groups, shards, [*range(0, shards, at_once), shards], seed)
    sizes = np.zeros(shards, int)
    for quotas, of in zip(groups, found):
        seen = [[] for _ in quotas]
        assert sorted(of) == list(range(shards))
        for shard, (begin, counts) in of.items():
            sizes[shard] += counts.sum()
            for s in range(len(quotas)):
                seen[s] += range(begin[s], begin[s] + counts[s])
        assert all(sorted(x) == list(range(q)) for x, q in zip(seen, quotas))
    assert max(sizes) - min(sizes) <= max(1, shards.bit_length())
    for a, b in zip(found, dealt(groups, shards, [0, shards], seed)):  # what a task finds does not depend on its range
        assert all((a[k][0] == b[k][0]).all() and (a[k][1] == b[k][1]).all() for k in a)


@pytest.mark.parametrize("groups", [[[30, 10, 60]], [[30, 10], [60]]])
def test_tree_draws_are_hypergeometric(groups):
    """Over seeds, the first of two shards gets its share of each source on average, with the draw's variance."""
    quotas = np.concatenate(groups)
    left = np.array([np.concatenate([of[0][1] for of in dealt(groups, 2, [0, 2], seed)]) for seed in range(3000)])
    assert (left.sum(axis=1) == 50).all()
    assert np.allclose(left.mean(axis=0), quotas / 2, atol=0.15)
    share = quotas / 100
    assert np.allclose(left.var(axis=0), 50 * share * (1 - share) * 50 / 99, rtol=0.1)


def judge(rows, got):
    """rows: (id, text, source); got: digest rows."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, slow_targets([sizes[n] for n in names])))
    want = Counter((i, words(t), sizes[s], round(target[s], 4)) for i, t, s in rows)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 4)) for r in got) == want
    assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in got if r.size) and all(r.taken == 0 for r in got if not r.size)
    return sizes, target


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op7_source_mixing(spark, sf).collect()
    sizes, target = judge(rows, got)
    of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        taken[of[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 30, (s, taken[s], target[s])
    again = op7_source_mixing(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_many_blocks_and_chunks(spark):
    """One source with a third of all rows; targets that need several epochs, chunks and a broken last chunk."""
    rows = [(i, "w " * (1 + i % 5), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixed_digest(df, least_blocks=400, chunk_blocks=32, shard_words=500).collect()
    sizes, target = judge(rows, got)
    taken = Counter()
    for r, (_, _, s) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 5 for s in sizes)
    mixed = mixing.mixed_rows(df, least_blocks=400, chunk_blocks=32, shard_words=500)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.doc_id: r.taken // r.size for r in got if r.taken})
    assert mixed.select("mix_shard").distinct().count() > 10


def test_sources_beyond_one_group(spark):
    """Most sources are joined, not broadcast, and the tree has many groups of sources."""
    rows = [(i, "w " * (1 + i % 5), None if i % 100 == 1 else "big" if i % 3 == 0 else f"s{i % 700}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    options = dict(shard_words=500, group_sources=20, task_shards=3)
    got = mixing.mixed_digest(df, **options).collect()
    sizes, target = judge(rows, got)
    assert len(sizes) > 20 * 20
    of = {i: s for i, _, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        taken[of[r.doc_id]] += r.taken
        largest[of[r.doc_id]] = max(largest[of[r.doc_id]], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    copies = Counter(r.doc_id for r in mixing.mixed_rows(df, **options).collect())
    assert copies == Counter({r.doc_id: r.taken // r.size for r in got if r.taken})
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed_digest(df, **options).collect()))


def test_messy_rows(spark, messy, empty):
    rows = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    judge(rows, mixing.mixed_digest(messy).collect())
    whole = mixing.mixed_rows(messy)
    assert whole.columns == [*messy.columns, "mix_shard", "mix_order"] and whole.count() > 0
    assert mixing.mixed_digest(empty).collect() == [] and mixing.mixed_rows(empty).collect() == []
