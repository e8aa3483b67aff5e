import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexfold.llm import ngram_bloom as nb
from lexfold.llm.queries import op2_lm_score


def slow_tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [""]


def slow_base(rows, training):
    c = Counter(t for text in training for t in slow_tokens(text))
    n, v = sum(c.values()), len(c)
    return n, [(i, len(slow_tokens(t)), sum(c[x] > 0 for x in slow_tokens(t)), math.fsum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in slow_tokens(t))) for i, t in rows]


def same(got, want):
    key = lambda r: tuple(map(str, r[:3]))
    assert sorted(map(key, got)) == sorted(map(key, want))
    order = lambda r: (*key(r), r[3])
    assert np.allclose([r[3] for r in sorted(got, key=order)], [r[3] for r in sorted(want, key=order)], rtol=1e-9)


@pytest.mark.parametrize("common", [0, 2, 250_000])
def test_base_score_is_exact(spark, messy, empty, common):
    training = messy.where("coalesce(doc_id, 0) % 2 = 0")
    model = nb.train(training, common_words=common)
    n, want = slow_base([(r.doc_id, r.text) for r in messy.collect()], [r.text for r in training.collect()])
    got = nb.score(messy, model).collect()
    assert model.n == n
    same([(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got], want)
    assert all(r.score < 0 for r in got)
    assert nb.score(empty, model).collect() == []


def test_nothing_to_learn_from(messy, empty):
    model = nb.train(empty)
    assert (model.n, model.distinct) == (0, 0)
    assert all(r.n_known == 0 and r.score == pytest.approx(r.base_score) for r in nb.score(messy, model).collect())


@pytest.mark.parametrize("order", [2, 3])
def test_score_without_false_positives(spark, order):
    """With a roomy filter the score is that of exact n-gram counts, quantised."""
    texts = ["a b a b c", "b c a", "a b a", "c c c c c c", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = nb.train(df, order=order, entry_bits=400, dirichlet=3.0)
    counts = Counter()
    for t in texts:
        w = ["<s>"] * (order - 1) + slow_tokens(t)
        for n in range(1, order + 1):
            counts.update(tuple(w[i - n + 1 : i + 1]) for i in range(order - 1, len(w)))

    def quantised(c):
        return 0 if not c else (1.5 * 2 ** (math.floor(math.log2(c)) + 1) - 1) / 2

    def count(w, i, n):
        """The model's count of the n-gram that ends at i; never more than its beginning has."""
        if i < order - 1:
            return len(texts)
        c = quantised(counts[tuple(w[i - n + 1 : i + 1])])
        return c if n == 1 else min(c, count(w, i - 1, n - 1))

    def slow(t):
        w, total = ["<s>"] * (order - 1) + slow_tokens(t), 0
        for i in range(order - 1, len(w)):
            p = (count(w, i, 1) + 0.5) / model.scale
            for n in range(2, order + 1):
                p = (count(w, i, n) + 3.0 * p) / (count(w, i - 1, n - 1) + 3.0)
            total += math.log10(p)
        return total

    for r in nb.score(df, model).collect():
        assert r.score == pytest.approx(slow(texts[r.doc_id]), rel=1e-9)


def test_filter_never_forgets_and_rarely_invents():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 64, 40_000, dtype=np.uint64))
    counts = rng.zipf(1.5, len(h)).clip(1, 10**6)
    segment = nb.build_segment(h, counts)
    held = nb.Filter(segment, np.array([0]), np.array([8 * len(segment)]))
    levels = held.levels(h)
    assert (levels >= nb.levels_of(counts)).all() and (levels > nb.levels_of(counts)).mean() < 0.04
    strange = held.levels(rng.integers(0, 1 << 64, 40_000, dtype=np.uint64))
    assert (strange > 0).mean() < 0.04
    half = nb.fold(segment)
    folded = nb.Filter(half, np.array([0]), np.array([8 * len(half)]))
    assert (folded.levels(h) >= nb.levels_of(counts)).all()


def test_filter_is_folded_to_its_limit(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole, small = nb.train(docs), nb.train(docs, filter_bytes=20_000)
    assert len(small.filter.bits) <= 20_000 < len(whole.filter.bits) and len(whole.filter.sizes) == len(small.filter.sizes)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    n, want = slow_base(rows, [t for i, t in rows if not held(i)])
    got = op2_lm_score(spark, sf).collect()
    same([(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got], want)
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) for r in got)
    fresh = [r for r in got if r.held_out]
    print("log10 per token, held out:", sum(r.score for r in fresh) / sum(r.n_tokens for r in fresh), sum(r.base_score for r in fresh) / sum(r.n_tokens for r in fresh))
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_large_filter_keeps_its_bits_and_scores_from_segments(spark, messy, sf, monkeypatch):
    """A filter beyond the limit of the broadcast is not folded; the scores are those of the same filter broadcast."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(messy.select("doc_id", "text"))
    training = docs.where("coalesce(doc_id, 0) % 3 > 0")
    whole = nb.train(training)
    want = sorted(map(tuple, nb.score(docs, whole).collect()), key=str)
    monkeypatch.setattr(nb, "FILTER_BYTES", 20_000)
    monkeypatch.setattr(nb.train, "__defaults__", tuple(20_000 if x == 128 << 20 else x for x in nb.train.__defaults__))
    large = nb.train(training)
    held = sum(len(r.bits) for r in large.segments.collect()) if hasattr(large, "segments") else len(large.filter.bits)
    assert held > 20_000 and abs(held - len(whole.filter.bits)) <= len(whole.filter.sizes)
    got = sorted(map(tuple, nb.score(docs, large).collect()), key=str)
    order = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], round(r[4], 6)))
    assert [r[:3] for r in order(got)] == [r[:3] for r in order(want)]
    assert np.allclose([r[3:] for r in order(got)], [r[3:] for r in order(want)], rtol=1e-9)


def test_a_filter_many_times_the_limit(spark, sf):
    """Unseen n-grams stay unseen, and scores stay those of a broadcast filter, where the filter is 64 times what may be broadcast."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = nb.train(docs)
    large = nb.train(docs, broadcast_bytes=len(whole.filter.bits) // 64)
    assert large.filter is None
    parts = {r.segment: np.frombuffer(r.bits, np.uint8) for r in large.segments.collect()}
    laid = [parts.get(s, np.zeros(1, np.uint8)) for s in range(1 << large.segment_bits)]
    sizes = np.array([8 * len(x) for x in laid])
    held = nb.Filter(np.concatenate(laid), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    strange = held.levels(np.random.default_rng(3).integers(0, 1 << 64, 100_000, dtype=np.uint64))
    assert (strange == 0).mean() >= 0.95
    far = {r.doc_id: r.score for r in nb.score(docs, large).collect()}
    assert all(far[r.doc_id] == pytest.approx(r.score, rel=1e-9) for r in nb.score(docs, whole).collect())


def test_probing_ends_where_all_bits_are_set():
    assert nb.Filter(np.full(128, 255, np.uint8), np.array([0]), np.array([1024])).levels(np.arange(9, dtype=np.uint64)).tolist() == [nb.MOST_LEVELS] * 9


def test_long_words_may_be_common(spark):
    long = "u" * 500
    model = nb.train(spark.createDataFrame([(k, f"{long} w{k}") for k in range(50)], "doc_id bigint, text string"), common_words=5)
    assert long.encode() in model.common.listed()


def test_counts_are_at_most_what_was_learned():
    """Levels that a filter invents never make a word commoner than all tokens."""
    begin = np.array([0])
    assert nb.text_scores([np.array([1e6])], begin, 10, 12.0, 1, 200.0)[0] == pytest.approx(math.log10(10.5 / 12))


def test_an_ngram_is_hashed_once_for_a_level(monkeypatch):
    """Not once for each hash function; what is found stays the same."""
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    segment = nb.build_segment(h, rng.zipf(1.5, len(h)).clip(1, 10**6))
    hashed, mix64, size = [], nb.mix64, 8 * len(segment)
    monkeypatch.setattr(nb, "mix64", lambda x: (hashed.append(len(x)), mix64(x))[1])
    levels = nb.Filter(segment, np.array([0]), np.array([size])).levels(h)
    assert sum(hashed) == sum(min(int(x) + 1, nb.MOST_LEVELS) for x in levels)
    bits = np.unpackbits(segment, bitorder="little")
    for x, level in zip(h[:300].tolist(), levels[:300].tolist()):
        for at, there in ((level, True), (level + 1, False)):
            y = int(mix64(np.array([(x + at * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
            places = [((y >> 32) + k * (y % (1 << 32) | 1)) % (1 << 32) * size >> 32 for k in range(nb.HASHES)]
            assert all(bits[p] for p in places) == there


@pytest.mark.parametrize(("order", "common"), [(1, 250_000), (2, 0), (2, 3), (3, 250_000)])
def test_scores_from_segments_with_any_common_words(spark, messy, order, common):
    training = messy.where("coalesce(doc_id, 0) % 2 = 0")
    scores = [sorted(((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in nb.score(messy, nb.train(training, order=order, common_words=common, **limit)).collect())) for limit in ({}, {"broadcast_bytes": 1})]
    assert scores[0] == scores[1]
