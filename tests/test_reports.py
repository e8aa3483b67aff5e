from pyspark.sql import functions as F

from lexfold.operators import reports as rp
from lexfold.operators.detect import analyze

TEXTS = [
    (1, "We collect your name. Passport scans are kept for 90 days. " + "We sell your personal data " + "to everyone " * 12 + "."),
    (2, "Nothing here."),
    (3, None),
    (4, "We keep logs for 90 days.\nWe like to share. Advertisers sell ads. The period was long."),
]


def analyzed(spark):
    return analyze(spark.createDataFrame(TEXTS, "doc_id bigint, text string"))


def test_counts_and_samples(spark):
    rows = {(r.doc_id, r.category): (r.matches, r.sample) for r in rp.counts(analyzed(spark)).collect()}
    assert len(rows) == 24 and rows[2, "retention"] == (0, None) and rows[3, "data_sale"] == (0, None)
    assert rows[1, "data_collection"] == (2, "Passport scans are kept for 90 days.")
    n, sample = rows[1, "data_sale"]
    assert n == 1 and len(sample) == 90 and sample.endswith("…")


def test_pivot_and_totals(spark):
    assert [r.retention for r in rp.pivot(analyzed(spark)).orderBy("doc_id").collect()] == [1, 0, 0, 1]
    totals = {r.category: (r.matches, r.documents_found, r.documents) for r in rp.totals(analyzed(spark)).collect()}
    assert totals["retention"] == (2, 2, 4) and totals["arbitration"] == (0, 0, 4) and totals[None][2] == 4


def test_cards_never_fall_below_the_base_severity(spark):
    cards = {(r.doc_id, r.category): r for r in rp.cards(analyzed(spark)).collect()}
    assert cards[4, "retention"].card_severity == "Caution" and cards[4, "retention"].match_count_text == "1 matched sentence(s)"
    assert cards[1, "data_collection"].card_severity == "Warning" and cards[2, "data_collection"].card_severity is None
    assert cards[2, "data_sale"].found_label == "Not found" and cards[1, "data_sale"].found_label == "Found"


def test_quotes_carry_a_badge_only_of_their_own(spark):
    q = rp.quotes(analyzed(spark)).where("doc_id = 1").orderBy("ord", "nth").collect()
    assert [(r.category, r.nth, r.badge) for r in q] == [("data_collection", 0, "Warning"), ("data_collection", 1, "Info"), ("data_sale", 0, None), ("retention", 0, "Info")]


def test_misses(spark):
    got = sorted((r.doc_id, r.family, r.sentence) for r in rp.misses(analyzed(spark)).collect())
    assert got == [(4, "advertising", "Advertisers sell ads."), (4, "retention", "The period was long."), (4, "sale", "Advertisers sell ads."), (4, "sharing", "We like to share.")]
    assert [r.misses for r in rp.miss_counts(analyzed(spark)).orderBy("doc_id").collect()] == [0, 0, 0, 4]


def test_found_rate(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (9, 1)], "doc_id bigint, toxic int")
    rate = {(r.toxic, r.category): (r.documents, r.documents_found) for r in rp.found_rate(analyzed(spark), labels, "toxic").collect()}
    assert rate[1, "retention"] == (2, 2) and rate[0, "retention"] == (1, 0) and rate[1, "data_sale"] == (2, 1)


def test_empty(spark):
    none = analyzed(spark).limit(0)
    for report in (rp.counts, rp.pivot, rp.misses, rp.miss_counts, rp.cards, rp.quotes):
        assert report(none).collect() == []
    assert F is not None and rp.totals(none).count() <= 1
