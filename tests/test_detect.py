"""Every detector: hits, near misses, denials, severities; and the registry's results."""

import re

import pytest
from pyspark.sql import functions as F

from lexfold.functions import vocabulary as v
from lexfold.operators.detect import RULES, Rule, analyze, any_pattern, flat_matches, results
from lexfold.sources.policy_corpus import CLAUSES, policy_documents

C, S, T, R, A, W = (c for c, _, _ in v.CATEGORIES)

#: Text, and the (category, severity) pairs found in it; a null severity is the rule's own.
CASES = [
    ("Enter your social security number.", {(C, "warning")}),
    ("SSN required", {(C, "warning")}),
    ("ssn required", set()),
    ("A driver's license", {(C, "warning")}),
    ("A driver’s license", set()),
    ("Biometric information", {(C, "warning")}),
    ("We collect your email and browsing habits.", {(C, "info")}),
    ("We collect biometric data and your name", {(C, "warning")}),
    ("We do not collect biometric data.", set()),
    ("We don’t really ever track keystrokes.", set()),
    ("We cannot collect your passport", {(C, "warning")}),
    ("The name of the rose", set()),
    ("Identifiers such as cookies", {(C, "info")}),
    ("Wi-Fi signals give us your location", {(C, "warning")}),
    ("We sell your personal data.", {(S, None)}),
    ("We do not sell your personal data.", set()),
    ("We have not sold your personal information.", {(S, None)}),
    ("You have the right to stop us from selling your data.", set()),
    ("We may have sold the following categories of records.", {(S, None)}),
    ("We do not \"sell\" your personal data", set()),
    ("It may be considered a \"sale\" under the CCPA", {(S, None)}),
    ("We do not sell your data in exchange for any consideration.", set()),
    ("We do not sell your data; however, we allow partners to collect user data in exchange for a fee.", {(S, None)}),
    ("We do not transfer data in exchange for money, but we may provide your information to sponsors.", {(S, None)}),
    ("We do not transfer data in exchange for money, but we never provide your information to sponsors.", set()),
    ("Vendors give non-monetary consideration", {(S, None)}),
    ("We may sell or transfer part of our business with customer data.", {(T, None)}),
    ("We share data with service providers.", {(T, None)}),
    ("We do not share your personal data with third parties.", set()),
    ("We do not share your personal data except with your consent.", {(T, None)}),
    ("We never share office space, except on Fridays.", set()),
    ("We do not disclose your name, but we share it with vendors.", {(T, None)}),
    ("We do not disclose your name, but we like vendors.", set()),
    ("Voice data is shared with Initech or Hooli.", {(T, None)}),
    ("Voice data is shared with Your Family.", set()),
    ("voice data is shared with initech.", set()),
    ("Social media platforms.", {(T, None)}),
    ("Social media platforms and more", set()),
    ("We may share records with:\n- couriers\n- our vendors", {(T, None)}),
    ("We share records with vendors:\n- couriers", {(T, None)}),
    ("Data is processed outside the country.", {(T, None)}),
    ("We disclose logs as required by applicable law.", {(T, None)}),
    ("We retain data for as long as necessary.", {(R, "caution")}),
    ("We keep logs for 90 days.", {(R, "info")}),
    ("We keep logs for twelve (12) months or indefinitely.", {(R, "caution")}),
    ("In the past 12 months nothing happened.", set()),
    ("Deleted after one year", {(R, "info")}),
    ("All disputes go to binding arbitration.", {(A, None)}),
    ("You waive the right to be heard by a jury.", {(A, None)}),
    ("The arbitrator lives here.", set()),
    ("No class actions.", {(W, None)}),
    ("Disputes proceed on an individual basis.", {(W, None)}),
    ("Every request is looked at on an individual basis.", set()),
    ("résell your personal data", set() | {(S, None)}),
    ("Do Not Sell My Personal Information", set()),
]


def found(spark, texts, **k):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {i: set() for i in range(len(texts))}
    for r in flat_matches(analyze(df, **k)).collect():
        out[r.doc_id].add((r.category, r.severity))
    return [out[i] for i in range(len(texts))]


def test_cases(spark):
    for (text, want), got in zip(CASES, found(spark, [t for t, _ in CASES])):
        assert got == want, text


def test_every_pattern_has_a_clause_that_it_matches():
    """The corpus that the registered queries run on exercises the whole vocabulary."""
    groups = [v.SENSITIVE, v.COLLECTION_DENIED, v.ORDINARY, v.SALE_RIGHTS, v.SALE_STRONG, v.SALE_POSITIVE, v.SALE_DENIED, v.SHARING_POSITIVE, v.SHARING_DENIED, v.SHARING_DENIED_DATA, v.RETENTION_VAGUE, v.RETENTION_SPECIFIC, v.ARBITRATION, v.CLASS_WAIVER,
              (v.SALE_STRONG_DENIED, v.SALE_CONTRAST, v.SALE_QUALIFIED_DENIAL, v.SALE_DISCLOSURE, v.SALE_TAIL_DENIED, v.SHARING_EXCEPTION, v.SHARING_CONTRAST, v.RETENTION_CONTEXT)]
    lines = [re.sub(r'["“‘\']([A-Za-z-]+)["”’\']', r"\1", re.sub(r"^\s*(?:[•*-]|\(?\d[.)])\s+", "", x)) for c in CLAUSES for x in c.split("\n")]
    for p in (p for g in groups for p in g):
        assert any(re.search(p.replace(r"\z", r"\Z"), x, re.I | re.A) for x in lines), p


def test_counts_of_patterns():
    assert len(v.SENSITIVE) + len(v.SENSITIVE_CASED) + len(v.COLLECTION_DENIED) + len(v.ORDINARY) == 32
    assert len(v.SALE_RIGHTS) + len(v.SALE_STRONG) + len(v.SALE_POSITIVE) + len(v.SALE_DENIED) + 5 == 30
    assert len(v.SHARING_POSITIVE) + 1 + len(v.SHARING_DENIED) + 3 == 22
    assert 1 + len(v.RETENTION_VAGUE) + len(v.RETENTION_SPECIFIC) == 18 and len(v.ARBITRATION) == 6 and len(v.CLASS_WAIVER) == 8


def test_stems_lose_nothing(spark, sf):
    docs = policy_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    every = spark.createDataFrame([(-1 - k, c) for k, c in enumerate([*CLAUSES, *(t for t, _ in CASES)])], "doc_id bigint, text string")
    docs = docs.union(every)
    with_stems, without = (sorted(map(tuple, flat_matches(analyze(docs, prefilter=p)).collect()), key=str) for p in (True, False))
    assert with_stems == without and len(with_stems) > 500


def test_accents_and_long_gaps(spark):
    pad = lambda n: "x" * (n - 2)
    near = [f"sell {pad(80)} your data", f"sell {pad(81)} your data", f"sell {'😀' * 39} your data", f"sell {'😀' * 40} your data", "éresale of your data", "We sell\xa0your\u2003personal data"]
    assert found(spark, near) == [{(S, None)}, set(), {(S, None)}, set(), set(), {(S, None)}]


def test_results_have_a_row_for_each_category(spark):
    df = spark.createDataFrame([(1, "We collect your name. Passport scans. We collect email."), (2, None)], "doc_id bigint, text string")
    rows = results(analyze(df)).orderBy("doc_id", "ord").collect()
    assert [r.category for r in rows] == [c for c, _, _ in v.CATEGORIES] * 2
    assert [r.found for r in rows] == [True] + [False] * 11
    assert [(m.sentence, m.severity) for m in rows[0].matches] == [("Passport scans.", "warning"), ("We collect your name.", "info"), ("We collect email.", "info")]


def test_a_rule_is_one_entry(spark):
    more = (*RULES, Rule("shouting", "data_sale", "x", "info", any_pattern((r"\bLOUD\b",), veto=(r"\bnot\b",)), ("loud",)))
    df = spark.createDataFrame([(1, "We sell your personal data. Loud. It is not loud")], "doc_id bigint, text string")
    sale = results(analyze(df, rules=more), rules=more).where("category = 'data_sale'").first()
    assert [m.detector_id for m in sale.matches] == ["data_sale", "shouting"] and sale.base_severity == "warning"
    assert results(analyze(df, rules=more), rules=more).count() == 6


def test_extra_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "We sell your personal data.", "x", "y", 3)], "doc_id bigint, text string, sentence string, matches string, index int")
    assert flat_matches(analyze(df)).columns == ["doc_id", "category", "detector_id", "ord", "sentence", "index", "severity"]


def test_nothing_is_shuffled(spark, sf):
    plan = flat_matches(analyze(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("category", [c for c, _, _ in v.CATEGORIES])
def test_each_category_is_found_in_the_policy_corpus(spark, sf, category):
    docs = policy_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    assert flat_matches(analyze(docs, rules=tuple(r for r in RULES if r.category == category))).where(F.col("category") == category).count() > 10
