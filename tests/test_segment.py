"""The segmenter against a plain reading of its rules."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexfold.functions import text as tx
from lexfold.operators.segment import segment
from tests.plain import sentences, units

PIECES = ["We ", "share", "data", " with", ":", "\n", "\n", "- ", "1. ", "(2) ", "• ", "(a) ", "U.S.", "e.g.", " Inc.", "3.14", "?", "!", "...", '"', "”", ")", " a", "A", "é", "😀", "\xa0", "\t", "\r", "'", " no.", " X.", "\ufeff", "Dr. ", "etc. and", "b.c.d.", "\u2028", "　"]


def got(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {k: [] for k in range(len(texts))}
    for r in segment(df).collect():
        out[r.doc_id].append((r["sentence"], r["index"], r["lead_in"]))
    return [out[k] for k in range(len(texts))]


def check(spark, texts):
    for t, g in zip(texts, got(spark, texts)):
        assert g == sentences(t), t
        for s, i, _ in g:
            assert (t or "").encode("utf-16-le")[2 * i :].startswith(s.encode("utf-16-le"))


CASES = [
    (None, []),
    ("", []),
    (" \n\t\xa0", []),
    ("One. Two!  Three", [("One.", 0, None), ("Two!", 5, None), ("Three", 11, None)]),
    ("It cost 2.50 today. Ok", [("It cost 2.50 today.", 0, None), ("Ok", 20, None)]),
    ("By Acme Inc. Founded then.", [("By Acme Inc. Founded then.", 0, None)]),
    ("Section A. Next", [("Section A. Next", 0, None)]),
    ("Stop. but go", [("Stop. but go", 0, None)]),
    ("Really?! \"Yes.\" (Yep.) x", [("Really?!", 0, None), ("\"Yes.\"", 9, None), ("(Yep.)", 16, None), ("x", 23, None)]),
    ("With:\n- one\n\n2) two. Three\nend", [("With:", 0, None), ("one", 8, "With:"), ("two.", 16, "With:"), ("Three", 21, "With:"), ("end", 27, None)]),
    ("- a list:\n- item", [("a list:", 2, None), ("item", 12, "a list:")]),
    ("(a) kept", [("(a) kept", 0, None)]),
    ("😀 One. Two", [("😀 One.", 0, None), ("Two", 8, None)]),
]


def test_cases(spark):
    assert got(spark, [t for t, _ in CASES]) == [w for _, w in CASES]
    check(spark, [t for t, _ in CASES])


def test_random_texts(spark):
    rng = random.Random(1)
    check(spark, ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 30))) for _ in range(2500)])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=30))
def test_any_texts(spark, texts):
    check(spark, texts)


def test_whole_table(spark, sf):
    check(spark, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_long_texts_with_many_lines(spark):
    check(spark, ["A line. And more:\n" * 3000, "word. " * 5000, "x" * 100_000, "- item\n" * 2000, "a:\n" + "- item\n" * 2000])


def test_nothing_is_shuffled(spark, sf):
    plan = segment(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("FileScan") == 1


def test_marks_inside_a_text(spark):
    check(spark, ["aa\x01bb. C\x02d\x02", "\x01\x02\x01 A b. C\x01\x02\x02\x01\n\x02- x\x02", "\x02" * 9 + ". \x01.\x01\x02\x01\x02\x01. B"])
    assert [s for s, _, _ in got(spark, ["aa\x01bb. C\x02d\x02"])[0]] == ["aa\x01bb.", "C\x02d\x02"]


def test_long_runs_of_points(spark):
    assert [s for s, _, _ in got(spark, ["Annex A" + "." * 80 + " 12"])[0]] == ["Annex A" + "." * 80 + " 12"]
    check(spark, [f"{w}{'.' * n}{t}" for w in ("Annex A", "word", "e.g", "U.S", "3", "x 3", "no", "", "A.B", "?") for n in (1, 2, 3, 64, 65, 66, 200) for t in (" 12", "5", " Next. One", "next", "")])
    long = "." * 100_000
    assert got(spark, [f"See no{long} Next. End{long}x"])[0] == [(f"See no{long} Next.", 0, None), (f"End{long}", 100_013, None), ("x", 200_016, None)]


def test_markers_only_at_the_beginning_of_a_line(spark):
    check(spark, ["Foo. - ", "Foo: - \n - ", "A:\n- ", "A:\n- - x", "1. 2. Three", "A.\n 1.\n2. \n x", "Foo! \t- bar. - "])


def test_text_primitives(spark):
    df = spark.createDataFrame([("a😀b\xa0c",), ("",), ("  x \ufeff",)], "t string")
    rows = df.select(tx.units("t"), tx.trim_blank(tx.F.col("t")), tx.collapse_blank(tx.F.col("t")), tx.match_copy(tx.F.col("t")), tx.clip(tx.F.col("t"), 3)).collect()
    assert [tuple(r) for r in rows] == [(6, "a😀b\xa0c", "a😀b c", "a~~b c", "a\ufffd…"), (0, "", "", "", ""), (5, "x", "x", "  x  ", "  …")]
    assert units("a😀b") == 4


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aé😀𝒳 "), max_size=12), min_size=1, max_size=20), st.integers(2, 9))
def test_clip_counts_units(spark, texts, most):
    cut = lambda s: s if units(s) <= most else s.encode("utf-16-le")[: 2 * most - 2].decode("utf-16-le", "replace").replace("\ufffd\ufffd", "\ufffd") + "…"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.clip(tx.F.col("t"), most)).collect()] == [cut(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 300])
def test_scan_is_a_running_fold(spark, n):
    df = spark.createDataFrame([(list(range(n)),)], "a array<int>")
    out = df.select(tx.scan(tx.F.col("a"), tx.F.lit(0), lambda s, x: s + x, lambda s, x: s, "int").alias("o")).first().o
    assert out == [sum(range(k)) for k in range(n)]
