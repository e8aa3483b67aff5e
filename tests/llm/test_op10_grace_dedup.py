import hashlib
import random
import re

import pytest

from lexfold.llm.grace_dedup import dedup_members, dedup_rows, grace, normalise
from lexfold.llm.queries import ORACLE_SQL, op10_exact_dedup


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of each (doc_id, text)."""
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((i is None, i or 0, k))
    out = []
    for body, members in groups.items():
        members.sort()
        keep = None if members[0][0] else members[0][1]
        for nth, (none, i, _) in enumerate(members):
            out.append((None if none else i, keep, len(members), nth == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def members(df, **k):
    return sorted((tuple(r) for r in dedup_members(df, **k).collect()), key=str)


@pytest.mark.parametrize("limit", [1, 500, 64 << 20])
def test_members_equal_brute_force(messy, limit):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert members(messy, table_bytes=limit) == brute(rows)


def test_whole_table_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in op10_exact_dedup(spark, sf).collect()), key=str) == brute(rows)
    assert "op10_exact_dedup" in ORACLE_SQL


def test_rows_that_stay(messy):
    want = sorted(str(norm(t)) for t in {norm(r.text) for r in messy.collect()})
    kept = dedup_rows(messy, table_bytes=300)
    assert kept.schema == messy.schema
    assert sorted(norm(r.text) for r in kept.collect()) == want
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 3, 5, 7, 9} <= ids and not {2, 4, 6, 11} & ids


def test_empty(empty):
    assert dedup_members(empty).collect() == [] and dedup_rows(empty).collect() == []


def test_spilling_never_parts_equal_texts():
    rng = random.Random(1)
    texts = [bytes([rng.randrange(97, 100)]) * rng.randrange(1, 40) for _ in range(3000)]
    for limit in (1, 10, 100, 10_000):
        got = list(grace(((hashlib.sha256(t).digest(), t, [k, 1, 1, None]) for k, t in enumerate(texts)), limit))
        assert {c: s[2] for _, c, s in got} == {t: texts.count(t) for t in set(texts)} and len(got) == len(set(texts))
        assert all(s[0] == texts.index(c) for _, c, s in got)


def test_equal_digests_still_spill_to_an_end():
    got = list(grace((((7).to_bytes(8, "big") + bytes([k % 50]) * 24, bytes([k % 50]) * 9, [k, 1, 1, None]) for k in range(200)), 20))
    assert len(got) == 50 and sum(s[2] for _, _, s in got) == 200


def test_normalise_agrees_with_the_pattern():
    for t in ("", " ", "a", " a  b\t\n", "\x0b\x0ca\x1cb\x85c\xa0 ", "\x1f  x"):
        assert normalise(t.encode()) == norm(t).encode()
