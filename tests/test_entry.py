"""The driver's contract, and every SQL equivalent on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as e
from lexfold.oracles import ORACLE_SQL
from lexfold.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted((tuple((x is None, f"{x:.9g}" if isinstance(x, float) else str(x)) for x in r) for r in rows))


def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert got
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        assert sorted(db.sql(ORACLE_SQL[name]).columns) == columns
        names = ", ".join(f'"{c}"' for c in columns)
        want = db.sql(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall()
        assert plain(got) == plain(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_all_pins_hold(spark, sf):
    pins = QUERIES["corpus_pins"](spark, sf).collect()
    assert len(pins) >= 59 and [tuple(r) for r in pins if not r.holds] == []
