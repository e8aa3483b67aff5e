import pytest

from lexfold.llm.extendible_sharding import HASH_BITS, _hashed, assign, write_shards
from lexfold.llm.queries import ORACLE_SQL, SHARD_BYTES


def brute(rows, limit):
    """(h, bytes) rows split on bit after bit; {(shard, page): [bytes]}."""
    out = {}

    def split(part, d):
        total = sum(b for _, b in part)
        if total <= limit or len({h for h, _ in part}) == 1:
            shard = format(part[0][0] >> (HASH_BITS - d), f"0{d}b") if d else ""
            if total > limit and len(part) > 1:
                room = max(1, limit // part[0][1])
                for k in range(0, len(part), room):
                    out[shard, k // room] = sorted(b for _, b in part[k : k + room])
            else:
                out[shard, 0] = sorted(b for _, b in part)
            return
        for bit in (0, 1):
            if half := [r for r in part if r[0] >> (HASH_BITS - d - 1) & 1 == bit]:
                split(half, d + 1)

    if rows:
        split(rows, 0)
    return out


def shards(df, limit):
    out = {}
    rows = assign(df, limit).collect()
    for r in rows:
        out.setdefault((r.shard, r.page), []).append(r)
    for (shard, _), members in out.items():
        assert all(r.shard_bytes == sum(m.doc_bytes for m in members) and r.shard_docs == len(members) and r.depth == len(shard) for r in members)
        assert len(members) == 1 or sum(m.doc_bytes for m in members) <= limit
    return {k: sorted(r.doc_bytes for r in v) for k, v in out.items()}


@pytest.mark.parametrize("limit", [30, 100, 10_000, 1 << 30])
def test_messy_rows(messy, limit):
    rows = [(r.h, r.bytes) for r in _hashed(messy, "doc_id", "text", []).collect()]
    assert shards(messy, limit) == brute(rows, limit)


def test_a_third_of_all_rows_alike(spark):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(400)] + [(7, "the same " * 5)] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for limit in (40, 100, 1000):
        assert shards(df, limit) == brute([(r.h, r.bytes) for r in _hashed(df, "doc_id", "text", []).collect()], limit)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert shards(df, 20_000) == brute([(r.h, r.bytes) for r in _hashed(df, "doc_id", "text", []).collect()], 20_000)
    assert str(SHARD_BYTES) in ORACLE_SQL["op1_extendible_sharding"]


def test_empty(empty):
    assert assign(empty, 10).collect() == []


def test_plan_has_no_python(spark, messy):
    plan = assign(messy, 100)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark, messy, tmp_path):
    write_shards(messy, f"{tmp_path}/out", 200)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select(*messy.columns).collect())) == sorted(map(str, messy.collect()))
