"""Extra columns that bear the names operators use inside come back as they were."""

import pytest
from pyspark.sql import functions as F

from lexfold.llm import extendible_sharding, grace_dedup, language_id, mixing, simhash_tiles
from lexfold.llm.common import ensure_checkpoint_dir, unused

NAMES = ("__h", "__key", "__id", "__gone", "__hash", "__text", "__epoch", "__row", "name", "number", "hash", "epoch", "shard", "page", "h", "row", "key", "node", "root", "block", "size", "bytes", "of", "id", "low", "k0")
TEXTS = [(1, "one two three four five six", "en", "a"), (2, "one  two three four five six", "en", "a"), (3, "something else entirely is said in this text", "en", "b"), (None, None, None, None)]


@pytest.fixture
def clashing(spark):
    columns = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *(f"{n} of {k}" for n in NAMES)) for k, r in enumerate(TEXTS)], f"doc_id bigint, text string, lang string, source string, {columns}")


def whole(rows, df):
    """The rows, all their columns, are among those of ``df``."""
    given = {tuple(r) for r in df.collect()}
    return bool(rows) and all(tuple(r)[: len(df.columns)] in given for r in rows)


def test_unused(clashing):
    assert unused(clashing, "__h", "fresh", "fresh", "HASH") == ["__h_", "fresh", "fresh_", "HASH_"]


@pytest.mark.parametrize("keep", [grace_dedup.dedup_rows, simhash_tiles.keep_first, lambda df: language_id.keep_identified(df, language_id.train(df), 0.0)])
def test_rows_that_stay_are_whole(clashing, keep):
    kept = keep(clashing)
    assert kept.columns == clashing.columns and whole(kept.collect(), clashing)


def test_mixed_rows(clashing):
    mixed = mixing.mixed_rows(clashing)
    assert mixed.columns == [*clashing.columns, "mix_shard", "mix_order"] and whole(mixed.collect(), clashing)


def test_digests(clashing):
    assert grace_dedup.dedup_members(clashing).count() == simhash_tiles.near_duplicates(clashing).count() == mixing.mixed_digest(clashing).count() == len(TEXTS)


def test_written_shards(clashing, tmp_path, spark):
    extendible_sharding.write_shards(clashing, f"{tmp_path}/out", 40)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {*clashing.columns, "shard_", "page_"} and whole(back.select(clashing.columns).collect(), clashing) and back.count() == len(TEXTS)


def test_textual_ids(clashing):
    named = clashing.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    assert sorted(((r.doc_id, r.keep_id, r.kept) for r in grace_dedup.dedup_members(named).collect()), key=str) == [("d1", "d1", True), ("d2", "d1", False), ("d3", "d3", True), (None, None, True)]


def test_a_cluster_must_name_its_checkpoint_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d: d})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)
