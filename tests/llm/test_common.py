import pyarrow as pa
import pytest

from lexfold.llm import common


@pytest.mark.parametrize("limit", [1, 7, 30, 10_000])
def test_slices_keep_every_row(monkeypatch, limit):
    monkeypatch.setattr(common, "SLICE_BYTES", limit)
    texts = ["", None, "a" * 50, "bb", "c" * 9, None, "d", "é" * 6, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "t"])
    for b in (batch, batch.slice(2, 5), batch.slice(0, 0)):
        out = list(common.in_slices(iter([b])))
        assert pa.Table.from_batches(out, batch.schema).to_pylist() == pa.Table.from_batches([b], batch.schema).to_pylist()
        assert all(x.num_rows == 1 or sum(len((t or "").encode()) for t in x.column(1).to_pylist()) <= limit for x in out if x.num_rows)


def test_checkpoints_use_the_named_folder(spark):
    common.ensure_checkpoint_dir(spark)
    before = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    common.ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == before
    assert common.cut(spark.range(5)).count() == 5


def test_mixing_words_is_a_bijection_on_samples():
    import numpy as np

    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(common.mix64(x))) == len(x)
