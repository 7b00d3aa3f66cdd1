"""Streaming reduction: same rows as the batch operator, and a restart over
the same checkpoint only processes files that arrived since."""

import uuid

from helpers import D, offers, tx
from revisit.operators.reduce import reduce_transactions
from revisit.session import scratch_path
from revisit.streaming.reduce_stream import run_reduction


def test_streaming_reduction_resumes_from_checkpoint(spark):
    run = f"stream-test-{uuid.uuid4().hex[:8]}"
    src, sink, ckpt = (scratch_path(spark, run, p) for p in ("src", "sink", "ckpt"))
    o = offers(spark, [(0, 10, 100, 1000, 1.0)])
    first = tx(spark, [(1, 10, 1, 1, D(2000, 1, 1), 1, 1.0), (2, 1, 1, 1, D(2000, 1, 1), 1, 1.0)])
    second = tx(spark, [(3, 1, 100, 1, D(2000, 1, 2), 2, 2.0), (4, 2, 2, 2, D(2000, 1, 2), 2, 2.0)])
    first.write.mode("append").parquet(src)
    run_reduction(spark, src, first.schema, o, sink, ckpt)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1]
    second.write.mode("append").parquet(src)
    run_reduction(spark, src, first.schema, o, sink, ckpt)
    got = spark.read.parquet(sink)
    assert sorted(r.id for r in got.collect()) == [1, 3]      # nothing processed twice
    want = reduce_transactions(first.unionByName(second), o)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_time_out_is_an_error(spark, monkeypatch):
    import pytest
    run = f"stream-test-{uuid.uuid4().hex[:8]}"
    src, sink, ckpt = (scratch_path(spark, run, p) for p in ("src", "sink", "ckpt"))
    rows = tx(spark, [(i, 10, 1, 1, D(2000, 1, 1), 1, 1.0) for i in range(20)])
    rows.repartition(10).write.parquet(src)
    with pytest.raises(TimeoutError):
        run_reduction(spark, src, rows.schema, offers(spark, [(0, 10, 100, 1000, 1.0)]), sink, ckpt, timeout_s=0.05, max_files_per_trigger=1)
