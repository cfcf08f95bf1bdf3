"""The outbox loop: order, admission, restarts, and batches that run twice."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarrystone.streaming import outbox as O

SCHEMA = "event_id long, event string, status string, created_at timestamp"


def rows(n, start=0):
    at = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i // 7)  # noqa: E731  seven of a time
    return [(i, f"e{i}", "PENDING" if i % 5 else "PROCESSED", at(i)) for i in range(start, start + n)]


def test_batches_in_order_and_once(spark, tmp_path):
    source, sink, cursor = (str(tmp_path / x) for x in ("in", "out", "cursor"))
    put = lambda r, files: spark.createDataFrame(r, SCHEMA).repartition(files).write.mode("append").parquet(source)
    put(rows(90), 3)
    seen, fail = [], [2]

    def write(batch, number):
        O.write_once(sink)(batch, number)
        seen.append((number, sorted(r.event_id for r in batch.collect())))
        if number in fail:
            fail.remove(number)
            raise RuntimeError("killed after the write")

    stream = lambda: O.outbox(spark, source, SCHEMA, 20)
    with pytest.raises(Exception, match="killed after the write"):
        O.run_idle(stream(), cursor, write)
    O.run_idle(stream(), cursor, write)
    put(rows(40, 90), 2)
    O.run_idle(stream(), cursor, write)
    want = [i for i in range(130) if i % 5]
    out = O.written(spark, sink, SCHEMA)
    assert sorted(r.event_id for r in out.collect()) == want
    assert [n for n, ids in seen if n == 2] == [2, 2]  # it ran again, and wrote the same
    assert [ids for n, ids in seen if n == 2][0] == [ids for n, ids in seen if n == 2][1]
    assert all(len(ids) <= 20 for _, ids in seen)
    last = {}
    for n, ids in seen:
        last[n] = ids
    assert [i for n in sorted(last) for i in last[n]] == want
    after = O.mark_processed(spark.createDataFrame(rows(10), SCHEMA), out, F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    assert {(r.event_id, r.status) for r in after.collect()} == {(i, "PROCESSED") for i in range(10)}
    assert after.where("processed_at is null").count() == 2  # those that were processed before


def test_since_and_nothing_there(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(rows(30), SCHEMA).write.parquet(source)
    O.run_idle(O.outbox(spark, source, SCHEMA, 100, "2024-01-01T00:00:03"), str(tmp_path / "c"), O.write_once(str(tmp_path / "out")))
    assert sorted(r.event_id for r in O.written(spark, str(tmp_path / "out"), SCHEMA).collect()) == [i for i in range(21, 30) if i % 5]
    assert O.written(spark, str(tmp_path / "none"), SCHEMA).count() == 0
