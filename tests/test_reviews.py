"""Review results in micro-batches."""

import json

from pyspark.sql import functions as F

from quarrystone.streaming import reviews as V
from quarrystone.streaming.outbox import written


def test_one_bad_result_among_thirty(spark, tmp_path):
    path = str(tmp_path / "ledger")
    findings = spark.createDataFrame([(i, "OPEN" if i % 3 else "RESOLVED") for i in range(40)], "finding_id long, status string")
    result = lambda i, **more: json.dumps({"target_id": i, "status": "COMPLETED", "verdict": "TRUE_POSITIVE", "confidence": 0.5, "suggested": "confirmed"} | more)
    jobs = [(100 + i, result(i)) for i in range(28)] + [(128, result(28, status="FAILED")), (129, '{"target_id": 29, "status": ')]
    sink = V.review_sink(spark, path, findings, F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    batch = lambda rows: spark.createDataFrame(rows, "job_id long, payload string")
    sink(batch(jobs), 0)
    rows = lambda: sorted((tuple(r)[:2] + (r.verdict, r.status_after, r.error, r.batch) for r in written(spark, path, V.LEDGER).collect()), key=str)
    once = rows()
    kinds = [r[0] for r in once]
    assert kinds.count("review") == 29 and kinds.count("rejected") == 1 and kinds.count("finding") == sum(i % 3 > 0 for i in range(28))
    assert [r[1] for r in once if r[0] == "rejected"] == [129] and {r[4] for r in once} == {None, "no JSON"}
    sink(batch(jobs), 0)  # the batch runs again
    assert rows() == once
    more = [(100, result(0, suggested="false_positive")), (200, result(1, suggested="false_positive")), (201, result(31)), (202, result(31, suggested="false_positive")), (203, result(32, confidence=7)), (204, result(33, status="odd")), (None, result(34)), (205, result(999))]
    sink(batch(more), 1)
    last = [r for r in rows() if r[5] == 1]
    assert [(r[1], r[3]) for r in last if r[0] == "review"] == [(200, None), (201, "CONFIRMED"), (202, None)]  # 100 was applied; 1 is no longer open; one change of 31
    assert sorted((r[1] or 0, r[4]) for r in last if r[0] == "rejected") == [(0, "no job"), (203, "confidence out of range"), (204, "unknown status")]
    after = {r.finding_id: r.status for r in V.statuses(findings, written(spark, path, V.LEDGER)).collect()}
    assert after[1] == "CONFIRMED" and after[31] == "CONFIRMED" and after[0] == "RESOLVED" and after[32] == "OPEN" and len(after) == 40
