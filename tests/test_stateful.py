"""State with timers, fed in steps."""

import datetime
import random

from quarrystone.streaming import jobs, stateful

T0 = datetime.datetime(2024, 1, 1)


def fed(spark, tmp_path, schema, steps, job):
    """What each step of rows makes the stream say."""
    out = []
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        said = []
        jobs.run_once(job(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "cursor"), lambda b, i: said.extend(map(tuple, b.collect())), "update")
        out.append(said)
    return out


def test_log_end(spark, tmp_path):
    schema = "task_id string, sequence long, is_last boolean, at timestamp"
    at = lambda h: T0 + datetime.timedelta(hours=h)
    rng = random.Random(2)
    numbers = list(range(40))
    rng.shuffle(numbers)
    chunk = lambda n, h: ("r", n, n == 39, at(h))
    steps = [
        [("a", 0, False, at(0)), ("a", 3, True, at(0)), ("b", 5, None, at(0)), ("b", None, None, at(0))] + [chunk(n, 0) for n in numbers[:15]],
        [("a", 1, False, at(1)), ("a", 1, False, at(1)), ("b", 6, False, at(1))] + [chunk(n, 1) for n in numbers[15:30]],
        [("a", 2, False, at(2)), ("b", 2, False, at(2))] + [chunk(n, 2) for n in numbers[30:]],
        [("a", 2, False, at(3)), ("z", 0, True, at(200))],  # a repeat stays quiet; z moves the watermark
        [("z2", 0, True, at(400))],
        [("a", 0, True, at(400))],  # a was forgotten and starts anew
    ]
    out = fed(spark, tmp_path, schema, steps, lambda s: stateful.log_progress(s, "1 hour", 3_600_000))
    said = [{t: r for t, *r in x} for x in out]
    assert said[0]["a"] == [False, True, 2] and said[1]["a"] == [False, True, 1] and said[2]["a"] == [True, True, 0] and "a" not in said[3]
    assert said[0]["b"] == [False, False, 5] and said[1]["b"] == [False, False, 5] and said[2]["b"] == [False, False, 4]
    first = set(numbers[:15])
    assert said[0]["r"] == [False, 39 in first, (40 if 39 in first else max(first) + 1) - len(first)]
    assert said[2]["r"] == [True, True, 0] and said[5]["a"] == [True, True, 0]


def test_executors_lose_their_metrics(spark, tmp_path):
    schema = "executor_id string, status string, cpu double, memory double, at timestamp"
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    steps = [
        [("x", "REGISTERED", 0.5, 100.0, at(0)), ("x", "BUSY", 0.9, None, at(1)), ("y", None, 0.1, 10.0, at(1))],
        [("y", "DRAINING", 0.2, 20.0, at(9)), ("x", "READY", 0.3, 30.0, at(0))],
        [("y", "READY", 0.4, 40.0, at(30))],
        [("y", "READY", 0.4, 40.0, at(31)), ("x", "REGISTERED", 0.6, 60.0, at(31))],
    ]
    out = fed(spark, tmp_path, schema, steps, lambda s: stateful.executors(s, "1 minute"))
    ms = lambda m: int(T0.replace(tzinfo=datetime.UTC).timestamp() * 1000) + 60_000 * m
    assert sorted(out[0]) == [("x", "BUSY", ms(1), 0.9, None), ("y", "READY", ms(1), 0.1, 10.0)]
    assert ("y", "DRAINING", ms(9), 0.2, 20.0) in out[1]
    said = [r for x in out[1:3] for r in x]
    assert ("x", "OFFLINE", ms(1), None, None) in said
    assert ("x", "READY", ms(31), 0.6, 60.0) in out[3]  # it is back


def test_chunks_are_judged_by_the_assignment_of_their_time(spark, tmp_path):
    """A task reassigned between two chunks, an assignment that comes after the chunk it concerns, and one that takes the task away."""
    schema = "task_id string, kind string, executor_id string, sequence long, stream string, at timestamp"
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    chunk = lambda t, e, n, m: (t, "chunk", e, n, None, at(m))
    given = lambda t, e, m: (t, "assignment", e, None, None, at(m))
    steps = [
        [given("t", "x", 0), chunk("t", "x", 0, 1), chunk("t", "y", 1, 2), chunk("u", "x", 0, 5)],
        [given("t", "y", 10), chunk("t", "y", 2, 11), chunk("t", "x", 3, 9), chunk("t", "x", 4, 12), given("u", "x", 4)],
        [given("t", None, 20), chunk("t", "y", 5, 21), chunk("v", "x", 0, 22)],
        [given("end", "x", 500)],
        [given("end", "x", 900)],
    ]
    job = lambda s: stateful.authorized_as_of(s.where("kind = 'chunk'"), s.where("kind = 'assignment'"), "30 minutes")
    said = []
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.run_once(job(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "cursor"), lambda b, i: said.extend(map(tuple, b.collect())), "append")
    assert sorted(said) == [("t", 0, "stdout", True), ("t", 1, "stdout", False), ("t", 2, "stdout", True), ("t", 3, "stdout", True), ("t", 4, "stdout", False), ("t", 5, "stdout", False), ("u", 0, "stdout", True), ("v", 0, "stdout", False)]


def test_a_task_of_both_plans(spark, tmp_path):
    """What an event can do is worked out before the step: an event of a shorter plan does nothing behind its end, and idle ones still announce a task."""
    schema = "task_id string, task_type string, stage_id string, stage_type string, event string, status string, at timestamp"
    ev = lambda t, n, stage, status="SUCCEEDED", kind="CODE_CHECK", event="StageCompleted": (t, kind, f"s{n}", stage, event, status, T0 + datetime.timedelta(minutes=n))
    steps = [
        [ev("a", n, s) for n, s in enumerate(jobs.PLAN[:4])] + [ev("b", 1, None), ev("c", 2, "RULES_PREPARE"), ev("c", 1, "SOURCE_PREPARE", kind=None)],
        [ev("a", 5, "RESULT_REVIEW", kind="SCA_CHECK"), ev("b", 5, "SOURCE_PREPARE", None), ev("c", 6, "SCAN_EXEC", "SKIPPED", event="StageUpdated"), ev("c", 7, "RESULT_PROCESS", "FAILED", event="StageUpdated")],
        [ev("a", 8, "RESULT_REVIEW"), ev("b", 8, "SOURCE_PREPARE", "FAILED"), ev("c", 8, "RESULT_PROCESS", event=None)],
    ]
    out = [sorted(x) for x in fed(spark, tmp_path, schema, steps, lambda s: jobs.task_states(s, "1 hour"))]
    assert out[0] == [("a", 4, "RUNNING"), ("b", 0, "RUNNING"), ("c", 2, "RUNNING")]
    assert out[1] == [("a", 4, "RUNNING"), ("b", 0, "RUNNING"), ("c", 3, "RUNNING")]
    assert out[2] == [("a", 5, "SUCCEEDED"), ("b", 0, "FAILED"), ("c", 4, "RUNNING")]


def test_task_events_are_numbered_once(spark, monkeypatch):
    from quarrystone.plans import streams

    plans = []
    monkeypatch.setattr(streams, "arrived", lambda spark, steps, job, keys: plans.extend(s._jdf.queryExecution().optimizedPlan().toString() for s in steps))
    streams.k2(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("Window" in p for p in plans)
