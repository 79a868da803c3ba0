"""Streams with state and time, the sink that takes results once, status, damaged lines, project folders."""

import json
import random
from datetime import datetime, timedelta

import pytest

from heddle.operators import results as R
from heddle.sources import files, projects
from heddle.streaming import results as S
from heddle.streaming import state

DAY = datetime(2024, 1, 1)
EVENT = "model_name string, scenario_id string, event string, success boolean, task_category string, ts timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, state.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def feed(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_retries_with_time_outs_restart_and_initial_state(rocks, tmp_path):
    spark, folder = rocks, str(tmp_path / "in")
    at = lambda s: DAY + timedelta(seconds=s)
    e = lambda who, event, s, ok=None, kind="x": ("m", who, event, ok, kind, at(s))
    first = [e("ok", "start", 0), e("ok", "result", 100, True), e("ok", "result", 110, False), e("bad", "start", 0), e("bad", "result", 20, False), e("slow", "start", 10), e("late", "start", 10), e("long", "start", 10, kind="multi_session_development")]
    first += [e("tenth", k, 10 * i + (k == "result"), False) for i in range(9) for k in ("start", "result")] + [e("saved", "start", 5), e("saved", "result", 6, False)]
    initial = spark.createDataFrame([("m", "saved", 9, False), ("m", "unseen", 3, False)], "model_name string, scenario_id string, failures int, success boolean")
    rows = []

    def step(new, name):
        feed(spark, folder, new, EVENT, name)
        stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(folder)
        machine = state.retry_machine(stream, initial=initial)
        q = machine.writeStream.foreachBatch(lambda b, i: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        return {r.scenario_id: (r.failures, r.done, r.action) for r in rows}

    seen = step(first, "a")
    assert seen["ok"] == (0, True, "skip") and seen["bad"] == (1, False, "retry") and seen["tenth"] == (9, False, "retry") and seen["saved"] == (10, True, "zero")
    # A new query on the same checkpoint: the tenth failure, and a result that comes after its time.
    seen = step([e("tenth", "start", 300), e("tenth", "result", 301, False), e("late", "result", 311, True), e("clock", "start", 400)], "b")
    assert seen["tenth"] == (10, True, "zero") and seen["late"] == (1, False, "retry")
    # The watermark (a minute behind) passes 310, when "slow" is up, but not 610, when "long" is.
    seen = step([e("clock", "start", 500)], "c")
    assert seen["slow"] == (1, False, "retry") and seen["long"] == (0, False, "retry")
    seen = step([e("clock", "start", 5000), e("tenth", "result", 5000, True)], "d")
    seen = step([e("clock", "start", 9000)], "e")
    assert seen["long"] == (1, False, "retry") and seen["tenth"] == (10, True, "zero") and "unseen" not in seen


def test_the_log_of_requests_agrees_with_the_batch(rocks, tmp_path):
    spark, folder, r = rocks, str(tmp_path / "in"), random.Random(4)
    schema = "provider string, request_id bigint, ts timestamp"
    times = sorted(r.choice([r.randrange(400), 60 * r.randrange(6)]) for _ in range(150))
    rows = [(r.choice("aab"), i, DAY + timedelta(seconds=s)) for i, s in enumerate(times)]
    batches = [rows[:50], rows[50:90], rows[90:]]
    batches[0], batches[1] = batches[0] + batches[1][-3:], batches[1][:-3]  # some come early, the rest out of order
    end = [(p, 1000 + i, DAY + timedelta(seconds=2000)) for i, p in enumerate("ab")]
    out = []
    for i, b in enumerate([*batches, end, [("a", 2000, DAY + timedelta(seconds=9000))]]):
        feed(spark, folder, b, schema, f"b{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        log = state.request_log(stream, limit=20, delay="10 minutes")
        q = log.writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    found = [(x.provider, x.request_id, x.in_window, x.waits) for x in out if x.request_id < 1000]
    want = R.rate_in_window(spark.createDataFrame(rows, schema), limit=20)
    assert sorted(found) == sorted(tuple(x) for x in want.select("provider", "request_id", "in_window", "waits").collect())


RESULT = "model_name string, scenario_id string, parsing_success boolean, total_score double, ts timestamp"


def test_each_result_is_taken_once(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("m", f"s{i % 7}", True, float(i), DAY + timedelta(seconds=i)) for i in range(12)]
    status = S.Status(total=14)
    spark.streams.addListener(status)
    try:
        for name, part in (("a", rows[:8]), ("b", rows[8:])):
            feed(spark, folder, part, RESULT, name)
            stream = spark.readStream.schema(RESULT).option("recursiveFileLookup", "true").parquet(folder)
            S.append_once(S.watched(stream), path, str(tmp_path / "c")).awaitTermination(120)
        for _ in range(100):
            if status.read()["done"] == 12 and not status.read()["running"]:
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(status)
    told = status.read()
    assert told["done"] == 12 and told["ok_share"] == 1.0 and told["eta_seconds"] > 0 and told["error"] is None
    assert S.taken(spark, path, RESULT).count() == 7
    # A batch that is noted adds nothing; one that broke off before it was noted is written again in its place.
    more = spark.createDataFrame([("m", "s0", True, 9.0, DAY), ("n", "s0", True, 9.0, DAY), ("n", "s0", True, 9.0, DAY)], RESULT)
    assert S.take_once(more, 7, path, "other") == 1 and S.take_once(more, 7, path, "other") == 1
    again = spark.createDataFrame([("k", "s1", True, 1.0, DAY)], RESULT)
    again.write.parquet(f"{path}/results/run=other/batch=8")  # crashed here
    assert S.taken(spark, path, RESULT).count() == 8
    assert S.take_once(again, 8, path, "other") == 1
    assert sorted((r.model_name, r.scenario_id) for r in S.taken(spark, path, RESULT).collect()) == sorted([("m", f"s{i}") for i in range(7)] + [("n", "s0"), ("k", "s1")])
    # A stream that starts anew, under another checkpoint, takes nothing that is there.
    S.append_once(spark.readStream.schema(RESULT).option("recursiveFileLookup", "true").parquet(folder), path, str(tmp_path / "c2")).awaitTermination(120)
    assert S.taken(spark, path, RESULT).count() == 9
    assert [r.scenario_id for r in S.last_results(S.taken(spark, path, RESULT), 2).collect()] == [r[1] for r in sorted({x[1]: x for x in rows[:7]}.values(), key=lambda x: x[4])[-1:-3:-1]]


def test_damaged_lines_are_counted_in_the_same_pass(spark, tmp_path):
    lines = [json.dumps({"model_name": "m", "scenario_id": f"s{i}", "style_score": 0.5}) for i in range(5)] + ["{broken", "", '{"model_name": "m", "total_score": "x"}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    rows, seen = files.observed_results(spark, str(tmp_path / "r.jsonl"))
    assert sorted(r.scenario_id for r in rows.collect()) == [f"s{i}" for i in range(5)]
    assert seen.get["damaged"] == 2 and seen.get["lines"] == 7 and seen.get["sample"].startswith("{")
    assert files.count_damaged(spark, str(tmp_path / "r.jsonl")) == 2


def test_project_folders(spark, tmp_path):
    for project, path, data in (("p", "a.py", b"x = 1\n"), ("p", "lib/b.py", "é".encode()), ("p", "bad.bin", b"\xff\xfe\x00"), ("q", "a.py", b""), ("r", "c.py", b"\xef\xbb\xbfy"), ("p", "large.py", b"z" * 99)):
        (tmp_path / project / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / project / path).write_bytes(data)
    (tmp_path / "empty").mkdir()
    (tmp_path / "stray.txt").write_text("no project")
    rows = {(r.project, r.path): (r.content, r.problem is None) for r in projects.read_projects(spark, str(tmp_path)).collect()}
    assert rows == {("p", "a.py"): ("x = 1\n", True), ("p", "lib/b.py"): ("é", True), ("p", "bad.bin"): (None, False), ("p", "large.py"): ("z" * 99, True), ("q", "a.py"): ("", True), ("r", "c.py"): ("y", True)}
    some = projects.read_projects(spark, f"file://{tmp_path}")
    assert some.rdd.getNumPartitions() == 4 and some.filter("project = 'p'").count() == 4 and some.filter("project = 'q'").count() == 1 and some.count() == 6
    one = projects.read_projects(spark, str(tmp_path), projects=["p", "q"], prefix="lib")
    assert one.rdd.getNumPartitions() == 2 and [r.path for r in one.collect()] == ["lib/b.py"]
    assert projects.read_projects(spark, str(tmp_path), projects=[]).count() == 0
    assert sorted(r.project for r in projects.read_projects(spark, str(tmp_path), paths=["a.py"]).collect()) == ["p", "q"]
    large = projects.read_projects(spark, str(tmp_path), most_bytes=50).filter("path = 'large.py'").first()
    assert large.content is None and large.problem == "over 50 bytes"
