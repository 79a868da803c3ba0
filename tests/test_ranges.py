"""Two-level running sums, numbers and what is built on them; objects within replies."""

import json
import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import parsing, ranges, results, selection


def test_running_sums_of_hot_and_small_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, 0, 1, 2]), i, r.randrange(9)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, id int, n int")
    got = {x.id: (x.before, x.before_total) for x in ranges.running(df, ["g"], [F.desc("o"), F.col("id")], {"before": F.col("n")}, parts=7).collect()}
    for g in {x[0] for x in rows}:
        own, ahead = sorted((x for x in rows if x[0] == g), key=lambda x: (-(-1 if x[1] is None else x[1]), x[2])), 0
        for x in own:
            assert got[x[2]] == (ahead, sum(y[3] for y in own))
            ahead += x[3]
    assert len(got) == len(rows)


def test_numbers_keep_repeated_rows(spark):
    rows = [(k % 3 or None, "x") for k in range(50)] + [(9, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    out = ranges.numbered(df, [F.col("k")], parts=5).orderBy("number").collect()
    assert [x.number for x in out] == list(range(1, 52))
    assert [x.k for x in out] == sorted((x[0] for x in rows), key=lambda k: (k is not None, k))
    assert ranges.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_quotas_with_repeated_keys(spark):
    rows = spark.createDataFrame([(1,), (1,), (1,), (None,), (2,)], "pos int")
    out = results.quota_assignment(rows, {"expert": 2, "hard": 1, "easy": 9}, "pos").collect()
    assert len(out) == 5
    assert sorted((x.pos is not None, x.pos or 0, x.level) for x in out) == [(False, 0, "expert"), (True, 1, "easy"), (True, 1, "expert"), (True, 1, "hard"), (True, 2, "easy")]


def test_selection_reads_each_file_once(spark):
    files = spark.createDataFrame([("p", f"f{i}.py", "x" * (10 * i), i) for i in range(12)] + [("q", "error.py", "x" * 5, 0), ("q", "none.py", None, 1), ("e", "a.py", "", 0)], "project string, path string, content string, pos int")
    out = selection.select_for_difficulty(files, "bug_investigation", 0.4, 0.6, "medium")
    assert out.filter("project = 'p'").select("level").distinct().collect() == [("medium",)]
    assert {x.path for x in out.filter("project = 'q'").collect()} == {"error.py"}
    plan = out._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan
    assert [x.path for x in selection.expand_selection(files, F.lit(False), 0.1).filter("project = 'p'").collect()] == ["f11.py"]


def scan(text):
    """The objects, each found by reading on from its brace."""
    out, at = [], 0
    while (start := text.find("{", at)) >= 0:
        depth, quoted, skip, end = 0, False, False, -1
        for i in range(start, len(text)):
            c = text[i]
            if skip:
                skip = False
            elif c == "\\":
                skip = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    end = i + 1
                    break
        if end > 0:
            out.append(text[start:end])
        at = end if end > 0 else start + 1
    return out


def test_balanced_objects():
    r = random.Random(2)
    for _ in range(4000):
        text = "".join(r.choice('{}{}"\\ab') for _ in range(r.randint(0, 25)))
        assert parsing.balanced(text) == scan(text), text
    assert len(parsing.balanced("{}" * 1000 + "{" * 100_000 + '{"a": 1}')) == 1001
    reply = json.dumps({"files": [{"path": "a.py", "content": "print(1)\n" * 8}]})
    assert "a.py" in str(parsing.parse_reply("{} " * 1000 + reply, "python"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', '{"a": 1}'), ('  {"a": {"b": "}"}} tail }', '{"a": {"b": "}"}}'), ('{"a": "\\"}"} x', '{"a": "\\"}"}'), ("no", None), ("{", None), ("", None), (None, None), ('{"a": "{"', None),
    ],
)
def test_first_balanced_object(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parsing.first_balanced(F.col("t")).alias("x")).first().x == want


def test_first_object_of_a_reply(spark):
    texts = ['{"a": 1}', 'Here: {"a": 1} and {"b": 2} }', '```json\n{"a": 1}\n```', '```json\n{"a": 1} trailing }\n```', "none {", None, 'x {"a": "}{"} y }']
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.to_json(parsing.first_object(F.col("t"))).alias("x")).orderBy("i").collect()]
    assert got == ['{"a":1}'] * 4 + [None, None, '{"a":"}{"}']
