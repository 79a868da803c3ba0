import json

import pytest
from pyspark.sql import functions as F

from heddle.operators import ast_facts, composite, graph, metrics, parsing, results, retrieval, security, selection
from heddle.sources import files as sources
from heddle.streaming import results as streams

CODE = '''import os
from pkg import thing

class Store:
    def get(self, key: str) -> int:
        """Looks it up."""
        if key is None:
            raise ValueError(key)
        return 1

async def run(x):
    return x
'''


def test_python_facts():
    f = ast_facts.facts(CODE)
    assert f["functions"] == ["run", "get"] or sorted(f["functions"]) == ["get", "run"]
    assert (f["n_functions"], f["handled"], f["documented"], f["typed"], f["methods"], f["control"]) == (2, 1, 1, 1, [1], 1)
    assert f["imports"] == ["os", "pkg.thing"] and f["complexity"] == 2
    assert ast_facts.facts("def (")["ok"] is False
    assert ast_facts.facts("")["complexity"] == 0


def test_single_responsibility_and_kiss(spark):
    body = lambda n: "".join(f"\n    def m{k}(self):\n        pass" for k in range(n)) or "\n    pass"
    code = "\n".join(f"class C{n}:{body(n)}" for n in (0, 1, 12, 20))
    row = metrics.syntax_metrics(spark.createDataFrame([("m", "s", 0, "a.py", code)], "model string, scenario_id string, file_pos int, path string, content string")).first()
    assert row.single_responsibility == pytest.approx(0.675)
    assert row.kiss == pytest.approx(1.4)


def test_dry(spark):
    f = spark.createDataFrame([("p", "x\nx\ny\n\n")], "project string, content string")
    r = metrics.line_duplication(f, ["project"]).select(metrics.dry(F.col("n_filled"), F.col("n_distinct")).alias("d")).first()
    assert r.d == pytest.approx(1 - 2 / 3)


def test_all_metrics_are_between_0_and_1(spark):
    rows = [("m", "s1", 0, "store.py", CODE), ("m", "s1", 1, "test_store.py", "assert True\n"), ("m", "s2", 0, "bad.py", "def ("), ("m", "s3", 0, "e.py", "")]
    files = spark.createDataFrame(rows, "model string, scenario_id string, file_pos int, path string, content string")
    scenarios = spark.createDataFrame([("s1", "feature_implementation", "store user data", "Update the Store to get a user", ["src/store.py"]), ("s2", "multi_session_development", None, "Add it", None), ("s3", "bug_investigation", "", "", [])], "scenario_id string, task_category string, description string, prompt string, context_files array<string>")
    out = metrics.all_metrics(files, scenarios).collect()
    assert len(out) == 3
    for r in out:
        assert all(0 <= v <= 1 for k, v in r.asDict().items() if k not in metrics.KEYS), r


def test_composite(spark):
    r = spark.range(1).select(composite.total_score(F.lit(0.5), F.lit(0.4), F.lit(0.8), F.lit(0.2)).alias("x")).first()
    assert r.x == pytest.approx(2.5)
    assert spark.range(1).select(composite.weighted({"a": F.lit(1.0), "b": F.lit(0.0)}, {"a": 2.0, "b": 2.0}).alias("x")).first().x == pytest.approx(0.5)


def edges(spark, pairs):
    return spark.createDataFrame([("p", a, b) for a, b in pairs], "project string, src string, dst string")


def test_graph(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "x")])
    assert {(r.node, r.depth) for r in graph.depth(e).collect()} == {("a", float("inf")), ("b", float("inf")), ("c", float("inf")), ("d", float("inf")), ("e", 1.0), ("x", 0.0)}
    assert {(r.node, r.cycle) for r in graph.cycles(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    fans = {r.node: (r.fan_out, r.fan_in) for r in graph.fan_metrics(e).collect()}
    assert fans["a"] == (1, 2) and fans["x"] == (0, 1)


def test_go_imports(spark):
    code = 'import "fmt"\nimport (\n  "os"\n  "io"\n)\n'
    one = spark.range(1)
    assert sorted(one.select(graph.dependencies(F.lit(code), "go").alias("x")).first().x) == ["fmt", "io", "os"]
    assert sorted(one.select(graph.dependencies(F.lit(code), "go", compat=True).alias("x")).first().x) == ["io", "os"]


def test_resolve(spark):
    paths = spark.createDataFrame([("p", "src/a.py", 0), ("p", "lib/a.py", 1)], "project string, path string, pos int")
    out = {r.dst: r.external for r in graph.resolve(edges(spark, [("m", "a"), ("n", "src/a"), ("o", "other"), ("q", "x/a.js")]), paths).collect()}
    assert out == {"lib/a.py": False, "src/a.py": False, "other": True}


def test_keyword_ties_and_fallback(spark):
    files = spark.createDataFrame([("p", "b.py", "alpha beta"), ("p", "a.py", "alpha beta"), ("q", "z.py", "none")], "project string, path string, content string")
    q = spark.createDataFrame([(1, "p", "Alpha and that beta thing"), (2, "q", "zzzz")], "query_id int, project string, prompt string")
    out = {r.query_id: r.context for r in retrieval.retrieve(files, q, k=1).collect()}
    assert out == {1: "From a.py (chunk 1, keyword matches: 2):\nalpha beta", 2: "From z.py:\nnone"}


def test_cosine_of_zero(spark):
    zero, one = F.array(F.lit(0.0)), F.array(F.lit(1.0))
    assert spark.range(1).select(retrieval.cosine(zero, one).alias("x")).first().x == 0.0


LONG = "x = 1  # " + "word " * 20


@pytest.mark.parametrize(
    ("reply", "files"),
    [
        ("Here:\n```json\n" + json.dumps({"files": {"a.py": LONG}}) + "\n```", {"a.py": LONG}),
        (json.dumps({"files": [{"path": "a.py", "content": LONG}]}), {"a.py": LONG}),
        (json.dumps({"solution": {"session_1": {"a.py": LONG}, "session_2": {"a.py": LONG + "2"}}}), {"a.py": LONG, "session_2_a.py": LONG + "2"}),
        ('{"files": {"a.py": "' + LONG + '",},}', {"a.py": LONG}),
        ('{"files": {"a.py": "' + LONG + '\nnext"}}', {"a.py": LONG + "\nnext"}),
        (f"Code:\n```python\n{LONG}\n```", {"solution_1.py": LONG.strip()}),
        (f"File: a.py\n{LONG}", {"a.py": LONG.strip()}),
        ("too short", None),
        ("{", None),
        (None, None),
    ],
)
def test_replies(reply, files):
    assert parsing.parse_reply(reply, "python") == files


def test_replies_in_spark(spark):
    out = parsing.parse_replies(spark.createDataFrame([("m", "s", f"```go\n{LONG}\n```", None), ("m", "t", None, "go")], "model string, scenario_id string, reply string, language string"))
    assert [(r.path, r.content) for r in parsing.solution_files(out).collect()] == [("solution_1.go", LONG.strip())]


def test_security(spark):
    code = "import x\neval(a)\npickle.load(f)\n"
    f = spark.createDataFrame([("a.py", code), ("b.py", "")], "path string, content string")
    found = security.findings(f, security.rules_of("python")).collect()
    assert {(r.path, r.line, r.severity) for r in found} == {("a.py", 2, "high"), ("a.py", 3, "high")}
    scores = {r.path: (r.security_score, r.risk_level) for r in security.security_score(f, security.rules_of("python"), ["path"]).collect()}
    assert scores == {"a.py": (0.4, "high"), "b.py": (1.0, "low")}
    long = "def f():\n" + "    x = 1\n" * 25 + "y = 2\n"
    assert [tuple(x) for x in spark.range(1).select(security.long_functions(F.lit(long)).alias("x")).first().x] == [(27, 27)]


def test_retry_and_queue(spark):
    rows = [("m", "a", False)] * 10 + [("m", "b", False)] * 3 + [("m", "c", False), ("m", "c", True)]
    out = {r.scenario_id: (r.failures, r.done, r.action) for r in results.retry_state(spark.createDataFrame(rows, "model_name string, scenario_id string, success boolean")).collect()}
    assert out == {"a": (10, True, "zero"), "b": (3, False, "retry"), "c": (1, True, "skip")}


def test_rate_window(spark):
    r = spark.sql("SELECT 'p' AS provider, timestamp_seconds(t) AS ts FROM VALUES (0), (30), (70), (130) AS v(t)")
    assert [x.in_window for x in results.rate_in_window(r, limit=1).orderBy("ts").collect()] == [1, 2, 2, 2]


def test_legacy_results(spark):
    old = spark.createDataFrame([("m", 0.5, 0.7), ("n", None, None)], "model_name string, style_score double, functional_score double")
    out = {r.model_name: r for r in results.migrate(old).collect()}
    assert out["m"].longcontext_utilization_score == 0.5 and out["m"].software_engineering_score == 0.7
    assert out["n"].longcontext_utilization_score == 0.0


def test_quota(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "pos int")
    assert [r.level for r in results.quota_assignment(rows, {"expert": 1, "hard": 1, "easy": 2}, "pos").orderBy("pos").collect()] == ["expert", "hard", "easy", "easy"]


def test_selection(spark):
    f = spark.createDataFrame([("p", f"f{i}.py", "x" * (10 * (i + 1)), i) for i in range(4)] + [("p", "main.py", "y" * 50, 9)], "project string, path string, content string, pos int")
    out = selection.adaptive_selection(f, "none", 0.5)
    assert {r.path for r in out.collect()} >= {"main.py"}
    assert selection.by_pattern(f, ["F1"], 2).count() == 1 and selection.by_pattern(f, ["zzz"], 2).count() == 2
    assert selection.random_subset(f, 3).count() == 3


def test_scenarios_and_results(spark, tmp_path):
    (tmp_path / "sc").mkdir()
    (tmp_path / "sc" / "a.json").write_text(json.dumps({"id": "go_1", "task_prompt": {"session_2": "b", "session_10": "a"}, "context_files": ["x"]}))
    (tmp_path / "sc" / "b.json").write_text(json.dumps({"scenarios": [{"id": "go_2", "task_prompt": "one"}]}))
    s = sources.read_scenarios(spark, str(tmp_path / "sc"))
    assert {(r.scenario_id, r.session, r.text) for r in sources.prompts(s).collect()} == {("go_1", "session_10", "a"), ("go_1", "session_2", "b"), ("go_2", "", "one")}
    (tmp_path / "r.jsonl").write_text('{"model_name": "m", "scenario_id": "s", "style_score": 0.25}\n\nnot json\n')
    assert [r.longcontext_utilization_score for r in sources.read_results(spark, str(tmp_path / "r.jsonl")).filter("model_name is not null").collect()] == [0.25]
    assert sources.count_damaged(spark, str(tmp_path / "r.jsonl")) == 1
    sources.append_results(spark.createDataFrame([("m", "s"), ("m", "")], "model_name string, scenario_id string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_tree_paths(spark):
    t = spark.sql("""SELECT 'p' AS project, parse_json('{"src": {"a.py": null, "lib": {"b.py": "x"}}, "README": 1}') AS file_structure""")
    assert {r.path for r in sources.tree_paths(t).collect()} == {"src/a.py", "src/lib/b.py", "README"}


def test_config(tmp_path):
    assert sources.Config().problems() == []
    assert len(sources.Config(weights={"a": 0.2}, min_files=0).problems()) == 2
    (tmp_path / "c.json").write_text('{"top_k": 7}')
    assert sources.Config.load(str(tmp_path / "c.json")).top_k == 7


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"model_name": "m", "scenario_id": "s", "success": False, "total_score": 1.0, "ts": f"2024-01-01T00:00:0{i}Z"} for i in range(3)]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "model_name string, scenario_id string, success boolean, total_score double, ts timestamp"
    stream = streams.read_results(spark, str(tmp_path / "in"), schema)

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(streams.first_results(stream), "append", "firsts")) == 1
    assert run(streams.running_summary(stream), "complete", "summary")[0].n == 3
    assert run(streams.retry_state(stream, limit=3), "update", "retries")[-1][2:] == (3, True)


def test_depth_of_a_long_chain(spark):
    found = {r.node: r.depth for r in graph.depth(edges(spark, [(f"n{k + 1}", f"n{k}") for k in range(205)])).collect()}
    assert found == {f"n{k}": float(k) for k in range(206)}
