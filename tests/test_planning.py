import math

import pytest
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W
from heddle.operators import ast_facts, composite, graph, metrics, parsing, planning, results, retrieval, security
from heddle.sources import files as sources


def one(spark, column, **values):
    """The value of a column expression over one row."""
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first()["v"]


def suite(spark, category):
    x = composite.test_suite(spark.createDataFrame([("s", category)], "scenario_id string, task_category string"))
    return {k: [(r["name"], r["weight"]) for r in x.collect() if r["kind"] == k] for k in ("compilation", "unit", "integration", "performance", "security")}


def test_suite_by_category(spark):
    plain = suite(spark, "code_comprehension")
    assert plain["compilation"] == [("syntax_validation", 0.3), ("import_resolution", 0.2), ("type_checking", 0.2)]
    assert plain["unit"] == [(n, 0.25) for n in ("function_signature_preservation", "error_handling", "input_validation", "output_correctness")]
    assert plain["integration"] == [("module_integration", 0.3), ("database_integration", 0.3), ("api_integration", 0.4)]
    assert plain["performance"] == [("execution_time", 0.4), ("memory_usage", 0.3), ("scalability", 0.3)]
    assert plain["security"] == [("injection_prevention", 0.3), ("input_sanitization", 0.3), ("access_control", 0.4)]
    assert suite(spark, "feature_implementation")["compilation"][3:] == [("api_endpoint_structure", 0.3)]
    assert suite(spark, "cross_file_refactoring")["compilation"][3:] == [("refactor_consistency", 0.3)]
    assert suite(spark, "bug_investigation")["unit"][4:] == [("bug_fix_verification", 0.4)]
    assert suite(spark, "security_analysis")["unit"][4:] == [("vulnerability_mitigation", 0.4)]
    whole = composite.suite_object(composite.test_suite(spark.createDataFrame([("s", "x")], "scenario_id string, task_category string"))).first()
    assert [x["name"] for x in whole["security_tests"]] == ["access_control", "injection_prevention", "input_sanitization"]


def test_rubrics(spark):
    rows = {(r.task_category, r.kind, r["name"]): r.value for r in planning.rubrics(spark).collect()}
    assert len({c for c, _, _ in rows}) == 8 and len(rows) == 8 * (5 + 4 + 4)
    for c in {c for c, _, _ in rows}:
        assert sum(v for (a, k, _), v in rows.items() if a == c and k == "criterion") == 100
        assert sum(v for (a, k, _), v in rows.items() if a == c and k == "weight") == pytest.approx(1)
    assert rows["multi_session_development", "weight", "MMR"] == 0.5 and rows["multi_session_development", "multiplier", "expert"] == 3.0
    assert rows["security_analysis", "criterion", "Vulnerability Identification"] == 35 and rows["cross_file_refactoring", "multiplier", "hard"] == 1.6


def test_indicators_and_endings():
    assert parsing.detect_language("package main\n\nfunc main() {}") == "go"
    assert parsing.detect_language("def __init__(self): pass") == "python"
    assert parsing.detect_language("use x;\nmod y;") == "rust"
    assert parsing.detect_language("#include <a>\nclass X {") == "cpp"
    assert parsing.files_of({"setup": {"app.ini": "a", "b.conf": "b", "c.cfg": "c", "d.properties": "d"}}) == {"app.ini": "a", "b.conf": "b", "c.cfg": "c", "d.properties": "d"}


def test_compilation_bonus(spark):
    score = lambda size: one(spark, composite.compilation(F.lit(True), F.array(), F.array(F.lit("w")), F.lit(9.0), F.lit(size).cast("bigint")))
    assert [score(s) for s in (None, 0, 9_999_999, 10_000_000, 10_485_759)] == pytest.approx([0.75, 0.75, 0.85, 0.75, 0.75])


def test_legacy_formulas(spark):
    v = [F.lit(x) for x in (0.5, 0.25, 1.0)]
    assert one(spark, composite.functional_of_three(*v)) == pytest.approx(0.5)
    assert one(spark, composite.quality_of_three(*v)) == pytest.approx(0.625)
    assert one(spark, composite.style_of_three(*v)) == pytest.approx(0.575)
    assert [one(spark, composite.integration_by_files(F.lit(n))) for n in (1, 2)] == [0.5, 0.7]
    assert [one(spark, composite.performance(F.lit(c))) for c in ("for x", "for a for b for c for d", "Goroutine")] == pytest.approx([0.7, 0.5, 0.9])


def test_longest_path_of_300_nodes_and_25_levels(spark):
    edges = spark.createDataFrame([("p", i, i + 1) for i in range(300)], "project string, src bigint, dst bigint")
    found = {r.node: r.depth for r in graph.depth(edges).collect()}
    assert found == {i: 300.0 - i for i in range(301)}
    deep = "".join(f'{{"d{k}":' for k in range(25)) + "1" + "}" * 25
    trees = spark.createDataFrame([(1, f'{{"a":{{"b":null}},"t":{deep}}}')], "k int, j string").select("k", F.parse_json("j").alias("file_structure"))
    assert {r.path for r in sources.tree_paths(trees).collect()} == {"a/b", "t/" + "/".join(f"d{k}" for k in range(25))}


def test_dependency_report(spark):
    edges = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "d", "a"), ("q", "e", "f")], "project string, src string, dst string")
    files = spark.createDataFrame([("p", x) for x in "abcd"] + [("q", "e"), ("q", "f"), ("r", "g")], "project string, path string")
    found = {r.project: tuple(r)[1:] for r in graph.analysis_summary(edges, files).collect()}
    assert found == {"p": (4, 4, 1, math.inf), "q": (2, 1, 0, 1.0), "r": (1, 0, 0, 0.0)}


def test_errors_and_limits(spark):
    kind = lambda m: one(spark, planning.error_kind(F.lit(m)))
    assert [kind(m) for m in ("Invalid API key", "ExpiredTokenException", "429 Too Many Requests", "ThrottlingException", "502", "syntax")] == ["auth", "auth_expired", "transient", "throttle", "transient", "unknown"]
    wait = lambda m, a: one(spark, planning.after_error(F.lit(m), F.lit(a)))
    assert [wait("timeout", 0), wait("timeout", 1), wait("timeout", 2), wait("too many tokens", 1), wait("forbidden", 0)] == [1.0, 2.0, None, 3.0, None]
    assert [one(spark, planning.token_limit(F.lit(m))) for m in ("o1-x", "GPT-5", "gpt-4.1-a", "gpt-4o", "gpt-4", "gemini-2.5-pro", "x")] == [100000, 128000, 32768, 16384, 8192, 64000, 8192]
    assert one(spark, planning.lookup(F.lit("b"), {"a": "1", "b": "2"}, "a")) == "2" and one(spark, planning.lookup(F.lit("z"), {"a": "1", "b": "2"}, "a")) == "1"


def test_planning(spark, tmp_path):
    sizes = [tuple(one(spark, planning.size_ranges(F.lit(d)))) for d in W.DIFFICULTIES]
    assert sizes == [(10, 15, 10000, 100000), (15, 40, 100000, 200000), (40, 80, 200000, 500000), (80, 100, 500000, 1000000)]
    rows = planning.level_quotas(spark.range(1003), "id", {"easy": 0.25, "hard": 0.5}).groupBy("level").count().collect()
    n = {r.level: r["count"] for r in rows}
    assert sum(n.values()) == 1003 and n["easy"] >= 250 and n["hard"] >= 501
    lines = [one(spark, planning.split_lines(F.lit(t))) for t in ("", "a", "a\n", "a\nb", "a\r\nb\r", "a\x0bb\u2028c")]
    assert lines == [len(t.splitlines()) for t in ("", "a", "a\n", "a\nb", "a\r\nb\r", "a\x0bb\u2028c")]
    assert one(spark, planning.retrieves(F.lit("Expert"))) and not one(spark, planning.retrieves(F.lit("easy"))) and not one(spark, planning.retrieves(F.lit("hard"), enabled=False))
    assert sources.create_folders(spark, f"file://{tmp_path}/x")[0].endswith("x/scenarios")


def test_unused_imports_and_sanitised(spark):
    used = lambda c: one(spark, T.unused_imports(F.lit(c)))
    assert [used(c) for c in ("import os", "from a import b, c", "from a import  b as   c", "x = 1")] == [False, False, True, False]
    assert parsing.sanitised('{"a": "x", "b": [1], "c": 1.5, "d": true}') == {"a": "x", "b": "[\n  1\n]", "c": "1.5", "d": "True"}
    assert parsing.sanitised("[1]") == parsing.sanitised(None) == parsing.sanitised("{") == {}


def test_embedding_and_keywords(spark):
    t = spark.createDataFrame([("red green",), ("",), (None,)], "text string")
    v = [r.embedding for r in retrieval.embed(t).collect()]
    assert sum(x * x for x in v[0]) == pytest.approx(1) and not any(v[1]) and not any(v[2]) and len(v[0]) == 256
    assert [r.embedding for r in retrieval.embed(t, vectoriser=lambda ts: [[float(len(x))] for x in ts]).collect()] == [[9.0], [0.0], [0.0]]
    chunks = spark.createDataFrame([("p", "a", 0, "Hidden lanterns glow"), ("p", "b", 0, "no match"), ("p", "c", 0, None)], "project string, path string, idx int, text string")
    q = spark.createDataFrame([(1, "lantern lantern glow"), (2, "zzzz")], "query_id int, prompt string")
    assert [tuple(r) for r in retrieval.keyword_scores(chunks, q).collect()] == [(1, "p", "a", 0, 3)]
    words = spark.createDataFrame([("lantern",), ("glow",), ("owls",)], "_w string")
    low = chunks.withColumn("low", F.lower("text"))
    joined = retrieval.found_words(low, "low", words, most=1)  # more words than a task may hold
    assert sorted(tuple(r) for r in joined.collect()) == sorted(tuple(r) for r in retrieval.found_words(low, "low", words).collect()) == [("p", "a", 0, "glow"), ("p", "a", 0, "lantern")]


def test_reports(spark, tmp_path):
    r = spark.createDataFrame([("m", "s1", 0, True, 1.0), ("m", "s1", 1, True, 2.0), ("n", "s1", 2, False, 3.0), ("n", "s2", 3, False, 4.0)], "model_name string, scenario_id string, k int, parsing_success boolean, total_score double")
    found = {x.scenario_id: (x.models_evaluated, x.results) for x in results.scenario_lookup(r, "k").collect()}
    assert found == {"s1": (["m", "n"], {"m": 1.0, "n": 3.0}), "s2": (["n"], {"n": 4.0})}
    assert [(x.k, x.n_failures) for x in results.first_failures(r, ~F.col("parsing_success"), "k", most=1).collect()] == [(2, 2)]
    sources.save_state(r, f"{tmp_path}/state")
    assert sources.load_state(spark, f"{tmp_path}/state", r.schema.simpleString()[7:-1].replace(":", " ")).count() == 4
    assert sources.load_state(spark, f"{tmp_path}/none", "k int").count() == 0


def test_selection_of_scenarios_and_attempts(spark):
    s = spark.createDataFrame([("a", "bug_investigation", "hard", 0), ("b", "code_comprehension", "easy", 1)], "scenario_id string, task_category string, difficulty string, pos int")
    assert [r.scenario_id for r in results.filter_scenarios(s, ["bug_investigation"]).collect()] == ["a"]
    assert results.filter_scenarios(s, [], ["easy"]).count() == 1 and results.filter_scenarios(s).count() == 2
    queue = results.work_queue(s, spark.createDataFrame([("x",), ("y",)], "model_name string")).orderBy("slot").collect()
    assert [(r.scenario_id, r.model_name) for r in queue] == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    state = spark.createDataFrame([("x", "a", 10, "zero"), ("x", "b", 1, "retry")], "model_name string, scenario_id string, failures int, action string")
    zero = results.failed_rows(state, s).collect()
    assert [(r.scenario_id, r.total_score, r.attempts) for r in zero] == [("a", 0.0, 10)]
    tries = spark.createDataFrame([("p", 1, 5), ("p", 2, 9), ("p", 3, 9), ("q", 1, 1), ("q", 2, 2)], "k string, n int, v int")
    assert sorted((r.k, r.n) for r in results.best_attempt(tries, "k", "n", F.col("v") > 8).collect()) == [("p", 2), ("q", 2)]
    solutions = spark.createDataFrame([("a", "m")], "scenario_id string, model string")
    assert {r.scenario_id: len(r.solutions) for r in results.nested(s, solutions).collect()} == {"a": 1, "b": 0}


def test_file_rules(spark):
    c = lambda col, t: one(spark, col(F.col("t")), t=t)
    assert c(composite.test_result, "x PASS") == 1.0 and c(composite.test_result, "FAIL") == 0.0 and c(composite.test_result, "?") == 0.5
    generic = c(ast_facts.parse_generic, "def b a\nif a")
    assert (generic["words"], generic["complexity"]) == (["a", "b"], 1)
    fallback = c(T.fallback_complexity, "if a:\n  # for\nclass B\n")
    assert (fallback["cyclomatic_complexity"], fallback["lines_of_code"], fallback["class_count"], fallback["comment_lines"]) == (3.0, 4, 1, 1)
    m = {k: F.lit(v) for k, v in {"acs": 1.0, "dta": 0.5, "cfrd": 0.25, "mmr": 0.1, "idc": 0.2, "icu": 0.3}.items()}
    score = lambda k: one(spark, composite.longcontext_by_category(F.lit(k), m))
    assert [score(k) for k in ("architectural_understanding", "cross_file_refactoring", "multi_session_development", "other")] == pytest.approx([0.8, 0.475, 0.14, 0.275])
    assert one(spark, metrics.prompt_text(F.create_map(F.lit("session_2"), F.lit("b"), F.lit("session_10"), F.lit("a")))) == "a b"
    assert one(spark, ast_facts.symbols(F.struct(F.array(F.lit("f")).alias("functions"), F.array(F.lit("C")).alias("classes"), F.array(F.lit("f")).alias("variables")))) == ["f", "C"]


def test_function_details(spark):
    go = "package m\n\nfunc Add(a int, b  int) int {\nfunc (s *Set) Has(key string) bool {\n x := 1\nfunc none() {}\n(f) func Odd( , y T ) {"
    assert [tuple(r) for r in one(spark, ast_facts.go_functions(F.lit(go)))] == [("Add", 3, ["int", "int"], False), ("Has", 4, ["string"], False), ("none", 6, [], False), ("Odd", 7, ["T"], True)]
    js = "async function load(x) {\nconst f = async (a) => a\nobj = { go: function () {} }\nlet y = 2\nrun(x) {"
    assert [tuple(r) for r in one(spark, ast_facts.javascript_functions(F.lit(js)))] == [("load", 1, True), ("f", 2, True), ("go", 3, False), ("run", 5, False)]
    assert one(spark, ast_facts.go_functions(F.lit(""))) == []


def test_session_headings(spark):
    prompt = F.create_map(F.lit("session_2"), F.lit("b"), F.lit("session_10"), F.lit("a"))
    assert one(spark, metrics.requirements_text(prompt)) == "**SESSION_10**: a\n\n**SESSION_2**: b"
    assert one(spark, metrics.first_session(prompt)) == "**SESSION_10**: a"
