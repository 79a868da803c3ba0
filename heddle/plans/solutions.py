"""Queries over solutions and replies (conversations, pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import wordlists as W
from heddle.operators import ast_facts, composite, metrics, parsing, results as R
from heddle.plans import tables as D

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


REPLIES = "f AS (SELECT CAST(conv_id % 4 AS VARCHAR) AS model, CAST(conv_id AS VARCHAR) AS scenario_id, CAST(turn AS INT) AS file_pos, text AS content FROM conversations WHERE role = 'assistant')"
PROMPTS = "s AS (SELECT CAST(conv_id AS VARCHAR) AS scenario_id, conv_id, string_agg(text, ' ' ORDER BY turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id)"


@query(f"WITH {PROMPTS} SELECT scenario_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM s")
def session_prompt_join(spark, sf_dir):
    return D.scenarios(spark, sf_dir).select("scenario_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("digest"))


def all_metrics(spark, sf_dir):
    return metrics.all_metrics(D.replies(spark, sf_dir), D.scenarios(spark, sf_dir))


def solution_scores(spark, sf_dir):
    files = D.replies(spark, sf_dir)
    checks = files.groupBy("model", "scenario_id").agg(F.lit(0.8).alias("compile_score"), F.lit(0.5).alias("unit_score"), composite.integration(F.count(F.lit(1)), F.lit(0)).alias("integration_score"), F.lit(0.7).alias("quality"), F.lit(1.0).alias("security"))
    return composite.score_solutions(metrics.all_metrics(files, D.scenarios(spark, sf_dir)), checks)


Q |= {"all_metrics": all_metrics, "solution_scores": solution_scores}

NAME = "[a-zA-Z_][a-zA-Z0-9_]*"
ROOTS = " + ".join(f"CASE WHEN contains(lower(w), '{r}') THEN {1 << k} ELSE 0 END" for k, r in enumerate(W.NAME_ROOTS))


@query(f"""WITH {REPLIES} SELECT model, scenario_id, round(({" + ".join(f"max(CAST({' OR '.join(f'contains(lower(content), {w!r})' for w in words)} AS INT))" for words in W.DESIGN.values())}) / {len(W.DESIGN)}, 6) AS design_patterns,
  round(({" + ".join(f"max(CAST(contains(lower(content), {w!r}) AS INT))" for w in W.SCALABILITY)}) / {len(W.SCALABILITY)}, 6) AS scalability, round(({" + ".join(f"max(CAST(contains(lower(content), {w!r}) AS INT))" for w in W.INTEGRATION)}) / {len(W.INTEGRATION)}, 6) AS integration FROM f GROUP BY ALL""")
def indicator_metrics(spark, sf_dir):
    c = F.col("content")
    return D.replies(spark, sf_dir).groupBy("model", "scenario_id").agg(
        F.round(metrics.group_share(c, W.DESIGN), 6).alias("design_patterns"), F.round(metrics.indicator_share(c, W.SCALABILITY), 6).alias("scalability"), F.round(metrics.indicator_share(c, W.INTEGRATION), 6).alias("integration")
    )


def _group_sql(groups: dict, weight: float) -> str:
    return " + ".join(f"CASE WHEN {' OR '.join(f'contains(lower(content), {w!r})' for w in words)} THEN {weight} ELSE 0 END" for words in groups.values())


FLOW = " + ".join(f"CASE WHEN {' OR '.join(f'contains(lower(content), {w!r})' for w in words)} THEN 1 ELSE 0 END" for words in W.FLOW_STEPS)


@query(f"""WITH {REPLIES} SELECT model, scenario_id, round(avg(least({_group_sql(W.DATA_FLOW, 0.2)} + 0.4 * ({FLOW}) / 3, 1.0)), 6) AS data_flow, round(avg(least({_group_sql(W.REUSE, 0.25)}, 1.0)), 6) AS reuse,
  CASE WHEN max(CAST(contains(lower(content), 'global') OR contains(lower(content), 'static') OR contains(lower(content), 'shared') AS INT)) = 1 THEN round(avg(least({_group_sql(W.COORDINATION, 0.25)}, 1.0)), 6) ELSE 0.8 END AS shared_state FROM f GROUP BY ALL""")
def file_score_means(spark, sf_dir):
    x = metrics.text_metrics(D.replies(spark, sf_dir))
    return x.select("model", "scenario_id", F.round("data_flow", 6).alias("data_flow"), F.round("reuse", 6).alias("reuse"), F.round("shared_state", 6).alias("shared_state"))


@query(rf"""WITH {REPLIES}, {PROMPTS}, t AS (SELECT scenario_id, unnest(list_distinct(regexp_extract_all(concat(' ', regexp_replace(prompt, '[^\x00-\x7F]', '1', 'g')), '[^a-zA-Z0-9_]([A-Z][a-z]+)', 1))) AS w FROM s),
j AS (SELECT model, f.scenario_id, w, max(CAST(contains(content, w) OR contains(content, lower(w)) OR contains(content, upper(w)) AS INT)) AS hit FROM f JOIN t ON t.scenario_id = f.scenario_id GROUP BY ALL)
SELECT model, scenario_id, round(avg(hit), 6) AS share, count(*) AS n FROM j GROUP BY ALL""")
def terminology_consistency(spark, sf_dir):
    clean = F.concat(F.lit(" "), F.regexp_replace("prompt", r"[^\x00-\x7F]", "1"))
    terms = D.scenarios(spark, sf_dir).select("scenario_id", F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit("[^a-zA-Z0-9_]([A-Z][a-z]+)"), F.lit(1)))).alias("w"))
    hit = F.contains("content", F.col("w")) | F.contains("content", F.lower("w")) | F.contains("content", F.upper("w"))
    j = D.replies(spark, sf_dir).join(terms, "scenario_id").groupBy("model", "scenario_id", "w").agg(F.max(hit.cast("int")).alias("hit"))
    return j.groupBy("model", "scenario_id").agg(F.round(F.avg("hit"), 6).alias("share"), F.count(F.lit(1)).alias("n"))


@query(rf"""WITH n AS (SELECT split_part(url, '/', 3) AS project, page_id, unnest(regexp_extract_all(html, 'href="/([a-zA-Z_][a-zA-Z0-9_]*)', 1)) AS w FROM pages),
c AS (SELECT project, page_id, {ROOTS} AS roots, CASE WHEN contains(w, '_') AND lower(w) = w AND regexp_matches(w, '[a-z]') THEN 'snake_case' WHEN regexp_matches(w, '^[a-z].*[A-Z]') THEN 'camelCase' WHEN regexp_matches(w, '^[A-Z]') THEN 'PascalCase' ELSE 'other' END AS style FROM n)
SELECT project, style, CAST(sum(CASE WHEN roots > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rooted, count(*) AS n FROM c GROUP BY ALL""")
def naming_inconsistency(spark, sf_dir):
    from functools import reduce
    from operator import add

    from heddle.functions import text as T

    n = D.read(spark, sf_dir, "pages").select(F.split("url", "/")[2].alias("project"), "page_id", F.explode(F.regexp_extract_all("html", F.lit(f'href="/({NAME})'), F.lit(1))).alias("w"))
    roots = reduce(add, [F.contains(F.lower("w"), F.lit(r)).cast("int") for r in W.NAME_ROOTS])
    return n.groupBy("project", T.naming_style(F.col("w")).alias("style")).agg(F.sum((roots > 0).cast("bigint")).alias("rooted"), F.count(F.lit(1)).alias("n"))


@query(r"""WITH p AS (SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE 'x' END, '_', page_id // 10) AS scenario_id, CASE page_id % 4 WHEN 0 THEN 'a.py' WHEN 1 THEN 'b.ts' WHEN 2 THEN 'c.java' ELSE 'd.md' END AS path FROM pages),
l AS (SELECT scenario_id, CASE regexp_extract(path, '\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' END AS l, page_id FROM p), c AS (SELECT scenario_id, l, count(*) AS n, min(page_id) AS first FROM l WHERE l IS NOT NULL GROUP BY ALL),
b AS (SELECT scenario_id, l FROM c QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY n DESC, first) = 1)
SELECT DISTINCT p.scenario_id, coalesce(CASE WHEN split_part(p.scenario_id, '_', 1) IN ('go', 'python') THEN split_part(p.scenario_id, '_', 1) END, b.l, 'python') AS language FROM p LEFT JOIN b ON b.scenario_id = p.scenario_id""")
def lang_detect_majority(spark, sf_dir):
    i = F.col("page_id")
    p = D.read(spark, sf_dir, "pages").select(
        F.concat(F.when(i % 3 == 0, "go").when(i % 3 == 1, "python").otherwise("x"), F.lit("_"), F.floor(i / 10).cast("string")).alias("scenario_id"),
        F.when(i % 4 == 0, "a.py").when(i % 4 == 1, "b.ts").when(i % 4 == 2, "c.java").otherwise("d.md").alias("path"),
        i.alias("file_pos"),
    )
    return R.detect_languages(p)


@query("""SELECT conv_id, turn, trim(text, chr(10) || ' ') AS body FROM conversations""")
def code_fence_extract(spark, sf_dir):
    c = D.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Here is it:\n```python\n"), "text", F.lit("\n```\nDone.")).alias("reply"))
    return c.select("conv_id", "turn", F.get(parsing.fences(F.col("reply")), 0).alias("body"))


@query("""WITH c AS (SELECT conv_id, turn, text, conv_id % 7 AS k FROM conversations WHERE role = 'assistant') SELECT concat(conv_id, '_', turn) AS scenario_id, CASE WHEN k = 2 THEN 0 ELSE 1 END AS n_files, ['a.py', 'a.py', NULL, 'solution_1.py', 'src/b.py', 'a.py', 'app.ini'][k + 1] AS name, CASE WHEN k = 2 THEN NULL ELSE text END AS content FROM c WHERE length(trim(text)) >= 50""")
def parse_response_cascade(spark, sf_dir):
    """Replies in seven forms, of which all but plain text hold one file: fenced JSON, a header, nothing, a code fence, a list of files, sessions, an object of files."""
    c = D.read(spark, sf_dir, "conversations").filter("role = 'assistant' and length(trim(text)) >= 50")
    one = lambda name: F.create_map(F.lit(name), "text")
    forms = [
        F.concat(F.lit("Sure.\n```json\n"), F.to_json(F.struct(F.lit("plan").alias("approach"), one("a.py").alias("files"))), F.lit("\n```")),
        F.concat(F.lit("File: a.py\n"), "text"),
        F.col("text"),
        F.concat(F.lit("Here it is:\n```python\n"), "text", F.lit("\n```\nDone.")),
        F.to_json(F.struct(F.array(F.struct(F.lit("src/b.py").alias("path"), F.col("text").alias("content"))).alias("files"))),
        F.to_json(F.struct(one("a.py").alias("session_1"))),
        F.to_json(F.struct(one("app.ini").alias("setup"))),
    ]
    reply = F.element_at(F.array(*forms), (F.col("conv_id") % 7 + 1).cast("int"))
    x = parsing.parse_replies(c.select(F.lit("m").alias("model"), F.concat_ws("_", "conv_id", "turn").alias("scenario_id"), reply.alias("reply"), F.lit("python").alias("language")))
    return x.select("scenario_id", F.coalesce(F.size(F.map_keys("files")), F.lit(0)).alias("n_files"), F.get(F.map_keys("files"), 0).alias("name"), F.get(F.map_values("files"), 0).alias("content"))


@query("SELECT conv_id, turn, true AS ok, 'f' AS functions, 2 AS complexity, 1 AS handled, 1 AS documented, 1 AS typed FROM conversations")
def ast_facts_rows(spark, sf_dir):
    """Every text as the description of one function with a branch that raises, one typed argument and a return."""
    code = F.concat(F.lit("def f(a, b: int):\n    '''"), F.regexp_replace("text", r"[\\'\"]", " "), F.lit("'''\n    if a is None:\n        raise ValueError(a)\n    return b\n"))
    x = ast_facts.parse_python(D.read(spark, sf_dir, "conversations").select("conv_id", "turn", code.alias("content")))
    return x.select("conv_id", "turn", "facts.ok", F.array_join("facts.functions", ",").alias("functions"), "facts.complexity", "facts.handled", "facts.documented", "facts.typed")


@query("""WITH t(kind, name, weight, only_for) AS (VALUES ('compilation', 'syntax_validation', 0.3, ''), ('compilation', 'import_resolution', 0.2, ''), ('compilation', 'type_checking', 0.2, ''), ('compilation', 'api_endpoint_structure', 0.3, 'feature_implementation'), ('compilation', 'refactor_consistency', 0.3, 'cross_file_refactoring'),
  ('unit', 'function_signature_preservation', 0.25, ''), ('unit', 'error_handling', 0.25, ''), ('unit', 'input_validation', 0.25, ''), ('unit', 'output_correctness', 0.25, ''), ('unit', 'bug_fix_verification', 0.4, 'bug_investigation'), ('unit', 'vulnerability_mitigation', 0.4, 'security_analysis'),
  ('integration', 'module_integration', 0.3, ''), ('integration', 'database_integration', 0.3, ''), ('integration', 'api_integration', 0.4, ''), ('performance', 'execution_time', 0.4, ''), ('performance', 'memory_usage', 0.3, ''), ('performance', 'scalability', 0.3, ''),
  ('security', 'injection_prevention', 0.3, ''), ('security', 'input_sanitization', 0.3, ''), ('security', 'access_control', 0.4, '')),
c AS (SELECT DISTINCT conv_id, CASE conv_id % 8 WHEN 0 THEN 'architectural_understanding' WHEN 1 THEN 'cross_file_refactoring' WHEN 2 THEN 'feature_implementation' WHEN 3 THEN 'bug_investigation' WHEN 4 THEN 'multi_session_development' WHEN 5 THEN 'code_comprehension' WHEN 6 THEN 'integration_testing' ELSE 'security_analysis' END AS k FROM conversations WHERE role = 'user')
SELECT CAST(conv_id AS VARCHAR) AS scenario_id, kind, name, CAST(weight AS DOUBLE) AS weight FROM c, t WHERE only_for = '' OR contains(only_for, k)""")
def test_suites(spark, sf_dir):
    return composite.test_suite(D.scenarios(spark, sf_dir))


@query("""WITH s AS (SELECT conv_id, count(*) AS n_files, max(length(text)) AS len FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, round(least(0.15 + 0.15 + CASE WHEN n_files > 1 THEN 0.1 ELSE 0 END + CASE WHEN len > 100 THEN 0.15 ELSE 0 END + CASE WHEN len > 500 THEN 0.15 ELSE 0 END + CASE WHEN n_files >= 3 THEN 0.2 ELSE 0.1 END + CASE WHEN n_files >= 2 THEN 0.1 ELSE 0.05 END, 1.0), 6) AS quality FROM s""")
def reference_quality(spark, sf_dir):
    c = D.read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    s = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("text", F.length("text")).alias("t"))
    return s.select("conv_id", F.round(composite.reference_quality(F.lit("a"), F.col("n"), F.col("t"), F.col("n"), F.col("n")), 6).alias("quality"))
