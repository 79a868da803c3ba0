"""Queries over planning, error kinds, rubrics, line parsers, and reports of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W
from heddle.operators import ast_facts, composite, graph, planning as P, results as R
from heddle.plans import graphs, tables as D

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _values(rows) -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


LEVEL = "CASE {0} % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'expert' END"
CATEGORY = "CASE {0} % 8 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(W.CATEGORIES)) + " END"


def _level(n):
    return P.cycled(W.DIFFICULTIES, n)


RUBRIC_ROWS = [(c, "criterion", k, float(v)) for c, (x, _, _) in W.RUBRICS.items() for k, v in x.items()] + [(c, "weight", k, v) for c, (_, x, _) in W.RUBRICS.items() for k, v in x.items()]
MULTIPLIERS = [(c, d, m) for c, (_, _, x) in W.RUBRICS.items() for d, m in zip(W.DIFFICULTIES, x, strict=True)]


@query(f"""WITH e AS (SELECT event_id, {CATEGORY.format('event_id')} AS task_category, {LEVEL.format('user_id')} AS difficulty FROM events), r(task_category, kind, name, value) AS ({_values(RUBRIC_ROWS)}), m(task_category, difficulty, factor) AS ({_values(MULTIPLIERS)})
SELECT task_category, difficulty, kind, name, count(*) AS n, round(CAST(max(value) AS DOUBLE) * CASE WHEN kind = 'criterion' THEN max(factor) ELSE 1 END, 6) AS value FROM e JOIN r USING (task_category) JOIN m USING (task_category, difficulty) GROUP BY task_category, difficulty, kind, name""")
def evaluation_rubrics(spark, sf_dir):
    table = P.rubrics(spark)
    e = D.read(spark, sf_dir, "events").select(P.cycled(W.CATEGORIES, F.col("event_id")).alias("task_category"), _level(F.col("user_id")).alias("difficulty"))
    e = e.groupBy("task_category", "difficulty").agg(F.count(F.lit(1)).alias("n"))
    factor = table.filter("kind = 'multiplier'").select("task_category", F.col("name").alias("difficulty"), F.col("value").alias("factor"))
    x = R.rubric_join(e, table.filter("kind <> 'multiplier'"), "task_category", W.CATEGORIES[0]).join(factor, ["task_category", "difficulty"])
    return x.select("task_category", "difficulty", "kind", "name", "n", F.round(F.col("value") * F.when(F.col("kind") == "criterion", F.col("factor")).otherwise(1.0), 6).alias("value"))


JOINED = "j AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id)"


@query(f"""WITH {JOINED} SELECT conv_id, round(least(greatest(0.7 - CASE WHEN (length(t) - length(replace(t, 'for ', ''))) / 4 > 3 THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(t), 'sync.') OR contains(lower(t), 'goroutine') OR contains(lower(t), 'channel') THEN 0.2 ELSE 0 END, 0), 1), 6) AS performance,
  CASE WHEN n > 1 THEN 0.7 ELSE 0.5 END AS integration FROM j""")
def solution_heuristics(spark, sf_dir):
    c = D.read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    j = c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), " ").alias("t"), F.count(F.lit(1)).alias("n"))
    return j.select("conv_id", F.round(composite.performance(F.col("t")), 6).alias("performance"), composite.integration_by_files(F.col("n")).alias("integration"))


@query(f"""WITH {D.RESULTS} SELECT event_id, round(0.4 * software_engineering_score + 0.4 * functional_correctness_score + 0.2 * code_quality_score, 9) AS functional, round(0.3 * code_quality_score + 0.3 * software_engineering_score + 0.4 * functional_correctness_score, 9) AS quality,
  round(0.4 * functional_correctness_score + 0.3 * code_quality_score + 0.3 * longcontext_utilization_score, 9) AS style FROM r""")
def dimension_formulas(spark, sf_dir):
    se, fc, cq, lcu = (F.col(c) for c in R.SCORES[:4])
    scores = {"functional": composite.functional_of_three(se, fc, cq), "quality": composite.quality_of_three(cq, se, fc), "style": composite.style_of_three(fc, cq, lcu)}
    return D.results(spark, sf_dir).select("event_id", *[F.round(v, 9).alias(k) for k, v in scores.items()])


@query(f"""WITH {D.RESULTS}, f AS (SELECT scenario_id, model_name, min_by(total_score, event_id) AS v FROM r GROUP BY ALL) SELECT scenario_id, string_agg(model_name, ',' ORDER BY model_name) AS models, count(*) AS n, round(sum(v), 6) AS total FROM f GROUP BY scenario_id""")
def scenario_lookup(spark, sf_dir):
    x = R.scenario_lookup(D.results(spark, sf_dir), "event_id")
    return x.select("scenario_id", F.array_join("models_evaluated", ",").alias("models"), F.size("models_evaluated").cast("bigint").alias("n"), F.round(F.aggregate(F.map_values("results"), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"WITH {D.RESULTS} SELECT DISTINCT scenario_id FROM r")
def distinct_scenarios(spark, sf_dir):
    return R.distinct_scenarios(D.results(spark, sf_dir))


@query(f"WITH {D.RESULTS}, s AS (SELECT model_name, sum(CAST(parsing_success AS INT)) AS ok, count(*) AS n FROM r GROUP BY ALL) SELECT CAST(sum(ok) AS BIGINT) AS total_evaluations, round(avg(ok / n), 6) AS avg_success_rate FROM s")
def mean_success_rate(spark, sf_dir):
    return R.mean_success_rate(R.model_summary(D.results(spark, sf_dir))).select("total_evaluations", F.round("avg_success_rate", 6).alias("avg_success_rate"))


@query(f"WITH {D.RESULTS}, b AS (SELECT event_id, model_name, scenario_id FROM r WHERE NOT parsing_success) SELECT *, (SELECT count(*) FROM b) AS n_failures FROM b ORDER BY event_id LIMIT 10")
def first_failures(spark, sf_dir):
    return R.first_failures(D.results(spark, sf_dir).select("event_id", "model_name", "scenario_id", "parsing_success"), ~F.col("parsing_success"), "event_id").drop("parsing_success")


DIFFS = {f"avg_{s}": f"{s.removesuffix('_score')}_diff" for s in R.SCORES} | {"avg_time": "time_diff"}


@query(f"""WITH {D.RESULTS}, s AS (SELECT model_name, {", ".join(f"avg({c}) AS avg_{c}" for c in R.SCORES)}, avg(generation_time) AS avg_time FROM r GROUP BY model_name)
SELECT a.model_name AS model_a, b.model_name AS model_b, {", ".join(f"round(a.{c} - b.{c}, 6) AS {d}" for c, d in DIFFS.items())} FROM s a JOIN s b ON a.model_name < b.model_name""")
def pairwise_all_differences(spark, sf_dir):
    x = R.compare_all(R.model_summary(D.results(spark, sf_dir)))
    return x.select("model_a", "model_b", *[F.round(d, 6).alias(d) for d in DIFFS.values()])


@query("""WITH h AS (SELECT p_partkey, md5(concat('42-', p_partkey)) AS h FROM part), n AS (SELECT *, row_number() OVER (ORDER BY h, p_partkey) AS i, count(*) OVER () AS total FROM h),
b AS (SELECT *, CAST(floor(total * 0.3) AS INT) AS a, CAST(floor(total * 0.2) AS INT) AS c FROM n)
SELECT p_partkey, CASE WHEN i <= a THEN 'easy' WHEN i <= 2 * a THEN 'medium' WHEN i <= 2 * a + c THEN 'hard' ELSE ['easy', 'medium', 'hard'][CAST('0x' || substr(h, 4, 6) AS BIGINT) % 3 + 1] END AS level FROM b""")
def level_quotas(spark, sf_dir):
    return P.level_quotas(D.read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", {"easy": 0.3, "medium": 0.3, "hard": 0.2}).select("p_partkey", "level")


LANGUAGES = ["python", "cpp", "java", "c", "csharp", "javascript", "typescript", "go", "rust", "php"]
FACTORS = {"domain": [f"domain{k}" for k in range(7)], "architecture": [f"arch{k}" for k in range(5)], "theme": [f"theme{k}" for k in range(3)]}
PLANNED = f"""i AS (SELECT p_partkey, {LANGUAGES!r}[p_partkey % 10 + 1] AS language, p_partkey // 10 AS i FROM part), f AS (SELECT *, {", ".join(f"concat('{v[0][:-1]}', i % {len(v)}) AS {k}" for k, v in FACTORS.items())}, {LEVEL.format('i')} AS level FROM i)"""


def _planned(spark, sf_dir):
    k = F.col("p_partkey")
    rows = D.read(spark, sf_dir, "part").select("p_partkey", P.cycled(LANGUAGES, k).alias("language"), F.floor(k / 10).alias("i"))
    return P.factors(rows, F.col("i"), FACTORS).withColumn("level", _level(F.col("i")))


@query(f"WITH {PLANNED} SELECT p_partkey, domain, architecture, theme, printf('%s_%s_%s_%03d', language, domain, level, i) AS project_id FROM f")
def project_factors(spark, sf_dir):
    x = _planned(spark, sf_dir)
    return x.select("p_partkey", *FACTORS, P.project_id(F.col("language"), F.col("domain"), F.col("level"), F.col("i")).alias("project_id"))


@query(f"WITH {PLANNED}, d AS (SELECT language, domain, level, architecture, theme, count(*) AS n FROM f GROUP BY ALL) SELECT language, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_distinct, sum(n) = count(*) AS \"unique\" FROM d GROUP BY language")
def factor_uniqueness(spark, sf_dir):
    return P.uniqueness(_planned(spark, sf_dir), ["language"], ["domain", "level", "architecture", "theme"])


STATS = f"{D.PAGES}, s AS (SELECT project, CASE WHEN min(page_id) % 3 = 0 THEN NULL ELSE CAST(count(*) - 1 AS BIGINT) END AS files_count, min(page_id) AS first FROM p GROUP BY project)"


def _projects(spark, sf_dir):
    p = D.pages(spark, sf_dir)
    s = p.groupBy("project").agg(F.when(F.min("page_id") % 3 != 0, F.count(F.lit(1)) - 1).alias("files_count"), F.min("page_id").alias("first"))
    return p, s


@query(f"""WITH {STATS}, m AS (SELECT DISTINCT project, path FROM p EXCEPT SELECT project, path FROM p WHERE page_id % 7 <> 0) SELECT project, files_count, (files_count IS NOT NULL OR first % 2 = 0) AND coalesce(files_count, 0) > 0 AND project NOT IN (SELECT project FROM m) AS completed FROM s""")
def completed_projects(spark, sf_dir):
    p, s = _projects(spark, sf_dir)
    return P.completed(s.select("project", "files_count"), p, p.filter("page_id % 7 <> 0"), s.filter("first % 2 = 0").select("project"))


@query(f"WITH {STATS} SELECT project, files_count FROM s WHERE files_count > 0")
def usable_projects(spark, sf_dir):
    return P.usable(_projects(spark, sf_dir)[1]).select("project", "files_count")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE CAST(greatest(1, c_custkey // 37) AS INT) END AS instances FROM customer")
def instances_per_project(spark, sf_dir):
    target = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey"))
    return D.read(spark, sf_dir, "customer").select("c_custkey", P.instances_per_project(target, F.lit(37)).alias("instances"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def skip_existing(spark, sf_dir):
    planned = D.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return P.not_existing(planned, D.read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0"), ["c_custkey"]).select("o_orderkey")


SIZES = "VALUES ('easy', 10, 15, 10000, 100000), ('medium', 15, 40, 100000, 200000), ('hard', 40, 80, 200000, 500000), ('expert', 80, 100, 500000, 1000000)"


@query(f"""WITH z(level, a, b, c, d) AS ({SIZES}), e AS (SELECT event_id, {LEVEL.format('user_id')} AS level FROM events) SELECT event_id, a AS min_files, b AS max_files, c AS min_tokens, d AS max_tokens, a + CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % (b - a + 1) AS target_files FROM e JOIN z USING (level)""")
def project_sizes(spark, sf_dir):
    x = D.read(spark, sf_dir, "events").select("event_id", P.size_ranges(_level(F.col("user_id"))).alias("z")).select("event_id", "z.*")
    return x.withColumn("target_files", P.seeded_between(F.col("min_files"), F.col("max_files"), F.col("event_id").cast("string")))


ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


@query(rf"""WITH {D.FILES}, l AS (SELECT project, pos, content, len(regexp_extract_all(content, '{ENDS}')) + CASE WHEN content = '' OR regexp_matches(content[-1], '{ENDS}') THEN 0 ELSE 1 END AS n FROM f WHERE pos % 5 <> 0),
g AS (SELECT project, count(*) AS files_created, CAST(sum(n) AS BIGINT) AS lines_created, CAST(sum(length(content)) AS BIGINT) AS chars_created, CAST(count_if(pos % 3 = 0) AS BIGINT) AS first_try, CAST(count_if(pos % 3 > 0) AS BIGINT) AS after_retry FROM l GROUP BY project),
w AS (SELECT project, count(*) AS n_planned FROM f WHERE project IS NOT NULL GROUP BY project)
SELECT project, n_planned, coalesce(files_created, 0) AS files_created, coalesce(lines_created, 0) AS lines_created, coalesce(chars_created, 0) AS chars_created, coalesce(first_try, 0) AS first_try, coalesce(after_retry, 0) AS after_retry, n_planned - coalesce(files_created, 0) AS skipped,
  round(coalesce(files_created, 0) / n_planned, 6) AS success_rate, coalesce(files_created, 0) < 0.5 * n_planned AS short FROM w LEFT JOIN g USING (project)""")
def generation_statistics(spark, sf_dir):
    f = D.files(spark, sf_dir)
    planned = f.filter("project is not null").groupBy("project").agg(F.count(F.lit(1)).alias("n_planned"))
    x = P.generation_statistics(f.filter("pos % 5 <> 0").withColumn("retry_count", F.col("pos") % 3), planned)
    return x.withColumn("success_rate", F.round("success_rate", 6))


FEATURES = ["user_login", "search", "reports", "exports", "alerts", "sync", "audit", "themes", "backup", "import", "sharing"]


@query(f"""WITH e AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 WHEN 2 THEN 0.9 ELSE 1.0 END AS s FROM events), n AS (SELECT event_id, CAST(greatest(3, floor(11 * s)) AS BIGINT) AS n_features, CAST(greatest(2, floor(4 * s)) AS BIGINT) AS n_patterns FROM e),
x AS (SELECT event_id, u.f, row_number() OVER (PARTITION BY event_id ORDER BY md5(concat(event_id, '-', u.f))) AS i, n_features, n_patterns FROM n, (SELECT unnest({FEATURES!r}) AS f) u)
SELECT event_id, n_features, n_patterns, string_agg(f, ',' ORDER BY i) AS features FROM x WHERE i <= n_features GROUP BY ALL""")
def project_templates(spark, sf_dir):
    x = D.read(spark, sf_dir, "events").select("event_id", P.template_sizes(_level(F.col("user_id")), F.lit(len(FEATURES)), F.lit(4)).alias("z"))
    own = P.template(F.array(*[F.lit(f) for f in FEATURES]), F.col("z.features"), F.col("event_id").cast("string"))
    return x.select("event_id", F.col("z.features").alias("n_features"), F.col("z.patterns").alias("n_patterns"), F.array_join(own, ",").alias("features"))


MESSAGES = {"Security Token Expired": "auth_expired", "403 Forbidden": "auth", "ThrottlingException: slow down": "throttle", "Too Many Tokens in request": "throttle", "HTTP 503": "transient", "Rate limit reached": "transient", "cannot parse": "unknown"}
SAID = f"m(k, message, kind) AS ({_values((k, m, x) for k, (m, x) in enumerate(MESSAGES.items()))})"


@query(f"""WITH {SAID}, e AS (SELECT event_id, message, kind, event_id // 7 % 4 AS attempt FROM events JOIN m ON k = event_id % 7)
SELECT event_id, kind, CAST(CASE WHEN attempt >= 2 OR kind IN ('auth', 'auth_expired', 'unknown') THEN NULL WHEN kind = 'throttle' THEN least(power(3.0, attempt), 120) ELSE least(power(2.0, attempt), 60) END AS DOUBLE) AS delay FROM e""")
def error_kinds(spark, sf_dir):
    e = D.read(spark, sf_dir, "events").select("event_id", P.cycled(list(MESSAGES), F.col("event_id")).alias("message"), (F.floor(F.col("event_id") / 7) % 4).alias("attempt"))
    return e.select("event_id", P.error_kind(F.col("message")).alias("kind"), P.after_error(F.col("message"), F.col("attempt")).alias("delay"))


MODELS = {"o3-mini": 100000, "GPT-5-large": 128000, "gpt-4.1": 32768, "gpt-4o-mini": 16384, "gpt-4": 8192, "gemini-2.5-flash-lite": 65000, "gemini-2.5-pro": 64000, "gemini-2.5-x": 32000, "gemini-1.5-pro": 8192, "other": 8192}


@query(f"""WITH m(k, model, token_limit) AS ({_values((k, m, x) for k, (m, x) in enumerate(MODELS.items()))}) SELECT model, token_limit, count(*) AS n FROM events JOIN m ON k = event_id % 10 GROUP BY ALL""")
def token_limits(spark, sf_dir):
    e = D.read(spark, sf_dir, "events").groupBy(P.cycled(list(MODELS), F.col("event_id")).alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("model", P.token_limit(F.col("model")).alias("token_limit"), "n")


@query(f"""WITH c(task_category, focus) AS ({_values(W.CATEGORY_FOCUS.items())}), e AS (SELECT event_id, CASE WHEN event_id % 9 = 8 THEN 'other' ELSE {CATEGORY.format('(event_id % 9)')} END AS task_category, {LEVEL.format('user_id')} AS difficulty FROM events)
SELECT event_id, coalesce(focus, 'software development best practices') AS focus, difficulty IN ('hard', 'expert') AS retrieves FROM e LEFT JOIN c USING (task_category)""")
def scenario_focus(spark, sf_dir):
    category = P.cycled([*W.CATEGORIES, "other"], F.col("event_id"))
    return D.read(spark, sf_dir, "events").select("event_id", P.category_focus(category).alias("focus"), P.retrieves(_level(F.col("user_id"))).alias("retrieves"))


def _go(k):
    return F.concat(F.lit('package main\nimport "lib'), k, F.lit('"\nimport `raw'), k, F.lit("`\ntype T"), k, F.lit(" struct {\ntype I"), k, F.lit(" interface {\ntype N"), k, F.lit(" int\nfunc (r *T"), k, F.lit(") Do"), k, F.lit("(a int, b string) {\n  if x { for i := y"), k, F.lit("\n  var v"), k, F.lit(" = 1\n  switch v { case 1:\n}\nfunc main() {"))


@query("""WITH k AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part) SELECT p_partkey, concat('Do', k, ',main') AS functions, concat('T', k, ',I', k) AS types, concat('lib', k, ',raw', k) AS imports, concat('y', k, ',v', k) AS variables, 5 AS complexity, 12 AS total_lines FROM k""")
def go_facts(spark, sf_dir):
    x = D.read(spark, sf_dir, "part").select("p_partkey", ast_facts.parse_go(_go(F.col("p_partkey").cast("string"))).alias("g"))
    return x.select("p_partkey", *[F.array_join(f"g.{c}", ",").alias(c) for c in ("functions", "types", "imports", "variables")], "g.complexity", "g.total_lines")


def _javascript(k):
    return F.concat(F.lit("import a from 'm"), k, F.lit("'\nconst r"), k, F.lit(" = require('q"), k, F.lit("'); import('d"), k, F.lit("')\nfunction f"), k, F.lit("(x) {\nconst g"), k, F.lit(" = async (y) => {\nobj"), k, F.lit(": function () {\nclass C"), k, F.lit(" {\n  m"), k, F.lit("(z) {\nlet s = 'if"), k, F.lit(" while';"))


@query("""WITH k AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part) SELECT p_partkey, concat('f', k, ',g', k, ',obj', k, ',m', k) AS functions, concat('C', k) AS classes, concat('m', k, ',q', k, ',d', k) AS imports, concat('r', k, ',g', k, ',s') AS variables, 2 AS complexity, 8 AS total_lines FROM k""")
def javascript_facts(spark, sf_dir):
    x = D.read(spark, sf_dir, "part").select("p_partkey", ast_facts.parse_javascript(_javascript(F.col("p_partkey").cast("string"))).alias("g"))
    return x.select("p_partkey", *[F.array_join(f"g.{c}", ",").alias(c) for c in ("functions", "classes", "imports", "variables")], "g.complexity", "g.total_lines")


@query("""WITH k AS (SELECT p_partkey, p_partkey % 3 AS k FROM part) SELECT p_partkey, k = 2 AS unused FROM k""")
def unused_imports(spark, sf_dir):
    text = F.element_at(F.array(F.lit("import os.path\nos.path.join()"), F.lit("from a import b, c\nb(c)"), F.lit("from a import  b  as   d\nd()")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return D.read(spark, sf_dir, "part").select("p_partkey", T.unused_imports(text).alias("unused"))


DEPTHS = graphs.SQL["dep_depth"].rsplit("SELECT project, node, max(depth)", 1)[0]


@query(f"""{DEPTHS}, cy AS (SELECT a.src AS node, min(a.dst) AS cycle FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY ALL)
SELECT 'parts' AS project, (SELECT count(*) FROM part) AS total_files, (SELECT count(DISTINCT src) FROM e) AS files_with_dependencies, (SELECT count(DISTINCT cycle) FROM cy) AS circular_dependency_count, CASE WHEN (SELECT count(*) FROM l) > 0 THEN -1 ELSE (SELECT max(depth) FROM d) END AS max_dependency_depth""")
def dependency_report(spark, sf_dir):
    files = D.read(spark, sf_dir, "part").select(F.lit("parts").alias("project"), F.col("p_partkey").alias("path"))
    x = graph.analysis_summary(graphs._parts(spark, sf_dir), files)
    return x.withColumn("max_dependency_depth", F.when(F.col("max_dependency_depth") == float("inf"), -1).otherwise(F.col("max_dependency_depth")).cast("int"))
