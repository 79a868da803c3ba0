"""Queries over evaluation results (events) and work lists (orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import composite, results as R
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


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


DIMS = R.SCORES
AVGS = ", ".join(f"round(avg({s}), 6) AS avg_{s}" for s in DIMS)
AVG_NAMES = [f"avg_{s}" for s in DIMS]


@query(f"""WITH {D.RESULTS}
SELECT model_name, count(*) AS total_scenarios, CAST(sum(CAST(parsing_success AS INT)) AS BIGINT) AS completed, CAST(count(*) - sum(CAST(parsing_success AS INT)) AS BIGINT) AS failed,
  round(sum(CAST(parsing_success AS INT)) / count(*), 6) AS success_rate, round(sum(generation_time), 4) AS total_time, round(avg(generation_time), 6) AS avg_time, {AVGS}
FROM r GROUP BY model_name""")
def model_summary(spark, sf_dir):
    s = R.model_summary(D.results(spark, sf_dir))
    return s.select("model_name", "total_scenarios", "completed", "failed", *_r("success_rate"), F.round("total_time", 4).alias("total_time"), *_r("avg_time", *AVG_NAMES))


@query(f"""WITH {D.RESULTS}
SELECT model_name, task_category, difficulty, CAST(grouping(model_name) * 4 + grouping(task_category) * 2 + grouping(difficulty) AS BIGINT) AS level, count(*) AS n, {AVGS}
FROM r GROUP BY GROUPING SETS ((model_name), (model_name, task_category), (model_name, difficulty))""")
def summary_grouping_sets(spark, sf_dir):
    s = R.summary_sets(D.results(spark, sf_dir))
    return s.select("model_name", "task_category", "difficulty", F.col("level").cast("bigint").alias("level"), "n", *_r(*AVG_NAMES))


@query(f"""WITH {D.RESULTS}, u AS (UNPIVOT (SELECT model_name, {", ".join(DIMS)} FROM r) ON {", ".join(DIMS)} INTO NAME metric VALUE value)
SELECT model_name, metric, round(avg(value), 6) AS mean, count(value) AS n, min(value) AS least, max(value) AS greatest, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM u GROUP BY ALL""")
def metric_stats(spark, sf_dir):
    s = R.metric_statistics(D.results(spark, sf_dir), DIMS, ["model_name"])
    return s.select("model_name", "metric", *_r("mean"), "n", "least", "greatest", *_r("deviation"))


@query(f"""WITH {D.RESULTS}, u AS (UNPIVOT (SELECT model_name, {", ".join(DIMS)} FROM r) ON {", ".join(DIMS)} INTO NAME metric VALUE value),
s AS (SELECT model_name, metric, avg(value) AS mean FROM u GROUP BY ALL) SELECT model_name, round(avg(mean), 6) AS mean_of_means FROM s GROUP BY model_name""")
def metric_mean_of_means(spark, sf_dir):
    return R.mean_of_means(R.metric_statistics(D.results(spark, sf_dir), DIMS, ["model_name"]), ["model_name"]).select("model_name", *_r("mean_of_means"))


GRADE = "CASE WHEN {0} >= 4 THEN 'A (Excellent)' WHEN {0} >= 3 THEN 'B (Good)' WHEN {0} >= 2 THEN 'C (Fair)' ELSE 'F (Poor)' END"
CLASS = "CASE WHEN {0} >= 4 THEN 'excellent' WHEN {0} >= 3 THEN 'good' WHEN {0} >= 2 THEN 'fair' ELSE 'poor' END"


@query(f"""WITH {D.RESULTS}, s AS (SELECT model_name, avg(total_score) AS a FROM r GROUP BY model_name), k AS (SELECT *, row_number() OVER (ORDER BY a DESC, model_name) AS rank FROM s)
SELECT CAST(rank AS INT) AS rank, model_name, round(a, 6) AS score, {GRADE.format("a")} AS grade, {CLASS.format("a")} AS class, a >= 2 AS passed, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal FROM k""")
def leaderboard_grade(spark, sf_dir):
    b = R.leaderboard(R.model_summary(D.results(spark, sf_dir)))
    return b.select("rank", "model_name", F.round("avg_total_score", 6).alias("score"), "grade", "class", "passed", "medal")


@query(f"""WITH {D.RESULTS} SELECT event_id, total_score, {GRADE.format("total_score")} AS grade, {CLASS.format("total_score")} AS class, total_score >= 2 AS passed FROM r""")
def score_grades(spark, sf_dir):
    s = F.col("total_score")
    return D.results(spark, sf_dir).select("event_id", "total_score", T.grade(s).alias("grade"), T.classification(s).alias("class"), T.passed(s).alias("passed"))


@query(f"""WITH {D.RESULTS}, s AS (SELECT model_name, avg(total_score) AS a FROM r GROUP BY model_name)
SELECT x.model_name AS model_a, y.model_name AS model_b, round(x.a - y.a, 6) AS difference, CASE WHEN x.a = y.a THEN 'tie' WHEN x.a > y.a THEN x.model_name ELSE y.model_name END AS winner FROM s x JOIN s y ON x.model_name < y.model_name""")
def pairwise_model_diff(spark, sf_dir):
    return R.compare_models(R.model_summary(D.results(spark, sf_dir))).select("model_a", "model_b", *_r("difference"), "winner")


@query(f"""WITH {D.RESULTS}, m AS (SELECT model_name, task_category, avg(total_score) AS a FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY a DESC, task_category) AS b, row_number() OVER (PARTITION BY model_name ORDER BY a, task_category) AS w FROM m)
SELECT model_name, max(CASE WHEN b = 1 THEN task_category END) AS best, max(CASE WHEN w = 1 THEN task_category END) AS worst, round(max(a), 6) AS best_mean, round(min(a), 6) AS worst_mean FROM k GROUP BY model_name""")
def best_worst_category(spark, sf_dir):
    return R.extremes(D.results(spark, sf_dir)).select("model_name", "best", "worst", *_r("best_mean", "worst_mean"))


@query(f"""WITH {D.RESULTS}, s AS (SELECT model_name, {", ".join(f"avg({d}) AS {d}" for d in DIMS[:4])} FROM r GROUP BY model_name), u AS (UNPIVOT s ON {", ".join(DIMS[:4])} INTO NAME d VALUE v)
SELECT model_name, max_by(d, v) AS strongest, min_by(d, v) AS weakest FROM u GROUP BY model_name""")
def dimension_extremes(spark, sf_dir):
    return R.dimension_extremes(R.model_summary(D.results(spark, sf_dir)))


@query(f"""WITH {D.RESULTS}, m AS (SELECT DISTINCT model_name FROM r), s AS (SELECT DISTINCT scenario_id FROM r), d AS (SELECT DISTINCT model_name, scenario_id FROM r WHERE parsing_success)
SELECT m.model_name, s.scenario_id FROM m, s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.model_name = m.model_name AND d.scenario_id = s.scenario_id)""")
def remaining_work(spark, sf_dir):
    r = D.results(spark, sf_dir)
    return R.remaining_work(r.select("model_name").distinct(), r.select("scenario_id").distinct(), r.filter("parsing_success")).select("model_name", "scenario_id")


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'architectural_understanding' WHEN 1 THEN 'cross_file_refactoring' WHEN 2 THEN 'feature_implementation' WHEN 3 THEN 'bug_investigation' WHEN 4 THEN 'multi_session_development' WHEN 5 THEN 'code_comprehension' WHEN 6 THEN 'integration_testing' ELSE 'security_analysis' END AS task_category,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'expert' WHEN '2' THEN 'hard' WHEN '3' THEN 'medium' WHEN '4' THEN 'easy' END AS difficulty FROM orders)
SELECT o_orderkey, task_category, difficulty, CAST(10 * CASE coalesce(difficulty, 'medium') WHEN 'expert' THEN 4 WHEN 'hard' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END
  + CASE task_category WHEN 'architectural_understanding' THEN 5 WHEN 'integration_testing' THEN 4 WHEN 'multi_session_development' THEN 4 WHEN 'feature_implementation' THEN 3 WHEN 'code_comprehension' THEN 2 WHEN 'bug_investigation' THEN 2 WHEN 'security_analysis' THEN 1 ELSE 0 END AS INT) AS priority FROM o""")
def priority_queue(spark, sf_dir):
    level = F.substring("o_orderpriority", 1, 1)
    o = D.read(spark, sf_dir, "orders").select(
        "o_orderkey",
        D._pick(D.W.CATEGORIES, F.col("o_orderkey") % 8).alias("task_category"),
        F.when(level == "1", "expert").when(level == "2", "hard").when(level == "3", "medium").when(level == "4", "easy").alias("difficulty"),
    )
    return R.prioritise(o, "o_orderkey")


ATTEMPTS = "a AS (SELECT concat('m', user_id % 8) AS model_name, concat('s', event_id % 100) AS scenario_id, event_type = 'purchase' AND event_id % 7 = 0 AS success FROM events)"


def _attempts(spark, sf_dir):
    return D.read(spark, sf_dir, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("model_name"), F.concat(F.lit("s"), (F.col("event_id") % 100).cast("string")).alias("scenario_id"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 7 == 0)).alias("success"))


@query(f"""WITH {ATTEMPTS}, s AS (SELECT model_name, scenario_id, CAST(sum(CAST(NOT success AS INT)) AS BIGINT) AS failures, bool_or(success) AS ok FROM a GROUP BY ALL)
SELECT model_name, scenario_id, failures, ok OR failures >= 10 AS done, CASE WHEN ok THEN 'skip' WHEN failures >= 10 THEN 'zero' ELSE 'retry' END AS action FROM s""")
def retry_state(spark, sf_dir):
    return R.retry_state(_attempts(spark, sf_dir))


@query("""WITH e AS (SELECT event_id, event_type AS provider, ts FROM events)
SELECT event_id, provider, count(*) OVER w AS in_window, count(*) OVER w > 3 AS waits FROM e WINDOW w AS (PARTITION BY provider ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)""")
def rate_limit_window(spark, sf_dir):
    e = D.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("provider"), "ts")
    return R.rate_in_window(e, seconds=3600, limit=3).select("event_id", "provider", "in_window", "waits")


@query("""WITH e AS (SELECT event_id, event_type AS provider, ts, row_number() OVER w AS done, (epoch_us(ts) - epoch_us(first(ts) OVER w)) / 1e6 AS elapsed FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, provider, CAST(done AS INT) AS done, round(done / 2500, 6) AS share, round(elapsed / done * greatest(2500 - done, 0), 3) AS eta_seconds FROM e""")
def eta_progress(spark, sf_dir):
    e = D.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("provider"), "ts")
    return R.progress(e, 2500).select("event_id", "provider", "done", F.round("share", 6).alias("share"), F.round("eta_seconds", 3).alias("eta_seconds"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value + 1 ELSE 0.0 END AS software_engineering_score, 0.0 AS functional_correctness_score,
  CASE WHEN event_id % 2 = 0 THEN value ELSE 0.0 END AS code_quality_score, value AS longcontext_utilization_score FROM events""")
def schema_migration(spark, sf_dir):
    v, i = F.col("value"), F.col("event_id")
    old = D.read(spark, sf_dir, "events").select(i, F.when(i % 3 == 0, v).alias("software_engineering_score"), F.when(i % 3 == 1, v + 1).alias("agent_metrics_score"), F.when(i % 2 == 0, v).alias("quality_score"), v.alias("style_score"))
    return R.migrate(old).select("event_id", "software_engineering_score", F.col("functional_correctness_score").cast("double").alias("functional_correctness_score"), "code_quality_score", "longcontext_utilization_score")


@query(f"""WITH {D.RESULTS}, d(difficulty, desired) AS (VALUES ('easy', 2000), ('medium', 2000), ('hard', 2000), ('expert', 2000)), a AS (SELECT difficulty, count(*) AS actual FROM r GROUP BY difficulty)
SELECT difficulty, CAST(desired AS BIGINT) AS desired, coalesce(actual, 0) AS actual, coalesce(actual, 0) - desired AS difference, round(100 * (coalesce(actual, 0) / desired), 2) AS percent, abs(coalesce(actual, 0) - desired) AS deviation FROM d LEFT JOIN a USING (difficulty)""")
def difficulty_histogram(spark, sf_dir):
    return R.histogram_against(D.results(spark, sf_dir), "difficulty", dict.fromkeys(D.W.DIFFICULTIES, 2000))


@query("""WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 20 THEN 'expert' WHEN n <= 60 THEN 'hard' WHEN n <= 110 THEN 'medium' WHEN n <= 150 THEN 'easy' ELSE ['expert', 'hard', 'medium', 'easy'][1 + CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 6)) AS INT) % 4] END AS level FROM k""")
def quota_assignment(spark, sf_dir):
    docs = D.read(spark, sf_dir, "documents").select("doc_id")
    return R.quota_assignment(docs, {"expert": 20, "hard": 40, "medium": 50, "easy": 40}, "doc_id")


@query(f"""WITH {D.RESULTS}, p AS (SELECT model_name, avg(software_engineering_score) AS se, avg(functional_correctness_score) AS fc, avg(code_quality_score) AS cq, avg(longcontext_utilization_score) AS lcu FROM r GROUP BY model_name)
SELECT model_name, round(5 * (0.4 * se + 0.3 * fc + 0.2 * cq + 0.1 * lcu), 6) AS total_score FROM p""")
def lcbs_score(spark, sf_dir):
    p = D.results(spark, sf_dir).groupBy("model_name").agg(*[F.avg(s).alias(a) for s, a in zip(DIMS, ("se", "fc", "cq", "lcu"), strict=False)])
    return p.select("model_name", F.round(composite.total_score(F.col("se"), F.col("fc"), F.col("cq"), F.col("lcu")), 6).alias("total_score"))


METRICS17 = list(D.W.COMPOSITE_WEIGHTS)


@query("WITH e AS (SELECT event_id, " + ", ".join(f"least(value / {50 + 10 * k}, 1.0) AS {m}" for k, m in enumerate(METRICS17)) + " FROM events) SELECT event_id, round(5 * (" + " + ".join(f"{w} * {'(1 - average_issues)' if m == 'average_issues' else m}" for m, w in D.W.COMPOSITE_WEIGHTS.items()) + "), 6) AS composite FROM e")
def composite_17(spark, sf_dir):
    e = D.read(spark, sf_dir, "events")
    row = {m: F.least(F.col("value") / (50 + 10 * k), F.lit(1.0)) for k, m in enumerate(METRICS17)}
    return e.select("event_id", F.round(composite.composite(row), 6).alias("composite"))


@query("""WITH u(kind, criterion, weight) AS (VALUES ('click', 'accuracy', 0.6), ('click', 'depth', 0.4), ('view', 'coverage', 1.0)), e AS (SELECT event_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'view' END AS k FROM events)
SELECT event_id, event_type, criterion, CAST(weight AS DOUBLE) AS weight FROM e JOIN u ON k = kind""")
def rubric_join(spark, sf_dir):
    rubric = spark.createDataFrame([("click", "accuracy", 0.6), ("click", "depth", 0.4), ("view", "coverage", 1.0)], "event_type string, criterion string, weight double")
    return R.rubric_join(D.read(spark, sf_dir, "events").select("event_id", "event_type"), rubric, "event_type", "view")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN least(power(3.0, event_id % 8), 120.0) ELSE least(power(2.0, event_id % 8), 60.0) END AS delay FROM events""")
def retry_backoff(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "fatal").when(F.col("event_type") == "click", "throttle").otherwise("transient")
    return D.read(spark, sf_dir, "events").select("event_id", R.backoff_delay(F.col("event_id") % 8, kind).alias("delay"))


@query("""SELECT count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, round(60 * count(*) / sum(value), 6) AS per_minute, round(avg(value) * 1000 / (8 * 0.6), 6) AS projected_seconds FROM events""")
def run_throughput(spark, sf_dir):
    t = R.throughput(D.read(spark, sf_dir, "events"), "value", workers=8, planned=1000)
    return t.select("n", F.round("total", 4).alias("total"), *_r("mean"), "least", "greatest", *_r("per_minute", "projected_seconds"))


@query("""WITH c AS (SELECT event_id, ts AS last_updated, event_id % 50 AS completed, 40 AS total FROM events) SELECT event_id, epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(last_updated) < 86400000000 AND completed < total AS recoverable FROM c""")
def crash_recovery(spark, sf_dir):
    c = D.read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("last_updated"), (F.col("event_id") % 50).alias("completed"), F.lit(40).alias("total"))
    return R.crash_recovery(c, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("event_id", "recoverable")


@query("""SELECT event_id, CASE WHEN value * 20 < 60 THEN concat(CAST(floor(value * 20) AS BIGINT), 's') WHEN value * 20 < 3600 THEN concat(CAST(floor(floor(value * 20) / 60) AS BIGINT), 'm ', CAST(floor(value * 20) AS BIGINT) % 60, 's')
  ELSE concat(CAST(floor(floor(value * 20) / 3600) AS BIGINT), 'h ', CAST(floor((CAST(floor(value * 20) AS BIGINT) % 3600) / 60) AS BIGINT), 'm') END AS shown FROM events""")
def duration_text(spark, sf_dir):
    return D.read(spark, sf_dir, "events").select("event_id", T.duration(F.col("value") * 20).alias("shown"))


@query("""SELECT event_id, CASE WHEN s AND s IS NOT NULL THEN greatest(least(0.8 + CASE WHEN value < 5 THEN 0.1 ELSE 0 END - 0.05 * (event_id % 4) + CASE WHEN event_id % 3 = 0 THEN 0.1 ELSE 0 END, 1.0), 0.0)
  ELSE CASE WHEN event_id % 9 <= 2 THEN 0.3 WHEN event_id % 9 <= 5 THEN 0.1 ELSE 0.0 END END AS score FROM (SELECT *, event_type <> 'error' AS s FROM events)""")
def compilation_score(spark, sf_dir):
    i = F.col("event_id")
    many = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    size = F.when(i % 3 == 0, 1000).otherwise(20_000_000)
    score = composite.compilation(F.col("event_type") != "error", many(i % 9), many(i % 4), F.col("value"), size)
    return D.read(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))


@query("""SELECT event_id, CASE WHEN s >= 0.8 AND n = 0 THEN 'low' WHEN s >= 0.6 AND n <= 2 THEN 'medium' ELSE 'high' END AS risk_level FROM (SELECT event_id, least(value / 100, 1.0) AS s, event_id % 4 AS n FROM events)""")
def risk_level(spark, sf_dir):
    return D.read(spark, sf_dir, "events").select("event_id", T.risk_level(F.least(F.col("value") / 100, F.lit(1.0)), F.col("event_id") % 4).alias("risk_level"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS n, CASE o_orderkey % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'expert' END AS l FROM orders),
b AS (SELECT o_orderkey, CASE WHEN n < 20000 THEN 0 WHEN n < 60000 THEN 1 WHEN n < 150000 THEN 2 ELSE 3 END + CASE l WHEN 'easy' THEN -1 WHEN 'hard' THEN 1 WHEN 'expert' THEN 2 ELSE 0 END AS k FROM s)
SELECT o_orderkey, CASE WHEN k <= 0 THEN 'easy' WHEN k = 1 THEN 'medium' WHEN k = 2 THEN 'hard' ELSE 'expert' END AS difficulty FROM b""")
def difficulty_of_length(spark, sf_dir):
    level = D._pick(D.W.DIFFICULTIES, F.col("o_orderkey") % 4)
    # SQL rounds where Spark's cast cuts: halves go to the even neighbour in both with rint.
    return D.read(spark, sf_dir, "orders").select("o_orderkey", T.difficulty_of_length(F.rint("o_totalprice").cast("bigint"), level).alias("difficulty"))
