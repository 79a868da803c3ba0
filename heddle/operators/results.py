"""Evaluation results: migration, summaries, ranking, comparison, remaining work, retries, rates, progress, quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W
from heddle.operators.ranges import numbered

SCORES = ["software_engineering_score", "functional_correctness_score", "code_quality_score", "longcontext_utilization_score", "total_score"]
LEGACY = {
    "software_engineering_score": ["functional_score", "agent_metrics_score"],
    "functional_correctness_score": ["longcontext_metrics_score"],
    "code_quality_score": ["quality_score"],
    "longcontext_utilization_score": ["style_score"],
}


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def migrate(results: DataFrame, legacy: dict[str, list[str]] = LEGACY) -> DataFrame:
    """Results under today's column names: the new name wins, then the first old one present, then 0."""
    have = set(results.columns)
    olds = [o for names in legacy.values() for o in names]
    out = results.withColumns({new: F.coalesce(*[F.col(c) for c in [new, *names] if c in have], F.lit(0.0)) for new, names in legacy.items()})
    return out.drop(*[o for o in olds if o in have])


def filter_scenarios(scenarios: DataFrame, categories: list[str] | None = None, difficulties: list[str] | None = None) -> DataFrame:
    """Conjunction of the filters that are given; an empty one lets all pass."""
    out = scenarios.filter(F.col("task_category").isin(categories)) if categories else scenarios
    return out.filter(F.col("difficulty").isin(difficulties)) if difficulties else out


def _means(scores: list[str]) -> list[Column]:
    return [F.avg(s).alias(f"avg_{s}") for s in scores]


def model_summary(results: DataFrame, scores: list[str] = SCORES) -> DataFrame:
    """Per model: counts, success rate, time and mean scores."""
    done = F.sum(F.col("parsing_success").cast("int"))
    return results.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total_scenarios"),
        done.alias("completed"),
        (F.count(F.lit(1)) - done).alias("failed"),
        (done / F.count(F.lit(1))).alias("success_rate"),
        F.sum("generation_time").alias("total_time"),
        F.avg("generation_time").alias("avg_time"),
        *_means(scores),
    )


def summary_sets(results: DataFrame, scores: list[str] = SCORES) -> DataFrame:
    """Summaries by model, by model and category, and by model and difficulty, in one pass over grouping sets."""
    m, c, d = F.col("model_name"), F.col("task_category"), F.col("difficulty")
    return results.groupingSets([[m], [m, c], [m, d]], m, c, d).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *_means(scores))


def metric_statistics(results: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """Unpivoted: mean, count, least, greatest and sample deviation (0 for one value) of each metric, nulls left out."""
    keys = keys or []
    long = results.unpivot(keys, metrics, "metric", "value").filter(F.col("value").isNotNull())
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("deviation")
    )


def mean_of_means(statistics: DataFrame, keys: list[str], leave_out: tuple[str, ...] = ("average_issues",)) -> DataFrame:
    return statistics.filter(~F.col("metric").isin(*leave_out)).groupBy(*keys).agg(F.avg("mean").alias("mean_of_means"))


def leaderboard(summary: DataFrame, score: str = "avg_total_score") -> DataFrame:
    """Models ranked by score (one row per model), with grade, class, verdict and medal."""
    rank = F.row_number().over(Window.orderBy(F.desc(score), "model_name"))
    medal = F.element_at(F.array(F.lit("gold"), F.lit("silver"), F.lit("bronze")), F.least(F.col("rank"), F.lit(3)))
    return summary.withColumn("rank", rank).withColumns({"grade": T.grade(F.col(score)), "class": T.classification(F.col(score)), "passed": T.passed(F.col(score)), "medal": F.when(F.col("rank") <= 3, medal)})


def compare_models(summary: DataFrame, score: str = "avg_total_score", eps: float = 0.0) -> DataFrame:
    """Every pair of models once: difference, winner (or tie).  Rows are models, so the pairs are few."""
    a = summary.select(F.col("model_name").alias("model_a"), F.col(score).alias("score_a"))
    b = summary.select(F.col("model_name").alias("model_b"), F.col(score).alias("score_b"))
    diff = F.col("score_a") - F.col("score_b")
    winner = F.when(F.abs(diff) <= eps, "tie").when(diff > 0, F.col("model_a")).otherwise(F.col("model_b"))
    return a.join(b, F.col("model_a") < F.col("model_b")).select("model_a", "model_b", diff.alias("difference"), winner.alias("winner"))


def compare_all(summary: DataFrame, scores: list[str] = SCORES) -> DataFrame:
    """Every pair of models once, with the differences of all mean scores and of the mean time."""
    a, b = summary.alias("a"), summary.alias("b")
    columns = [f"avg_{s}" for s in scores] + ["avg_time"]
    diffs = [(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"{c.removeprefix('avg_').removesuffix('_score')}_diff") for c in columns]
    return a.join(b, F.col("a.model_name") < F.col("b.model_name")).select(F.col("a.model_name").alias("model_a"), F.col("b.model_name").alias("model_b"), *diffs)


def scenario_lookup(results: DataFrame, order: str, value: str = "total_score") -> DataFrame:
    """Per scenario the models that were run on it, by name, and the value of each one's first result."""
    first = results.groupBy("scenario_id", "model_name").agg(F.min_by(value, order).alias("v"))
    entries = F.array_sort(F.collect_list(F.struct("model_name", "v")))  # as many as there are models
    return first.groupBy("scenario_id").agg(F.transform(entries, lambda e: e["model_name"]).alias("models_evaluated"), F.map_from_entries(entries).alias("results"))


def distinct_scenarios(results: DataFrame) -> DataFrame:
    return results.select("scenario_id").distinct()


def mean_success_rate(summary: DataFrame) -> DataFrame:
    """Evaluations in all, and the mean of the models' success rates (0 for a model without scenarios)."""
    return summary.agg(F.sum("completed").alias("total_evaluations"), F.avg(T.ratio(F.col("completed"), F.col("total_scenarios"))).alias("avg_success_rate"))


def first_failures(rows: DataFrame, failed: Column, order: str, most: int = 10) -> DataFrame:
    """The first failures in the given order (as many as a report shows), each with the number of all."""
    bad = rows.filter(failed)
    return bad.orderBy(order).limit(most).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("n_failures"))))  # one row


def extremes(results: DataFrame, key: str = "task_category", score: str = "total_score") -> DataFrame:
    """Per model its best and worst group by mean score; ties go to the first by name."""
    means = results.groupBy("model_name", key).agg(F.avg(score).alias("mean"))
    return means.groupBy("model_name").agg(
        F.min(F.struct(-F.col("mean"), F.col(key).alias("k")))["k"].alias("best"), F.min(F.struct(F.col("mean"), F.col(key).alias("k")))["k"].alias("worst"), F.max("mean").alias("best_mean"), F.min("mean").alias("worst_mean")
    )


def dimension_extremes(summary: DataFrame, scores: list[str] = SCORES[:4]) -> DataFrame:
    """Per model its strongest and weakest dimension, first named on ties."""
    pairs = [F.struct(F.col(f"avg_{s}").alias("v"), F.lit(s).alias("s")) for s in scores]
    best = reduce(lambda a, b: F.when(b["v"] > a["v"], b).otherwise(a), pairs)
    worst = reduce(lambda a, b: F.when(b["v"] < a["v"], b).otherwise(a), pairs)
    return summary.select("model_name", best["s"].alias("strongest"), worst["s"].alias("weakest"))


def remaining_work(models: DataFrame, scenarios: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of model and scenario that are not done.  The result is about models times scenarios; Spark broadcasts the models
    if they are under its limit."""
    return scenarios.select("scenario_id").crossJoin(models.select("model_name")).join(done.select("model_name", "scenario_id"), ["model_name", "scenario_id"], "left_anti")


def prioritise(scenarios: DataFrame, position: str = "pos", category: str = "task_category", difficulty: str = "difficulty") -> DataFrame:
    """priority; order by it descending, then by position, for a stable queue."""
    return scenarios.withColumn("priority", T.priority(F.coalesce(F.col(category), F.lit("bug_investigation")), F.coalesce(F.col(difficulty), F.lit("medium"))))


def work_queue(scenarios: DataFrame, models: DataFrame) -> DataFrame:
    """Prioritised scenarios times models, with the place of each in the queue of its scenario."""
    return prioritise(scenarios).crossJoin(models).withColumn("slot", F.struct(-F.col("priority"), F.col("pos"), F.col("model_name")))


def retry_state(attempts: DataFrame, limit: int = 10) -> DataFrame:
    """Per model and scenario, from attempts(model_name, scenario_id, success): failures, done, and what to do next."""
    state = attempts.groupBy("model_name", "scenario_id").agg(F.sum((~F.col("success")).cast("int")).alias("failures"), F.max(F.col("success").cast("int")).alias("ok"))
    exhausted = F.col("failures") >= limit
    return state.select("model_name", "scenario_id", "failures", ((F.col("ok") == 1) | exhausted).alias("done"), F.when(F.col("ok") == 1, "skip").when(exhausted, "zero").otherwise("retry").alias("action"))


def failed_rows(state: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Zero results for pairs whose attempts are used up."""
    zero = [F.lit(0.0).alias(s) for s in SCORES]
    return state.filter("action = 'zero'").join(scenarios.select("scenario_id", "task_category", "difficulty"), "scenario_id", "left").select("model_name", "scenario_id", "task_category", "difficulty", *zero, F.lit(False).alias("parsing_success"), F.col("failures").alias("attempts"))


def rate_in_window(requests: DataFrame, key: str = "provider", ts: str = "ts", seconds: int = 60, limit: int = 600) -> DataFrame:
    """Requests of the key in the seconds up to and with each request, and whether the limit makes it wait.

    The window is a range frame per key; keys are split by time slices of the window's length, each with the slice
    before it, so a busy key is spread over tasks.
    """
    at = _micros(F.col(ts))
    width = seconds * 1_000_000
    rows = requests.withColumn("_at", at).withColumn("_slice", F.floor(at / width))
    both = rows.withColumn("_s", F.explode(F.array("_slice", F.col("_slice") + 1)))
    w = Window.partitionBy(key, "_s").orderBy("_at").rangeBetween(-width, 0)
    return both.withColumn("in_window", F.count(F.lit(1)).over(w)).filter(F.col("_s") == F.col("_slice")).withColumn("waits", F.col("in_window") > limit).drop("_at", "_slice", "_s")


def backoff_delay(attempt: Column, kind: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds to wait: null if the error is fatal, tripling for throttled calls, else doubling."""
    return F.when(kind == "fatal", F.lit(None).cast("double")).when(kind == "throttle", F.least(base * F.pow(F.lit(3.0), attempt), F.lit(2 * most))).otherwise(F.least(base * F.pow(F.lit(2.0), attempt), F.lit(most)))


def progress(log: DataFrame, total: int, ts: str = "ts", key: str = "provider") -> DataFrame:
    """Running share and expected seconds left, per key; keys are queues of their own."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    done = F.row_number().over(w)
    elapsed = (_micros(F.col(ts)) - _micros(F.first(ts).over(w))) / 1e6
    out = log.withColumns({"done": done, "elapsed": elapsed})
    return out.withColumns({"share": F.col("done") / total, "eta_seconds": F.col("elapsed") / F.col("done") * F.greatest(F.lit(total) - F.col("done"), F.lit(0))})


def quota_assignment(rows: DataFrame, targets: dict[str, int], order: str) -> DataFrame:
    """rows with level: they fill the quotas in the order given (hardest first); what is over gets a level by hash.

    Quotas are a short list of cumulative bounds, so the level is a chain of comparisons of the row's number.  Rows with
    the same place in the order, null or not, are numbered one by one.
    """
    level, end = None, 0
    for name, n in targets.items():
        end += n
        level = F.when(F.col("_n") <= end, name) if level is None else level.when(F.col("_n") <= end, name)
    names = F.array(*[F.lit(n) for n in targets])
    spare = F.get(names, F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(order).cast("string"), F.lit(""))), 1, 6), 16, 10).cast("int"), F.lit(len(targets))))
    return numbered(rows, [F.col(order)], "_n").withColumn("level", F.coalesce(level, spare)).drop("_n")


def histogram_against(rows: DataFrame, level: str, desired: dict[str, int]) -> DataFrame:
    """Actual and desired counts of each level, their difference, percentage and absolute deviation."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(desired.items()), f"{level} string, desired bigint")
    actual = rows.groupBy(level).agg(F.count(F.lit(1)).alias("actual"))
    out = want.join(actual, level, "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("bigint"))
    return out.withColumns({"difference": F.col("actual") - F.col("desired"), "percent": F.round(100 * T.ratio(F.col("actual"), F.col("desired")), 2), "deviation": F.abs(F.col("actual") - F.col("desired"))})


def throughput(runs: DataFrame, seconds: str = "seconds", efficiency: float = 0.6, workers: int = 1, planned: int = 0) -> DataFrame:
    """Time statistics of runs, their rate per minute, and the time planned items would take on so many workers."""
    return runs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("greatest"),
        (60 * F.count(F.lit(1)) / F.sum(seconds)).alias("per_minute"), (F.avg(seconds) * planned / (workers * efficiency)).alias("projected_seconds"),
    )


def crash_recovery(checkpoints: DataFrame, now: Column) -> DataFrame:
    """Whether a checkpoint is young (under 24 hours) and unfinished."""
    age = (_micros(now) - _micros(F.col("last_updated"))) / 3.6e9
    return checkpoints.withColumn("recoverable", (age < 24) & (F.col("completed") < F.col("total")))


def best_attempt(attempts: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """Per key the first attempt that hits, else its last one."""
    best = F.min(F.when(hit, F.col(order)))
    chosen = attempts.groupBy(key).agg(F.coalesce(best, F.max(order)).alias(order))
    return attempts.join(chosen, [key, order])


def rubric_join(rows: DataFrame, rubric: DataFrame, key: str, default: str) -> DataFrame:
    """Rows with their key's rubric, or the default's."""
    named = rows.withColumn("_k", F.col(key)).join(rubric.select(F.col(key).alias("_known")).distinct(), F.col("_k") == F.col("_known"), "left")
    named = named.withColumn("_k", F.coalesce("_known", F.lit(default))).drop("_known")
    return named.join(rubric.withColumnRenamed(key, "_rk"), F.col("_k") == F.col("_rk")).drop("_k", "_rk")


def nested(scenarios: DataFrame, solutions: DataFrame) -> DataFrame:
    """Scenarios with their solutions as an array, empty where there is none."""
    grouped = solutions.groupBy("scenario_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in solutions.columns if c != "scenario_id"]))).alias("solutions"))
    return scenarios.join(grouped, "scenario_id", "left").withColumn("solutions", F.coalesce("solutions", F.array().cast(grouped.schema["solutions"].dataType)))


def detect_languages(solutions: DataFrame, scenarios: list[str] = ["scenario_id"]) -> DataFrame:
    """Language of a solution: by the prefix of its id, else by its most frequent known suffix (first file on ties), else python."""
    known = sorted({*W.LANGUAGE_OF_SUFFIX.values(), "c", "rust", "php", "csharp"})
    by_id = F.when(F.split("scenario_id", "_")[0].isin(known), F.split("scenario_id", "_")[0])
    suffix = T.language_of_path(F.col("path"), "")
    counted = solutions.withColumn("_l", suffix).filter("_l <> ''").groupBy(*scenarios, "_l").agg(F.count(F.lit(1)).alias("n"), F.min("file_pos").alias("first"))
    best = counted.groupBy(*scenarios).agg(F.min(F.struct(-F.col("n"), F.col("first"), F.col("_l").alias("l")))["l"].alias("by_suffix"))
    return solutions.select(*scenarios).distinct().join(best, scenarios, "left").select(*scenarios, F.coalesce(by_id, "by_suffix", F.lit("python")).alias("language"))
