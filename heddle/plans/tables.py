"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import wordlists as W


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as evaluation results: users are models, event types categories, values scores."""
    e = read(spark, sf_dir, "events")
    score = lambda k: F.least(F.col("value") / k, F.lit(1.0))
    return e.select(
        "event_id",
        "ts",
        F.concat(F.lit("model_"), (F.col("user_id") % 8).cast("string")).alias("model_name"),
        F.concat(F.lit("s"), (F.col("event_id") % 500).cast("string")).alias("scenario_id"),
        F.col("event_type").alias("task_category"),
        _pick(W.DIFFICULTIES, F.col("user_id") % 4).alias("difficulty"),
        score(100).alias("software_engineering_score"),
        score(120).alias("functional_correctness_score"),
        score(90).alias("code_quality_score"),
        score(80).alias("longcontext_utilization_score"),
        F.least(F.col("value") / 20, F.lit(5.0)).alias("total_score"),
        F.col("value").alias("generation_time"),
        (F.col("event_type") != "error").alias("parsing_success"),
    )


#: The same in SQL, as a common table expression.
RESULTS = """r AS (
  SELECT event_id, ts, concat('model_', user_id % 8) AS model_name, concat('s', event_id % 500) AS scenario_id, event_type AS task_category,
    CASE user_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'expert' END AS difficulty,
    least(value / 100, 1.0) AS software_engineering_score, least(value / 120, 1.0) AS functional_correctness_score, least(value / 90, 1.0) AS code_quality_score,
    least(value / 80, 1.0) AS longcontext_utilization_score, least(value / 20, 5.0) AS total_score, value AS generation_time, event_type <> 'error' AS parsing_success
  FROM events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as project files: sources are projects."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("pos"))


FILES = "f AS (SELECT source AS project, concat('doc_', doc_id, '.txt') AS path, text AS content, doc_id AS pos FROM documents)"


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files whose names have the words that categories look for: the word at the place that the text's length gives."""
    words = F.array(*[F.lit(w) for w in NAMES])
    name = F.concat(F.element_at(words, (F.length("text") % len(NAMES) + 1).cast("int")), F.lit("_"), F.col("doc_id").cast("string"), F.lit("/"), F.element_at(words, (F.length("text") % 7 + 1).cast("int")), F.lit(".py"))
    return read(spark, sf_dir, "documents").select(F.col("source").alias("project"), name.alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("pos"))


#: Names for files: words of the categories' lists and others.
NAMES = ["main", "util", "test", "auth", "service", "error_trace", "notes", "debug_bug_issue", "Makefile", "login_token", "api_client", "readme", "state_cache", "index", "refactor_helper", "create_endpoint"]
NAMED = f"""f AS (SELECT source AS project, concat(n[1 + length(text) % {len(NAMES)}], '_', doc_id, '/', n[1 + length(text) % 7], '.py') AS path, text AS content, doc_id AS pos FROM documents, (SELECT {NAMES!r} AS n))"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as solutions: what the assistant says is code."""
    c = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select((F.col("conv_id") % 4).cast("string").alias("model"), F.col("conv_id").cast("string").alias("scenario_id"), F.col("turn").cast("int").alias("file_pos"), F.concat(F.lit("turn_"), F.col("turn").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as scenarios: what the user says, in the order of the turns, is the prompt."""
    c = read(spark, sf_dir, "conversations").filter("role = 'user'")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), " ").alias("prompt")).select(
        F.col("conv_id").cast("string").alias("scenario_id"),
        _pick(W.CATEGORIES, F.col("conv_id") % 8).alias("task_category"),
        F.lit("").alias("description"),
        "prompt",
        F.array(F.lit("src/the.py"), F.lit("le.py")).alias("context_files"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: hosts are projects, URL paths are paths."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("project"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"), F.col("html").alias("content"), F.col("page_id").alias("pos"))


PAGES = r"p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS project, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, html AS content, page_id AS pos FROM pages)"
