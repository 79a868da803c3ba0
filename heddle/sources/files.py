"""Readers and writers: scenarios, results, projects, checkpoints, configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heddle.functions import wordlists as W
from heddle.operators.results import LEGACY, migrate
from heddle.sources.staging import stage

SCENARIO = (
    "id string, task_category string, difficulty string, title string, description string, context_files array<string>, context_length bigint, task_prompt variant, "
    "expected_approach string, ground_truth string, evaluation_criteria array<string>, metadata struct<context_length:bigint,files_count:bigint,information_coverage:double,coverage_range:array<double>,generation_timestamp:string>"
)
RESULT = (
    "model_name string, scenario_id string, scenario_title string, task_category string, difficulty string, software_engineering_score double, functional_correctness_score double, code_quality_score double, "
    "longcontext_utilization_score double, total_score double, generation_time double, code_files_generated int, total_lines_generated int, parsing_success boolean, solution_code map<string,string>, timestamp string"
)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """One scenario object per file, or a file with a list under "scenarios"; raises if there is none."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.try_parse_json("value").alias("v"))
    many = F.try_variant_get("v", "$.scenarios", "array<variant>")
    rows = raw.select(F.explode(F.coalesce(many, F.array("v"))).alias("v")).select(F.from_json(F.to_json("v"), SCENARIO).alias("s")).select("s.*").filter("id is not null")
    if rows.isEmpty():
        raise FileNotFoundError(f"no scenario in {path}")
    return rows


def prompts(scenarios: DataFrame) -> DataFrame:
    """scenario_id, session, text: prompts as text or as one text per session, in the order of the names."""
    sessions = F.try_variant_get("task_prompt", "$", "map<string,string>")
    one = F.try_variant_get("task_prompt", "$", "string")
    entries = F.coalesce(F.array_sort(F.map_entries(sessions)), F.array(F.struct(F.lit("").alias("key"), one.alias("value"))))
    return scenarios.select(F.col("id").alias("scenario_id"), F.explode(entries).alias("e")).select("scenario_id", F.col("e.key").alias("session"), F.col("e.value").alias("text"))


def read_results(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines of results of any age; damaged lines are left out, or fail if strict."""
    if strict:
        return migrate(spark.read.schema(f"{RESULT}, {OLD}").option("mode", "FAILFAST").json(path))
    return observed_results(spark, path)[0]


OLD = ", ".join(f"{o} double" for names in LEGACY.values() for o in names)


def observed_results(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """What read_results() gives, and an observation of the same pass: lines, damaged (count) and sample (one such line).

    observation.get waits for the first action on the results, which should be one that reads them once: a sort, which samples
    its input before it, counts every line twice.
    """
    seen = Observation("lines")
    bad = F.col("_corrupt_record")
    rows = spark.read.schema(f"{RESULT}, {OLD}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("lines"), F.count(bad).alias("damaged"), F.min(F.substring(bad, 1, 200)).alias("sample"))
    return migrate(rows.filter(bad.isNull()).drop("_corrupt_record")), seen


def count_damaged(spark: SparkSession, path: str) -> int:
    """How many lines cannot be read, for callers that want nothing else."""
    rows, seen = observed_results(spark, path)
    rows.write.format("noop").mode("overwrite").save()
    return seen.get["damaged"]


def append_results(results: DataFrame, path: str) -> None:
    """Appends results as JSON lines; rows without scenario are refused."""
    results.filter(F.coalesce("scenario_id", F.lit("")) != "").write.mode("append").json(path)


def convert_array_to_lines(spark: SparkSession, source: str, target: str) -> None:
    """A file with one JSON array of results becomes JSON lines in a new place."""
    spark.read.option("multiLine", True).json(source).write.json(target)


def read_project_files(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    """project, path, content of root/<project>/**; with listed(project, path), only those files."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), r".*?" + root.rstrip("/").split("/")[-1] + r"/([^/]+)/(.*)$", 1).alias("project"), F.regexp_extract(F.input_file_name(), r".*?" + root.rstrip("/").split("/")[-1] + r"/([^/]+)/(.*)$", 2).alias("path"), F.col("value").alias("content"))
    return files.join(listed.select("project", "path"), ["project", "path"], "left_semi") if listed is not None else files


def write_projects(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").partitionBy("project").parquet(path)


def context_files(scenarios: DataFrame, files: DataFrame) -> DataFrame:
    """Files that scenarios(scenario_id, project, context_files) name; content is null where a file is missing."""
    wanted = scenarios.select("scenario_id", "project", F.posexplode("context_files").alias("file_pos", "path"))
    return wanted.join(files.select("project", "path", "content"), ["project", "path"], "left")


def tree_paths(trees: DataFrame, tree: str = "file_structure") -> DataFrame:
    """Leaf paths of nested objects (VARIANT), joined by slashes; an object is a folder, anything else a file.

    Level after level, each staged, until no folder is left.
    """
    keep = [c for c in trees.columns if c != tree]
    row = F.struct(*keep) if keep else F.struct(F.lit(0))
    level, out = trees.select(row.alias("row"), F.lit("").alias("path"), F.col(tree).alias("v")), None
    while True:
        opened = level.withColumn("m", F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.try_variant_get("v", "$", "map<string,variant>")))
        leaves = opened.filter("m is null and path <> ''").select(*[F.col("row")[c].alias(c) for c in keep], "path")
        out = leaves if out is None else out.unionByName(leaves)
        level = opened.filter("m is not null").select("row", "path", F.explode("m").alias("k", "v")).select("row", F.concat_ws("/", F.nullif("path", F.lit("")), "k").alias("path"), "v")
        level = stage(level, "tree")
        if level.isEmpty():
            return out


def save_state(state: DataFrame, path: str) -> None:
    """Snapshot of a checkpoint table; the one before is replaced."""
    state.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last snapshot, or an empty table if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


#: The languages that projects are made in.
LANGUAGES = ["python", "cpp", "java", "c", "csharp", "javascript", "typescript", "go", "rust", "php"]


@dataclass
class Config:
    """Settings with the checks that keep them usable."""

    languages: list[str] = field(default_factory=lambda: list(LANGUAGES))
    categories: list[str] = field(default_factory=lambda: list(W.CATEGORIES))
    total_instances: int = 8000
    projects_per_language: int = 100
    min_files: int = 10
    max_files: int = 100
    weights: dict[str, float] = field(default_factory=lambda: dict(W.DIMENSION_WEIGHTS))
    coverage: dict[str, tuple[float, float]] = field(default_factory=lambda: {n: (a, b) for n, a, b in W.COVERAGE_RANGES})
    chunk_size: int = 512
    top_k: int = 5
    retry_limit: int = 10

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON or YAML file (YAML where its library is there); unknown keys are refused."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls(**(yaml.safe_load(text) or {}))
        return cls(**json.loads(text))

    def problems(self) -> list[str]:
        out = []
        if abs(sum(self.weights.values()) - 1) > 0.01:
            out.append("weights do not add up to 1")
        if not 0 < self.min_files <= self.max_files:
            out.append("file counts are out of order")
        if any(not 0 <= a < b <= 1 for a, b in self.coverage.values()):
            out.append("a coverage range is not within 0 and 1")
        if self.total_instances != len(self.languages) * self.projects_per_language * len(self.categories):
            out.append("languages, projects and categories do not give the total")
        if min(self.chunk_size, self.top_k, self.retry_limit) < 1:
            out.append("sizes and limits must be positive")
        return out


def report(summary: DataFrame, comparison: DataFrame, path: str) -> None:
    """One JSON row with the ranking and the pairwise comparison."""
    a = summary.agg(F.array_sort(F.collect_list(F.struct(*summary.columns))).alias("ranking"))
    b = comparison.agg(F.array_sort(F.collect_list(F.struct(*comparison.columns))).alias("comparison"))
    a.crossJoin(b).coalesce(1).write.mode("overwrite").json(path)


def markdown(board: DataFrame, score: str = "avg_total_score") -> str:
    """Ranking of models (one row each) as a table; se_ok marks engineering scores above 0.3."""
    rows = [f"| {r['rank']} | {r['model_name']} | {r[score]:.3f} | {r['grade']} | {'✅' if (r['avg_software_engineering_score'] or 0) > 0.3 else '❌'} |" for r in board.orderBy("rank").toLocalIterator()]
    return "\n".join(["| rank | model | score | grade | SE |", "| --- | --- | --- | --- | --- |", *rows, ""])


def create_folders(spark: SparkSession, base: str, names: tuple[str, ...] = ("scenarios", "validation", "references")) -> list[str]:
    """Makes base and its folders, where missing, in whatever store base is in; returns their paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made = [f"{base.rstrip('/')}/{n}" for n in names]
    for folder in [base, *made]:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(conf).mkdirs(place)
    return made
