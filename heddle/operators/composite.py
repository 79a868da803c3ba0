"""Composite scores: the weighted four-dimension score, the seventeen-metric score, and what goes into them."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W


def weighted(values: dict[str, Column], weights: dict[str, float], tolerance: float = 0.01) -> Column:
    """Weighted sum; weights whose sum is off by more than the tolerance are scaled to 1."""
    total = sum(weights.values())
    scale = 1.0 if abs(total - 1) <= tolerance else 1 / total
    return reduce(add, [values[k] * (w * scale) for k, w in weights.items()])


def total_score(se: Column, fc: Column, cq: Column, lcu: Column, weights: dict[str, float] = W.DIMENSION_WEIGHTS) -> Column:
    return 5 * weighted(dict(zip(W.DIMENSION_WEIGHTS, (se, fc, cq, lcu), strict=True)), weights)


def composite(row: dict[str, Column], weights: dict[str, float] = W.COMPOSITE_WEIGHTS) -> Column:
    """Linear score of all metrics, times 5; the share of issues counts the other way round."""
    return 5 * weighted(row | {"average_issues": 1 - row["average_issues"]}, weights, tolerance=1.0)


def compilation(success: Column, errors: Column, warnings: Column, seconds: Column, binary_size: Column) -> Column:
    ok = 0.8 + F.when(seconds < 5, 0.1).otherwise(0.0) - 0.05 * F.size(warnings) + F.when((binary_size > 0) & (binary_size < 10_000_000), 0.1).otherwise(0.0)
    failed = F.when(F.size(errors) <= 2, 0.3).when(F.size(errors) <= 5, 0.1).otherwise(0.0)
    return T.clamp(F.when(success.isNull(), 0.2).when(success, ok).otherwise(failed))


def test_result(output: Column) -> Column:
    return F.when(T.any_of(output, ["PASS", "ok"]), 1.0).when(T.any_of(output, ["FAIL", "error"]), 0.0).otherwise(0.5)


def integration(n_files: Column, n_importing: Column) -> Column:
    return T.clamp(F.when(n_files > 1, 0.7).otherwise(0.3) + F.when(n_importing > 2, 0.1).otherwise(0.0))


def functional(compile_score: Column, unit: Column, integrated: Column, incremental: Column) -> Column:
    return 0.3 * compile_score + 0.3 * unit + 0.2 * integrated + 0.2 * incremental


def software_engineering(metrics: list[Column]) -> Column:
    return reduce(add, metrics) / len(metrics)


def longcontext(icu: Column, mmr: Column) -> Column:
    return 0.5 * icu + 0.5 * mmr


def longcontext_by_category(category: Column, m: dict[str, Column]) -> Column:
    """Two metrics that matter most for the category."""
    return (
        F.when(category == "architectural_understanding", 0.6 * m["acs"] + 0.4 * m["dta"])
        .when(category == "cross_file_refactoring", 0.7 * m["cfrd"] + 0.3 * m["acs"])
        .when(category == "multi_session_development", 0.6 * m["mmr"] + 0.4 * m["idc"])
        .otherwise(0.5 * m["icu"] + 0.5 * m["cfrd"])
    )


def code_quality(mean_file_quality: Column, security: Column, compat: bool = False) -> Column:
    """0.7 files + 0.3 security; compat takes the constant 0.8 that earlier scores used for security."""
    return 0.7 * mean_file_quality + 0.3 * (F.lit(0.8) if compat else security)


def style_practices(code: Column) -> Column:
    """Line lengths, one naming style, and good practices of a file."""
    long = F.size(F.filter(T.lines(code), lambda x: F.length(x) > 120)) > 0.1 * T.n_lines(code)
    snake, camel = F.regexp_count(code, F.lit(r"\b[a-z]+_[a-z]+\b")), F.regexp_count(code, F.lit(r"\b[a-z]+[A-Z][a-z]+\b"))
    mixed = F.when((snake > 0) & (camel > 0), -0.1).when((snake > 0) | (camel > 0), 0.1).otherwise(0.0)
    practices = reduce(add, [F.when(T.any_of(F.lower(code), w), 0.05).otherwise(0.0) for w in (["try", "catch", "except", "error"], ["log"], ["#", "//", '"""'], ["const", "final"])])
    return F.least(F.lit(0.8) - F.when(long, 0.2).otherwise(0.0) + mixed + practices, F.lit(1.0))


def advanced(m: dict[str, Column]) -> Column:
    return 0.23 * m["rs"] + 0.2 * m["cs"] + 0.2 * m["is"] + 0.2 * m["sts"] + 0.17 * m["ses"]


def reference_quality(approach: Column, n_files: Column, explanation: Column, n_features: Column, n_highlights: Column) -> Column:
    """Additive rubric of a reference solution."""
    return F.least(
        F.when(approach != "", 0.15).otherwise(0.0)
        + F.when(n_files > 0, 0.15).otherwise(0.0)
        + F.when(n_files > 1, 0.10).otherwise(0.0)
        + F.when(F.length(explanation) > 100, 0.15).otherwise(0.0)
        + F.when(F.length(explanation) > 500, 0.15).otherwise(0.0)
        + F.when(n_features >= 3, 0.20).when(n_features >= 1, 0.10).otherwise(0.0)
        + F.when(n_highlights >= 2, 0.10).when(n_highlights >= 1, 0.05).otherwise(0.0),
        F.lit(1.0),
    )


def score_solutions(metrics: DataFrame, checks: DataFrame) -> DataFrame:
    """metrics (of all_metrics) with checks(model, scenario_id, compile_score, unit_score, integration_score, quality, security) to dimensions and total."""
    c = F.col
    se = software_engineering([c(m) for m in ("architectural_coherence", "dependency_traversal", "cross_file_reasoning", "system_thinking", "robustness", "comprehensiveness", "innovation", "solution_elegance")])
    x = metrics.join(checks, ["model", "scenario_id"], "left").withColumns(
        {"se": se, "fc": functional(c("compile_score"), c("unit_score"), c("integration_score"), c("incremental_development")), "cq": code_quality(c("quality"), c("security")), "lcu": longcontext(c("information_coverage"), c("multi_session_memory"))}
    )
    return x.withColumn("total_score", total_score(c("se"), c("fc"), c("cq"), c("lcu")))


def test_suite(scenarios: DataFrame) -> DataFrame:
    """Descriptors of the tests a scenario gets, by its category: scenario_id, kind, name, weight."""
    made = [F.when(F.col("task_category") == only if only else F.lit(True), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(weight).alias("weight"))) for kind, name, weight, only in W.TEST_SUITE]
    return scenarios.select("scenario_id", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("t")).select("scenario_id", "t.*")


def suite_object(tests: DataFrame) -> DataFrame:
    """One row per scenario: the tests of test_suite as an array for each kind, in the order of their names."""
    kinds = list(dict.fromkeys(kind for kind, *_ in W.TEST_SUITE))
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("name", "weight")))).alias(f"{k}_tests")
    return tests.groupBy("scenario_id").agg(*[of(k) for k in kinds])


def integration_by_files(n_files: Column) -> Column:
    return F.when(n_files > 1, 0.7).otherwise(0.5)


def performance(code: Column) -> Column:
    """Base 0.7, less 0.2 for more than three loops, 0.2 more for concurrency; code is all files joined by spaces."""
    loops = F.when(T.count_of(code, "for ") > 3, 0.2).otherwise(0.0)
    return T.clamp(F.lit(0.7) - loops + F.when(T.any_of(F.lower(code), ["sync.", "goroutine", "channel"]), 0.2).otherwise(0.0))


def functional_of_three(compile_score: Column, unit: Column, integrated: Column) -> Column:
    return 0.4 * compile_score + 0.4 * unit + 0.2 * integrated


def quality_of_three(complexity: Column, security: Column, maintainable: Column) -> Column:
    return 0.3 * complexity + 0.3 * security + 0.4 * maintainable


def style_of_three(formatting: Column, naming: Column, documentation: Column) -> Column:
    return 0.4 * formatting + 0.3 * naming + 0.3 * documentation
