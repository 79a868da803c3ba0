"""Planning of generated projects and scenarios as data: quotas, factors, sizes, what is done, error kinds, limits, rubrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def cycled(names: list[str], index: Column) -> Column:
    """names[index modulo their number]."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(index, F.lit(len(names))) + 1).cast("int"))


def level_quotas(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """rows with level: each level has int(total * share) rows, chosen by a seeded hash; rows left over get one by hash.

    Every row's number in the order of the hash comes from two levels of counts, by the hash's first digits and inside
    them, so no task orders all rows.
    """
    from pyspark.sql import Window

    total = rows.count()
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    x = rows.withColumns({"_h": digest, "_b": F.substring(digest, 1, 3)})
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # 4,096 rows at most
    x = x.join(F.broadcast(starts), "_b").withColumn("_i", F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    level, end = None, 0
    for name, share in shares.items():
        end += int(total * share)
        hit = F.col("_i") <= end
        level = F.when(hit, name) if level is None else level.when(hit, name)
    spare = cycled(list(shares), F.conv(F.substring("_h", 4, 6), 16, 10).cast("bigint"))
    return x.withColumn("level", F.coalesce(level, spare)).drop("_h", "_b", "_start", "_i")


def factors(rows: DataFrame, number: Column, lists: dict[str, list[str]]) -> DataFrame:
    """rows with one value of each list, by the row's number in turn."""
    return rows.withColumns({name: cycled(values, number) for name, values in lists.items()})


def project_id(language: Column, domain: Column, level: Column, number: Column) -> Column:
    return F.format_string("%s_%s_%s_%03d", language, domain, level, number)


def uniqueness(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Per group the number of rows, of distinct keys, and whether all are distinct; counts are aggregated before the distinct."""
    once = rows.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_n"))
    out = once.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
    return out.withColumn("unique", F.col("n") == F.col("n_distinct"))


def completed(projects: DataFrame, expected: DataFrame, existing: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """projects(project, files_count) with completed: recorded as done or with statistics, no expected file missing, some file made.

    expected and existing are (project, path); done is (project).
    """
    missing = expected.select("project", "path").join(existing.select("project", "path"), ["project", "path"], "left_anti").select("project").distinct().withColumn("_missing", F.lit(True))
    x = projects.join(missing, "project", "left")
    recorded = F.col("files_count").isNotNull()
    if done is not None:
        x = x.join(done.select("project").distinct().withColumn("_done", F.lit(True)), "project", "left")
        recorded = recorded | F.coalesce("_done", F.lit(False))
    ok = recorded & F.col("_missing").isNull() & (F.coalesce("files_count", F.lit(0)) > 0)
    return x.withColumn("completed", ok).drop("_missing", "_done")


def usable(projects: DataFrame) -> DataFrame:
    """Projects with statistics and at least one file."""
    return projects.filter(F.coalesce("files_count", F.lit(0)) > 0)


def instances_per_project(target: Column, n_projects: Column, otherwise: int = 2) -> Column:
    """Whole instances of a category per project, at least one; so many for a category without a target."""
    return F.when(target.isNull(), otherwise).otherwise(F.greatest(F.lit(1), F.floor(target / n_projects))).cast("int")


def not_existing(planned: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(existing.select(*keys).distinct(), keys, "left_anti")


def size_ranges(level: Column, min_files: int = 10, max_files: int = 100) -> Column:
    """Struct of the least and greatest number of files and of tokens of a project of that level."""
    out = None
    for name, (low, high, a, b) in W.PROJECT_SIZES.items():
        made = F.struct(F.lit(max(low, min_files)).alias("min_files"), F.lit(min(max_files, high or max_files)).alias("max_files"), F.lit(a).alias("min_tokens"), F.lit(b).alias("max_tokens"))
        out = F.when(level == name, made) if out is None else out.when(level == name, made)
    return out


def seeded_between(low: Column, high: Column, seed: Column) -> Column:
    """A whole number from low to high, by a hash of the seed."""
    return low + F.pmod(F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint"), high - low + 1)


LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def split_lines(c: Column) -> Column:
    """Number of lines, of which the last may lack its end."""
    ends = F.regexp_count(c, F.lit(LINE_ENDS))
    return ends + F.rlike(c, F.lit(r"[^\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]\z")).cast("int")


def generation_statistics(files: DataFrame, planned: DataFrame, project: str = "project") -> DataFrame:
    """Per project, from files(project, content, retry_count) and planned(project, n_planned): files, lines, characters,
    first tries, successes after a retry, skipped files, success rate, and whether under half of the plan came out."""
    x = files.groupBy(project).agg(
        F.count(F.lit(1)).alias("files_created"), F.sum(split_lines(F.col("content"))).alias("lines_created"), F.sum(F.length("content")).alias("chars_created"),
        F.count_if(F.coalesce("retry_count", F.lit(0)) == 0).alias("first_try"), F.count_if(F.col("retry_count") > 0).alias("after_retry"),
    )
    x = planned.join(x, project, "left").na.fill(0)
    return x.withColumns({"skipped": F.col("n_planned") - F.col("files_created"), "success_rate": T.ratio(F.col("files_created"), F.col("n_planned")), "short": F.col("files_created") < 0.5 * F.col("n_planned")})


def template_sizes(level: Column, n_features: Column, n_patterns: Column) -> Column:
    """How many features and patterns a template of that level takes."""
    share = F.when(level == "easy", 0.5).when(level == "medium", 0.7).when(level == "hard", 0.9).otherwise(1.0)
    return F.struct(F.greatest(F.lit(3), F.floor(n_features * share)).alias("features"), F.greatest(F.lit(2), F.floor(n_patterns * share)).alias("patterns"))


def template(features: Column, n: Column, seed: Column) -> Column:
    """n of the features, by a seeded hash: reruns agree."""
    keyed = F.array_sort(F.transform(features, lambda f: F.struct(F.md5(F.concat(seed, F.lit("-"), f)).alias("h"), f.alias("f"))))
    return F.slice(F.transform(keyed, lambda x: x["f"]), F.lit(1), n.cast("int"))


def error_kind(message: Column) -> Column:
    """auth_expired and auth (fatal), throttle and transient (to be tried again), else unknown (fatal)."""
    low = F.lower(message)
    return (
        F.when(T.any_of(low, W.AUTH_ERRORS), F.when(F.contains(low, F.lit("expired")), "auth_expired").otherwise("auth"))
        .when(T.any_of(low, W.RETRYABLE_ERRORS), F.when(T.any_of(low, W.THROTTLE_ERRORS), "throttle").otherwise("transient"))
        .otherwise("unknown")
    )


def after_error(message: Column, attempt: Column, tries: int = 3, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds to wait before the next attempt (counted from 0); null if there is none."""
    from heddle.operators.results import backoff_delay

    kind = error_kind(message)
    known = F.when(kind.isin("throttle", "transient"), kind).otherwise(F.lit("fatal"))
    return F.when(attempt < tries - 1, backoff_delay(attempt, known, base, most))


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """The table's value for the key, else that of the default key."""
    return F.coalesce(F.try_element_at(_table(table), key), F.lit(table[default]))


def token_limit(model: Column, limits: list[tuple[str, int]] = W.TOKEN_LIMITS, otherwise: int = W.TOKEN_LIMIT) -> Column:
    """Output limit of a model by the first prefix of its name that fits."""
    low = F.lower(model)
    first, *rest = limits
    return reduce(lambda w, p: w.when(low.startswith(p[0]), p[1]), rest, F.when(low.startswith(first[0]), first[1])).otherwise(otherwise)


def category_focus(category: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(W.CATEGORY_FOCUS), category), F.lit(W.OTHER_FOCUS))


def retrieves(difficulty: Column, enabled: bool = True, levels: list[str] = W.RETRIEVAL_LEVELS) -> Column:
    """Whether a scenario of that difficulty gets retrieved context."""
    return F.lit(enabled) & F.lower(F.coalesce(difficulty, F.lit(""))).isin(levels)


def rubrics(spark: SparkSession) -> DataFrame:
    """task_category, kind (criterion, weight, multiplier), name, value of the eight rubrics."""
    rows = []
    for category, (criteria, weights, multipliers) in W.RUBRICS.items():
        rows += [(category, "criterion", k, float(v)) for k, v in criteria.items()]
        rows += [(category, "weight", k, v) for k, v in weights.items()]
        rows += [(category, "multiplier", k, v) for k, v in zip(W.DIFFICULTIES, multipliers, strict=True)]
    return spark.createDataFrame(rows, "task_category string, kind string, name string, value double")
