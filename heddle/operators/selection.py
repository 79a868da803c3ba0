"""Choosing context files: relevance, coverage prefixes, retries over targets, file types, project constraints.

Files are files(project, path, content, pos); pos tells a project's files apart.  Ranks and running sums are in two levels
(heddle.operators.ranges), so no window holds a whole project.  Texts are measured, then left where they are: what is
selected comes without its content, which a join by project and path brings back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W
from heddle.operators.ranges import running
from heddle.sources.staging import stage


def is_core(path: Column, category: str, compat: bool = False) -> Column:
    """Whether the path has one of the category's core names; compat keeps names with capitals from ever matching."""
    words = W.CORE_FILES.get(category, ["main.", "app.", "index."])
    return T.any_of(F.lower(path), words if compat else [w.lower() for w in words])


def name_relevance(path: Column, category: str) -> Column:
    return F.least(T.hits(F.lower(path), W.RELEVANT_WORDS.get(category, ["\0"])).cast("double"), F.lit(5.0))


def relevance(path: Column, content: Column, category: str, aggressive: bool = False) -> Column:
    size, effort = _content_parts(content)
    return name_relevance(path, category) + size + effort + (0.5 * F.least(F.length(content) / 10_000, F.lit(1.0)) if aggressive else F.lit(0.0))


def _content_parts(content: Column) -> tuple[Column, Column]:
    """What length and effort add to the relevance, in every category."""
    return 0.3 * F.least(F.length(content) / 10_000, F.lit(1.0)), 0.2 * T.file_complexity(content)


def _score(category: str, aggressive: bool = False) -> Column:
    return F.round(relevance(F.col("path"), F.col("content"), category, aggressive), 6)


def _size() -> Column:
    return F.length(F.coalesce("content", F.lit("")))


def rank_files(files: DataFrame, category: str, aggressive: bool = False, project: str = "project") -> DataFrame:
    """score and rank (from 1 per project) of each file, by score, then pos."""
    # Staged, as the sort into ranges reads its rows twice.
    return _ranked(stage(files.withColumn("score", _score(category, aggressive)).drop("content"), "scored"), [project])


def _ranked(scored: DataFrame, groups: list[str]) -> DataFrame:
    out = running(scored, groups, [F.desc("score"), F.col("pos")], {"rank": F.lit(1)})
    return out.withColumn("rank", (F.col("rank") + 1).cast("int")).drop("rank_total")


def rank_by_category(files: DataFrame, categories: list[str], project: str = "project") -> DataFrame:
    """category, project, path, pos, core, score and rank of each file in each category; texts are gone through once for all."""
    size, effort = _content_parts(F.col("content"))
    parts = stage(files.select(project, "path", "pos", size.alias("_size"), effort.alias("_effort")), "parts")
    path = F.col("path")
    views = [F.struct(F.lit(c).alias("category"), is_core(path, c).alias("core"), F.round(name_relevance(path, c) + F.col("_size") + F.col("_effort"), 6).alias("score")) for c in categories]
    return _ranked(parts.select(project, "path", "pos", F.inline(F.array(*views))), ["category", project])


def information_coverage(files: DataFrame, chosen: Column, project: str = "project") -> DataFrame:
    """Per project the share of characters that the chosen files hold, at most 1; 0 for empty projects."""
    n = F.length(F.coalesce("content", F.lit("")))
    return files.groupBy(project).agg(F.least(T.ratio(F.sum(F.when(chosen, n).otherwise(0)), F.sum(n)), F.lit(1.0)).alias("information_coverage"))


def _ahead(files: DataFrame, order: list[Column], core: Column, project: str = "project") -> DataFrame:
    """files without content, with core, size, and the share of the project's characters that lies before each (core files first)."""
    x = files.withColumns({"size": _size(), "core": F.coalesce(core, F.lit(False))})
    x = running(stage(x.drop("content"), "sized"), [project], [F.desc("core"), *order], {"ahead": F.col("size")})
    return x.withColumn("share", T.ratio(F.col("ahead"), F.col("ahead_total"), 1.0))


def select_to_target(files: DataFrame, target: float, order: list[Column], core: Column, project: str = "project") -> DataFrame:
    """All core files, then the others in order, as long as what came before covers less than target of the characters."""
    x = _ahead(files, order, core, project)
    return x.filter(F.col("core") | (F.col("share") < target)).drop("size", "core", "ahead", "ahead_total", "share")


def adaptive_selection(files: DataFrame, category: str, target: float, aggressive: bool = False, project: str = "project") -> DataFrame:
    """Core files of the category, then the others by score until the target is covered."""
    scored = files.withColumn("score", _score(category, aggressive))
    return select_to_target(scored, target, [F.desc("score"), F.col("pos")], is_core(F.col("path"), category), project)


def expand_selection(files: DataFrame, chosen: Column, target: float, project: str = "project") -> DataFrame:
    """What is chosen, then the longest of the rest until the target is covered."""
    sized = files.withColumn("_length", F.length("content"))
    return select_to_target(sized, target, [F.desc("_length"), F.col("pos")], chosen, project).drop("_length")


def longest(files: DataFrame, k: int = 4, project: str = "project") -> DataFrame:
    """The k longest files of each project with their rank; each task keeps k of a project before the shuffle."""
    sized = files.withColumn("_length", F.length("content")).drop("content")
    rank = F.row_number().over(Window.partitionBy(project).orderBy(F.desc("_length"), "pos"))
    return sized.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_length")


def random_subset(files: DataFrame, most: int, seed: int = 0, project: str = "project") -> DataFrame:
    """At most so many files of a project, by a seeded hash: reruns agree."""
    rank = F.row_number().over(Window.partitionBy(project).orderBy(F.xxhash64(F.lit(seed), "path"), "path"))
    return files.withColumn("rank", rank).filter(F.col("rank") <= most)


def by_pattern(files: DataFrame, patterns: list[str], most: int, seed: int = 0, project: str = "project") -> DataFrame:
    """Files whose path has a pattern; a project without any gives a random subset."""
    hit = T.any_of(F.lower("path"), [p.lower() for p in patterns])
    w = Window.partitionBy(project)
    x = files.withColumns({"_hit": hit, "_some": F.max(hit.cast("int")).over(w), "_r": F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "path"), "path"))})
    return x.filter(F.col("_hit") | ((F.col("_some") == 0) & (F.col("_r") <= most))).drop("_hit", "_some", "_r")


def select_for_difficulty(files: DataFrame, category: str, low: float, high: float, level: str, project: str = "project") -> DataFrame:
    """Per project the first of five targets (middle, 75 %, 90 %, high, low) whose selection has the wanted level, else the first.

    The files are ranked once; as their order is the same for all targets, each one's selection follows from the share that
    lies before a file, and one aggregation measures all five.
    """
    targets = [(low + high) / 2, low + 0.75 * (high - low), low + 0.9 * (high - low), high, low]
    ranked = _ahead(files.withColumn("score", _score(category)), [F.desc("score"), F.col("pos")], is_core(F.col("path"), category), project)
    taken = F.array(*[F.col("core") | (F.col("share") < t) for t in targets])
    ranked = stage(ranked.select(project, "path", "size", "ahead_total", taken.alias("taken")), "ranked")
    got = [F.sum(F.when(F.get("taken", k), F.col("size")).otherwise(0)) for k in range(len(targets))]
    tries = ranked.groupBy(project).agg(F.array(*[F.least(T.ratio(g, F.max("ahead_total")), F.lit(1.0)) for g in got]).alias("shares"))
    tries = tries.withColumn("levels", F.array(*[T.difficulty_of_coverage(F.get("shares", k)) for k in range(len(targets))]))
    first = F.coalesce(F.nullif(F.array_position("levels", level), F.lit(0)), F.lit(1)).cast("int")
    best = tries.select(F.col(project).alias("_project"), (first - 1).alias("attempt"), F.get("shares", first - 1).alias("coverage"), F.get("levels", first - 1).alias("level"))
    out = ranked.join(best, F.col(project).eqNullSafe(F.col("_project"))).filter(F.get("taken", F.col("attempt")))
    return out.select(project, "attempt", "path", "coverage", "level")


def project_constraints(files: DataFrame, min_files: int = 10, max_files: int = 100, low: float = 0.3, high: float = 1.0, min_docs: float = 0.01, project: str = "project") -> DataFrame:
    """Per project: files, mean complexity, share of documentation, and the first constraint it breaks."""
    x = files.groupBy(project).agg(
        F.count(F.lit(1)).alias("n_files"), F.round(F.avg(T.document_complexity(F.col("content"))), 6).alias("complexity"), F.avg((T.file_type(F.col("path")) == "documentation").cast("double")).alias("doc_share")
    )
    message = (
        F.when(F.col("n_files") < min_files, "too few files")
        .when(F.col("n_files") > max_files, "too many files")
        .when(F.col("complexity") < low, "too simple")
        .when(F.col("complexity") > high, "too complex")
        .when(F.col("doc_share") < min_docs, "too little documentation")
        .otherwise("ok")
    )
    return x.withColumns({"message": message, "valid": message == "ok"})


def repository_complexity(files: DataFrame, language: str = "python", project: str = "project") -> DataFrame:
    """Per project: mean complexity measures, sums, a histogram of three bins, and one score; empty files are left out."""
    x = files.filter(F.coalesce("content", F.lit("")) != "").withColumn("c", T.simple_complexity(F.col("content"), language))
    cc = F.col("c.cyclomatic_complexity")
    out = x.groupBy(project).agg(
        F.count(F.lit(1)).alias("file_count"), F.avg(cc).alias("avg_cc"), F.avg("c.maintainability_index").alias("avg_mi"), F.avg("c.halstead_difficulty").alias("avg_halstead"),
        F.sum("c.nloc").alias("total_lines"), F.sum("c.function_count").alias("total_functions"), F.sum("c.class_count").alias("total_classes"),
        F.count_if(cc < 5).alias("low"), F.count_if((cc >= 5) & (cc < 15)).alias("medium"), F.count_if(cc >= 15).alias("high"),
    )
    return out.withColumn("complexity_score", T.complexity_score(F.col("avg_cc"), F.col("avg_mi"), F.col("avg_halstead"), F.col("total_lines")))
