"""Scores of solutions: the seventeen metrics, from files(model, scenario_id, file_pos, path, content).

Every score is an aggregate over a solution's files.  Texts of a solution are never joined: what the joined text contains
is what any file contains, counts and lines add up.  So a solution is grouped once, with partial aggregation, however
many files it has.  The prompts (scenarios) are joined by scenario_id to the grouped rows, not to the files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W
from heddle.operators.ast_facts import parse_python, valid_imports

KEYS = ["model", "scenario_id"]


def _present(groups: dict[str, list[str]], low: Column) -> Column:
    """How many groups the text has a word of."""
    return reduce(add, [T.any_of(low, words).cast("int") for words in groups.values()])


def _yes(c: Column, w: float) -> Column:
    return F.when(c, w).otherwise(0.0)


def file_scores(code: Column) -> dict[str, Column]:
    """Scores of one file, as built-in expressions."""
    low = F.lower(code)
    one = F.lit(1.0)
    named = F.regexp_extract_all(code, F.lit(r"interface\s+([A-Za-z]+)"), F.lit(1))
    proper = F.filter(named, lambda n: F.rlike(n, F.lit("(er|able|Interface)$")))
    state = (
        _yes(T.any_of(low, W.STATE["immutability"]), 0.3)
        - _yes(T.any_of(low, W.STATE["shared_state"]), 0.1)
        + _yes(T.any_of(low, W.STATE["state_isolation"]), 0.3)
        + _yes(T.any_of(low, W.STATE["state_validation"]), 0.1)
        - _yes(reduce(add, [T.count_of(code, m) for m in W.MUTATIONS]) > 10, 0.2)
    )
    patterns = reduce(add, [F.least(T.hits(low, words) / len(words), F.lit(0.3)) for words in W.ARCHITECTURE.values()])
    imports = T.import_lines(code)
    compatible = reduce(add, [_yes(T.any_of(low, words), 0.1 if k == "deprecation" else 0.3) for k, words in W.COMPATIBILITY.items()])
    flow = reduce(add, [T.any_of(low, w).cast("int") for w in W.FLOW_STEPS]) / 3
    return {
        "pattern_consistency": F.least(patterns + _yes(T.separates_concerns(code), 0.3) + _yes(T.organised(code), 0.2), one),
        "file_organization": _yes(T.few_imports(code), 0.3) + _yes(T.ordered_logically(code), 0.3) + _yes(T.spaced(code), 0.2) + _yes(T.structured(code), 0.2),
        "dependency_structure": F.when(F.size(imports) > 0, _yes(T.imports_grouped(code), 0.4) + 0.3 + _yes(T.no_wildcards(code), 0.3)).otherwise(0.0),
        "dependency_order": F.when(T.imports_on_top(code), 1.0).otherwise(0.5),
        "interface_usage": F.least(0.25 * _present(W.INTERFACES, low) + 0.2 * T.ratio(F.size(proper), F.size(named)), one),
        "state_management": F.greatest(state, F.lit(0.0)),
        "coordination": F.least(0.25 * _present(W.COORDINATION, low), one),
        "modification": F.least(0.25 * _present(W.MODIFICATION, low) + _yes(T.any_of(low, ["version", "changelog"]), 0.1), one),
        "data_flow": F.least(0.2 * _present(W.DATA_FLOW, low) + 0.4 * flow, one),
        "compatibility": F.least(compatible + _yes(F.contains(low, F.lit("api")) & ~F.contains(low, F.lit("breaking")), 0.2), one),
        "reuse": F.least(0.25 * _present(W.REUSE, low), one),
        "extension": F.least(0.25 * _present(W.EXTENSION, low) + _yes(T.any_of(low, W.CONFIGURABLE), 0.15) + _yes(T.any_of(low, W.MODULAR), 0.1), one),
        "disruption": F.greatest(0.3 * T.hits(low, W.DISRUPTION["non_breaking"]) + 0.2 * T.hits(low, W.DISRUPTION["isolation"]) - 0.2 * T.hits(low, W.DISRUPTION["breaking_changes"]), F.lit(0.0)),
        "readability": T.readability(code),
    }


def _same(c: Column) -> Column:
    return c


def _held(tests: list[Column], kept: Callable[[Column], Column] = _same) -> Column:
    """Aggregate: how many of the tests any row passes; they are the bits of one number (or of several, 62 in each)."""
    masks = [reduce(add, [F.shiftleft(t.cast("bigint"), k) for k, t in enumerate(tests[i : i + 62])]) for i in range(0, len(tests), 62)]
    return reduce(add, [F.bit_count(F.bit_or(kept(m))) for m in masks])


def indicator_share(code: Column, words: list[str], kept: Callable[[Column], Column] = _same) -> Column:
    """Aggregate: share of the words that any file of the group contains."""
    low = F.lower(code)
    return _held([F.contains(low, F.lit(w)) for w in words], kept) / len(words)


def group_share(code: Column, groups: dict[str, list[str]], kept: Callable[[Column], Column] = _same) -> Column:
    """Aggregate: share of the groups that any file has a word of."""
    low = F.lower(code)
    return _held([T.any_of(low, words) for words in groups.values()], kept) / len(groups)


def density(code: Column, patterns: list[str], scale: float, kept: Callable[[Column], Column] = _same) -> Column:
    """Aggregate: matches per line, scaled, at most 1."""
    return F.least(scale * T.ratio(F.sum(kept(T.matches(code, patterns))), F.sum(kept(T.n_lines(code)))), F.lit(1.0))


def _digest() -> Column:
    """Tells files apart by path and content; nulls are no empty texts."""
    sized = lambda c: [F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.coalesce(c, F.lit(""))]
    return F.sha2(F.concat_ws(":", *sized("path"), *sized("content")), 256)


def text_metrics(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per solution: every score that needs no parser.

    What is measured of a file goes into columns of its own first, once for all files that have the same path and text; the
    solutions then add up numbers alone.
    """
    code, path = F.col("content"), F.lower("path")
    low = F.lower(code)
    measures: list[Column] = []

    def kept(c: Column) -> Column:
        """The column that holds the measure c of a file."""
        measures.append(c.alias(f"_m{len(measures)}"))
        return F.col(f"_m{len(measures) - 1}")

    per_file = {k: kept(c) for k, c in file_scores(code).items()}
    total = lambda patterns: F.sum(kept(T.matches(code, patterns)))
    some = lambda *tests: _held(list(tests), kept)
    aggregates = {k: F.avg(c) for k, c in per_file.items() if k not in ("coordination", "state_management", "disruption")}
    aggregates |= {k: F.least(F.avg(per_file[k]), F.lit(1.0)) for k in ("state_management", "disruption")}
    aggregates["shared_state"] = F.when(some(T.any_of(low, ["global", "static", "shared"])) == 1, F.avg(per_file["coordination"])).otherwise(0.8)
    managed, acquired, bad = total(W.RESOURCE_PATTERNS), total(W.ACQUISITION_PATTERNS), total(W.INEFFICIENT_PATTERNS)
    efficient = some(*[F.rlike(code, F.lit(p)) for p in W.EFFICIENT_PATTERNS]) / len(W.EFFICIENT_PATTERNS)
    issues = some(*[F.contains(low, F.lit(w)) for w in W.SECURITY_ISSUES])
    consistent = [1 / (1 + F.var_pop(kept(T.hits(low, words).cast("double")))) for words in W.APPROACH.values()]
    aggregates |= {
        "n_files": F.count(F.lit(1)),
        "n_lines": F.sum(kept(T.n_lines(code))),
        "approach_consistency": F.when(F.count(F.lit(1)) < 2, 0.8).otherwise(reduce(add, consistent) / len(consistent)),
        "input_validation": density(code, W.VALIDATION_PATTERNS, 10, kept),
        "security_practices": F.greatest(group_share(code, W.SECURITY_PRACTICES, kept) - F.least(0.2 * issues, F.lit(0.5)), F.lit(0.0)),
        "resource_management": F.when(acquired == 0, F.when(managed == 0, 1.0).otherwise(0.8)).otherwise(F.least(T.ratio(managed, acquired), F.lit(1.0))),
        "test_indication": _yes(some(F.contains(path, F.lit("test"))) == 1, 0.4) + _yes(total(W.ASSERTION_PATTERNS) > 0, 0.4) + _yes(some(T.any_of(low, W.TEST_FRAMEWORKS)) == 1, 0.2),
        "configuration": 0.25 * (some(T.any_of(path, W.CONFIG_FILES)) + some(T.any_of(code, W.ENVIRONMENT_WORDS)) + some(T.any_of(path, W.BUILD_FILES)) + some(T.any_of(low, W.DEPLOY_WORDS))),
        "algorithm_efficiency": F.greatest(efficient - F.least(0.1 * bad, F.lit(0.5)), F.lit(0.0)),
        "design_patterns": group_share(code, W.DESIGN, kept),
        "performance": density(code, W.OPTIMIZATION_PATTERNS, 20, kept),
        "modern_practices": indicator_share(code, W.MODERN, kept),
        "scalability": indicator_share(code, W.SCALABILITY, kept),
        "integration": indicator_share(code, W.INTEGRATION, kept),
        "extensibility": density(code, W.EXTENSIBILITY_PATTERNS, 10, kept),
        "has_readme": some(F.contains(path, F.lit("readme"))),
        "comment_lines": F.sum(kept(F.size(F.filter(T.lines(code), lambda x: F.startswith(T.strip(x), F.lit("#")))))),
        "func_words": F.sum(kept(T.count_of(low, "func "))),
    }
    measured = files.select("path", "content").distinct().select(_digest().alias("_digest"), *measures)
    rows = files.select(*keys, _digest().alias("_digest")).join(measured, "_digest")
    return rows.groupBy(*keys).agg(*[c.alias(k) for k, c in aggregates.items()])


def line_duplication(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """n_filled, n_distinct lines of a solution; lines are aggregated before they are shuffled."""
    own = files.select(*keys, F.explode(T.filled_lines(F.col("content"))).alias("line"))
    counted = own.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.sum("n").alias("n_filled"), F.count(F.lit(1)).alias("n_distinct"))


def dry(n: Column, distinct: Column) -> Column:
    return F.greatest(1 - 2 * T.ratio(n - distinct, n), F.lit(0.0))


def naming_mix(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Share of the most frequent naming style, times 1.2, at most 1; 0.5 without names."""
    names = files.select(*keys, F.explode(T.identifiers(F.col("content"))).alias("name")).withColumn("style", T.naming_style(F.col("name")))
    styles = names.groupBy(*keys, "style").agg(F.count(F.lit(1)).alias("n"))
    mixed = styles.groupBy(*keys).agg(F.least(1.2 * F.max("n") / F.sum("n"), F.lit(1.0)).alias("naming"))
    return files.select(*keys).distinct().join(mixed, keys, "left").na.fill({"naming": 0.5})


def naming_conflicts(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """1 less the share of name pairs, across pairs of files, that mean alike but are styled differently; 0.5 for one file.

    Names are first counted by file, root set and style (a few rows per file), so the pairs are of counts, not of names.
    """
    code = files.select(*keys, "file_pos", F.explode(T.identifiers(F.col("content"))).alias("name"))
    roots = reduce(add, [F.contains(F.lower("name"), F.lit(r)).cast("int") * (1 << k) for k, r in enumerate(W.NAME_ROOTS)])
    counted = code.groupBy(*keys, "file_pos", roots.alias("roots"), T.naming_style(F.col("name")).alias("style")).agg(F.count(F.lit(1)).alias("n"))
    a, b = counted.filter("roots > 0").alias("a"), counted.filter("roots > 0").alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    clash = a.join(b, same & (F.col("a.file_pos") < F.col("b.file_pos")) & (F.col("a.roots").bitwiseAND(F.col("b.roots")) != 0) & (F.col("a.style") != F.col("b.style")))
    clash = clash.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("clashes"))
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("names"))
    shape = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files")).join(sizes, keys, "left").join(clash, keys, "left")
    # Every name takes part in as many comparisons as there are other files.
    pairs = F.coalesce("names", F.lit(0)) * (F.col("n_files") - 1)
    return shape.select(*keys, F.when(pairs == 0, 0.5).otherwise(F.greatest(1 - F.coalesce("clashes", F.lit(0)) / pairs, F.lit(0.0))).alias("naming_across"))


def cross_references(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean over files of the share of calls whose name the solution defines or the language has."""
    word = "([a-zA-Z_][a-zA-Z0-9_]*)"
    defined = files.select(*keys, F.explode(F.concat(*[F.regexp_extract_all(F.col("content"), F.lit(rf"{k}\s+{word}"), F.lit(1)) for k in ("def", "class")])).alias("name")).distinct().withColumn("known", F.lit(1))
    calls = files.select(*keys, "file_pos", F.explode(F.regexp_extract_all(F.col("content"), F.lit(rf"{word}\s*\("), F.lit(1))).alias("name"))
    calls = calls.groupBy(*keys, "file_pos", "name").agg(F.count(F.lit(1)).alias("n")).join(defined, [*keys, "name"], "left")
    valid = F.when(F.col("known").isNotNull() | F.col("name").isin(W.BUILTIN_FUNCTIONS), F.col("n")).otherwise(0)
    per_file = calls.groupBy(*keys, "file_pos").agg((F.sum(valid) / F.sum("n")).alias("share"))
    return files.select(*keys, "file_pos").join(per_file, [*keys, "file_pos"], "left").groupBy(*keys).agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("references"))


def syntax_metrics(files: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Scores that need a Python parser: one call per file, then plain aggregates."""
    f = parse_python(files).withColumn("imports_valid", valid_imports(F.col("content")))
    x = F.col("facts")
    ok = x["ok"]
    indent = ~F.exists(F.filter(T.lines(F.col("content")), lambda v: T.strip(v) != ""), lambda v: F.length(F.regexp_extract(v, r"^(\s*)", 1)) % 4 != 0)
    naming = F.when(~ok, 0.0).otherwise(T.ratio(x["good_names"], x["n_names"], 0.5))
    length = F.greatest(1 - (T.ratio(x["function_lines"], x["n_functions"], 10.0) - 10) / 50, F.lit(0.0))
    clarity = 0.4 * naming + 0.3 * (F.when(indent, 1.0).otherwise(0.5) + length) / 2 + 0.3 * T.readability(F.col("content"))
    kiss = F.when(~ok, 0.5).otherwise(F.greatest(1 - (x["control"] - 2) / 5, F.lit(0.0)))
    srp = F.aggregate(x["methods"], F.lit(0.0), lambda a, m: a + F.when((m >= 1) & (m <= 10), 1.0).when(m <= 15, 0.7).otherwise(0.3))
    style = F.when(~ok, "unknown").when(x["snake"] > x["camel"], "snake_case").otherwise("camelCase")
    n = F.sum(x["n_functions"])
    classes = F.sum(F.size(x["classes"]))
    d = T.ratio(classes + n, F.sum(x["total_lines"]))
    return f.groupBy(*keys).agg(
        F.when(F.min(ok.cast("int")) == 0, 0.0).otherwise(T.ratio(F.sum(x["handled"]), n, 0.5)).alias("error_handling"),
        T.ratio(F.sum(x["documented"]), n).alias("documented_share"),
        F.when(n == 0, 0.5).otherwise((F.sum(x["typed"]) + F.sum(x["documented"])) / (2 * n)).alias("api_completeness"),
        F.when(n == 0, 0.5).otherwise((F.greatest(1 - (F.sum(x["function_complexity"]) / n - 1) / 10, F.lit(0.0)) + F.count(F.lit(1)) / F.greatest(F.count(F.lit(1)), F.lit(3))) / 2).alias("maintainability"),
        F.avg(clarity).alias("clarity"),
        F.when(F.min(ok.cast("int")) == 0, 0.5).otherwise(F.when((d >= 0.05) & (d <= 0.2), 1.0).when(d < 0.05, d / 0.05).otherwise(F.greatest(0.4 - (d - 0.2) / 0.1, F.lit(0.0)))).alias("abstraction"),
        F.avg(kiss).alias("kiss"),
        F.when(classes == 0, 0.8).otherwise(F.sum(srp) / classes).alias("single_responsibility"),
        (((F.count_distinct(style) == 1).cast("int") + (F.count_distinct(T.indentation(F.col("content"))) == 1).cast("int")) / 2).alias("style_consistency"),
        F.coalesce(F.avg(F.when(F.size(T.import_lines(F.col("content"))) > 0, 0.6 * F.col("imports_valid") + 0.4 * T.imports_plausible(F.col("content")))), F.lit(0.0)).alias("import_accuracy"),
    )


def prompt_text(prompt: Column) -> Column:
    """One text of a map session -> prompt, in the order of the session names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(prompt)), lambda e: e["value"]), " ")


def requirements_text(prompt: Column) -> Column:
    """The sessions of a map session -> prompt as they are put to a model: each under its name in capitals, in their order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(prompt)), lambda e: F.concat(F.lit("**"), F.upper(e["key"]), F.lit("**: "), e["value"])), "\n\n")


def first_session(prompt: Column) -> Column:
    """The first of them, by which context is retrieved; null without sessions."""
    first = F.get(F.array_sort(F.map_entries(prompt)), 0)
    return F.concat(F.lit("**"), F.upper(first["key"]), F.lit("**: "), first["value"])


def term_coverage(files: DataFrame, scenarios: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Scores that compare a scenario's words with a solution's: extraction, requirements, terminology, context usage.

    The words that a scenario wants go to its files as one array; what a file holds of them is counted by solution.
    scenarios(scenario_id, task_category, description, prompt, context_files).
    """
    low_text = F.lower(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("prompt", F.lit(""))))
    mentioned = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low_text, w))
    required = F.array_distinct(F.concat(F.regexp_extract_all("prompt", F.lit(r"\b[A-Z][a-z]+(?:[A-Z][a-z]*)*\b"), F.lit(0)), F.array(*[F.lit(w) for w in W.REQUIREMENT_VERBS])))
    kinds = {
        "pattern": mentioned(W.ARCHITECTURE_TERMS),
        "dependency": mentioned(W.DEPENDENCY_TERMS),
        "business": mentioned(W.BUSINESS_TERMS),
        "data": mentioned(W.DATA_TERMS),
        "technical": mentioned(W.TECHNICAL_TERMS),
        "action": mentioned(W.ACTION_TERMS),
        "error": mentioned(W.ERROR_TERMS),
        "concept": F.regexp_extract_all(low_text, F.lit(r"\b(?:func|struct|interface|package|import)\b"), F.lit(0)),
        "required": F.when(F.col("prompt") != "", required).otherwise(F.array().cast("array<string>")),
        "term": F.array_distinct(F.regexp_extract_all("prompt", F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))),
        "context": F.transform(F.coalesce("context_files", F.array().cast("array<string>")), T.stem),
        "structure": mentioned(["function", "struct", "interface", "package"]),
    }
    lists = [F.transform(F.coalesce(v, F.array().cast("array<string>")), partial(lambda kind, w: F.struct(kind.alias("kind"), w.alias("word")), F.lit(k))) for k, v in kinds.items()]
    wanted = scenarios.select("scenario_id", F.concat(*lists).alias("_wanted"))
    counts = wanted.select("scenario_id", F.explode("_wanted").alias("x")).groupBy("scenario_id", "x.kind", "x.word").agg(F.count(F.lit(1)).alias("n"))

    def held(content: Column, words: Column) -> Column:
        """Those of words that the text holds; the text is put into lower case once, as an element of an array."""

        def of(low: Column) -> Column:
            structure = lambda w: F.when(w == "function", F.contains(low, F.lit("func "))).when(w == "struct", F.contains(low, F.lit("type ")) & F.contains(low, F.lit("struct"))).when(w == "package", F.contains(low, F.lit("package "))).otherwise(F.contains(low, w))
            exact = lambda w: F.contains(content, w) | F.contains(content, F.lower(w)) | F.contains(content, F.upper(w))
            hit = lambda k, w: F.when(k == "structure", structure(w)).when(k == "term", exact(w)).when(k == "dependency", F.contains(low, w) | F.contains(low, F.lit("import"))).otherwise(F.contains(low, F.lower(w)))
            return F.filter(words, lambda x: hit(x["kind"], x["word"]))

        return F.get(F.transform(F.array(F.lower(content)), of), 0)

    found = files.join(wanted, "scenario_id").select(*keys, F.explode(F.array_distinct(held(F.col("content"), F.col("_wanted")))).alias("x"))
    found = found.groupBy(*keys, "x.kind", "x.word").agg(F.count(F.lit(1)).alias("files"))
    solutions = files.select(*keys).distinct().join(counts, "scenario_id")
    seen = solutions.join(found, [*keys, "kind", "word"], "left").select(*keys, "kind", "n", F.coalesce("files", F.lit(0)).alias("files"), F.when(F.col("files") > 0, 1).otherwise(0).alias("any"))
    low = F.lower("content")
    total = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c))
    share = lambda kind: T.ratio(total(kind, F.col("any") * F.col("n")), total(kind, F.col("n")))
    per = seen.groupBy(*keys).agg(
        *[F.coalesce(share(k), F.lit(0.0)).alias(f"{k}_share") for k in ("pattern", "dependency", "business", "data", "technical", "concept")],
        F.coalesce(share("required"), F.lit(0.5)).alias("requirement_coverage"),
        F.when(total("term", F.col("n")).isNull(), 0.6).otherwise(share("term")).alias("terminology"),
        F.when(total("context", F.col("n")).isNull(), 0.5).otherwise(F.least(T.ratio(total("context", F.col("files") * F.col("n")), total("context", F.col("n"))), F.lit(1.0))).alias("context_usage"),
        F.least(F.coalesce(total("structure", F.col("any")), F.lit(0)) / 4, F.lit(1.0)).alias("structure_share"),
        F.coalesce(total("action", F.col("n")), F.lit(0)).alias("n_actions"),
        F.coalesce(total("error", F.col("n")), F.lit(0)).alias("n_errors"),
    )
    handled = files.groupBy(*keys).agg(F.max(F.contains(low, F.lit("err")).cast("int")).alias("handles"), F.sum(T.count_of(low, "func ")).alias("func_words"))
    out = handled.join(per, keys, "left").join(scenarios.select("scenario_id", "task_category"), "scenario_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    error = F.when(F.coalesce("n_errors", F.lit(0)) == 0, 0.0).when(F.col("handles") == 1, 1.0).otherwise(0.5)
    action = F.when(F.coalesce("n_actions", F.lit(0)) == 0, 0.0).otherwise(F.least(T.ratio(F.col("func_words"), F.col("n_actions")), F.lit(1.0)))
    extraction = (
        F.when(F.col("task_category") == "architectural_understanding", 0.4 * z("pattern_share") + 0.35 * z("structure_share") + 0.25 * z("dependency_share"))
        .when(F.col("task_category") == "feature_implementation", 0.45 * z("business_share") + 0.3 * z("data_share") + 0.25 * error)
        .otherwise(0.4 * z("concept_share") + 0.35 * action + 0.25 * z("technical_share"))
    )
    return out.select(*keys, extraction.alias("information_extraction"), F.coalesce("requirement_coverage", F.lit(0.5)).alias("requirement_coverage"), F.coalesce("terminology", F.lit(0.6)).alias("terminology"), F.coalesce("context_usage", F.lit(0.5)).alias("context_usage"))


def compositions() -> dict[str, Column]:
    """The eleven composed scores, each between 0 and 1, over the columns of the partial scores, _prompt (in lower case) and _category."""
    asks = lambda words, otherwise, score: F.when(T.any_of(F.coalesce("_prompt", F.lit("")), words), score).otherwise(otherwise)
    c = F.col
    context = 0.4 * c("context_usage") + 0.35 * c("requirement_coverage") + 0.25 * c("terminology")
    documentation = F.least((0.7 * c("documented_share") + 0.3 * F.least(5 * T.ratio(c("comment_lines"), c("n_lines")), F.lit(1.0))) * F.when(c("has_readme") == 1, 1.2).otherwise(1.0), F.lit(1.0))
    reuse = F.greatest(c("reuse") - 0.5 * T.ratio(c("n_filled") - c("n_distinct"), c("n_filled")), F.lit(0.0))
    principles = (dry(c("n_filled"), c("n_distinct")) + c("kiss") + c("single_responsibility")) / 3
    scores = {
        "architectural_coherence": 0.4 * c("pattern_consistency") + 0.3 * c("file_organization") + 0.2 * c("naming") + 0.1 * c("dependency_structure"),
        "dependency_traversal": 0.4 * c("import_accuracy") + 0.35 * c("references") + 0.25 * c("dependency_order"),
        "cross_file_reasoning": 0.35 * c("interface_usage") + 0.3 * c("shared_state") + 0.25 * asks(W.MODIFY_WORDS, 0.6, c("modification")) + 0.1 * c("data_flow"),
        "system_thinking": (c("scalability") + c("maintainability") + c("integration") + c("extensibility")) / 4,
        "robustness": (c("error_handling") + c("input_validation") + c("security_practices") + c("resource_management")) / 4,
        "comprehensiveness": 0.3 * documentation + 0.25 * c("api_completeness") + 0.25 * F.least(c("test_indication"), F.lit(1.0)) + 0.2 * c("configuration"),
        "innovation": 0.3 * c("algorithm_efficiency") + 0.25 * c("design_patterns") + 0.25 * c("performance") + 0.2 * c("modern_practices"),
        "solution_elegance": 0.3 * c("clarity") + 0.25 * c("abstraction") + 0.25 * principles + 0.2 * c("style_consistency"),
        "incremental_development": 0.4 * asks(W.COMPATIBILITY_WORDS, 0.7, c("compatibility")) + 0.3 * reuse + 0.2 * c("extension") + 0.1 * asks(W.DISRUPTION_WORDS, 0.7, c("disruption")),
        "information_coverage": 0.4 * c("context_usage") + 0.35 * c("requirement_coverage") + 0.25 * c("information_extraction"),
        "multi_session_memory": F.when(c("_category") == "multi_session_development", 0.4 * c("naming_across") + 0.35 * c("approach_consistency") + 0.25 * c("state_management")).otherwise(context),
    }
    return {k: T.clamp(s) for k, s in scores.items()}


def all_metrics(files: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row per solution with the metrics that code alone can give, each between 0 and 1."""
    prompts = scenarios.select("scenario_id", F.lower("prompt").alias("_prompt"), F.col("task_category").alias("_category"))
    parts = [text_metrics(files), line_duplication(files), naming_mix(files), naming_conflicts(files), cross_references(files), syntax_metrics(files), term_coverage(files, scenarios)]
    x = reduce(lambda a, b: a.join(b, KEYS, "left"), parts).join(prompts, "scenario_id", "left").na.fill({"n_filled": 0, "n_distinct": 0})
    return x.select(*KEYS, *[v.alias(k) for k, v in compositions().items()])
