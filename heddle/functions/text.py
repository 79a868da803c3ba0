"""Column kernels over the text of one file; all are built-in expressions inside whole-stage code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions import wordlists as W


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or empty where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def n_lines(c: Column) -> Column:
    return F.size(lines(c))


def filled_lines(c: Column) -> Column:
    """Lines with something on them, stripped."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def n_filled_lines(c: Column) -> Column:
    return F.size(filled_lines(c))


def count_of(c: Column, part: str) -> Column:
    """Occurrences of a fixed string that do not overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def hits(c: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(add, [F.contains(c, F.lit(w)).cast("int") for w in words])


def any_of(c: Column, words: list[str]) -> Column:
    return hits(c, words) > 0


def matches(c: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """Matches of all patterns, summed."""
    return reduce(add, [F.regexp_count(c, F.lit(flags + p)) for p in patterns])


def comment_share(c: Column, marks: str = r"^\s*(//|#)") -> Column:
    return ratio(F.size(F.filter(lines(c), lambda x: F.rlike(x, F.lit(marks)))), n_lines(c))


def line_length(c: Column) -> Column:
    """Mean length of the filled lines, as they stand."""
    own = F.filter(lines(c), lambda x: strip(x) != "")
    return ratio(F.aggregate(own, F.lit(0), lambda a, x: a + F.length(x)), F.size(own))


def separates_concerns(c: Column) -> Column:
    return (F.regexp_count(c, F.lit(r"class\s+\w+")) > 0) | (F.regexp_count(c, F.lit(r"def\s+\w+")) > 2)


def organised(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: F.rlike(x, F.lit(r"^(    |\t)")))) > 0.3 * n_lines(c)


def import_lines(c: Column) -> Column:
    return F.filter(lines(c), lambda x: F.rlike(strip(x), F.lit("^(import |from )")))


def few_imports(c: Column) -> Column:
    return F.size(import_lines(c)) <= 10


def imports_grouped(c: Column) -> Column:
    """No line of the standard library after another one."""
    known = lambda x: any_of(x, W.STANDARD_MODULES)
    own = F.transform(import_lines(c), strip)
    at = lambda want: F.filter(F.transform(own, lambda x, i: F.when(known(x) == want, i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(at(True)) < F.array_min(at(False)), F.lit(True))


def imports_plausible(c: Column) -> Column:
    """Share of import lines without suspicious parts."""
    own = import_lines(c)
    return ratio(F.size(F.filter(own, lambda x: ~any_of(x, W.SUSPICIOUS_IMPORTS))), F.size(own))


def imports_on_top(c: Column) -> Column:
    """The import section at the head of the file ends before line 10 and the first quarter."""
    scan = F.aggregate(
        lines(c),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("i"), F.lit(True).alias("on")),
        lambda s, x: F.when(s["on"] & F.rlike(strip(x), F.lit("^(import |from )")), F.struct(s["i"].alias("end"), (s["i"] + 1).alias("i"), F.lit(True).alias("on"))).otherwise(
            F.struct(s["end"].alias("end"), (s["i"] + 1).alias("i"), (s["on"] & ((strip(x) == "") | F.startswith(strip(x), F.lit("#")))).alias("on"))
        ),
        lambda s: s["end"],
    )
    return scan < F.least(F.lit(10), F.floor(n_lines(c) / 4))


def spaced(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: strip(x) == "")) < 0.3 * n_lines(c)


def structured(c: Column) -> Column:
    return F.contains(c, F.lit('"""')) | F.contains(c, F.lit("#"))


def ordered_logically(c: Column) -> Column:
    """The last class comes before the first function, or one of both is missing."""
    at = lambda p: F.filter(F.transform(lines(c), lambda x, i: F.when(F.rlike(x, F.lit(p)), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(at(r"^\s*class ")) < F.array_min(at(r"^\s*def ")), F.lit(True))


def no_wildcards(c: Column) -> Column:
    return ~F.exists(import_lines(c), lambda x: F.contains(x, F.lit("*")))


def identifiers(c: Column) -> Column:
    """Names of functions, variables and types, repeats kept."""
    name = "([a-zA-Z_][a-zA-Z0-9_]*)"
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (rf"func\s+{name}", rf"var\s+{name}", rf"type\s+{name}", rf"def\s+{name}", rf"{name}\s*:?=")])


def naming_style(name: Column) -> Column:
    snake = F.contains(name, F.lit("_")) & (F.lower(name) == name) & F.rlike(name, F.lit("[a-z]"))
    return (
        F.when(snake, "snake_case")
        .when(F.rlike(name, F.lit("^[a-z].*[A-Z]")), "camelCase")
        .when(F.rlike(name, F.lit("^[A-Z]")), "PascalCase")
        .otherwise("other")
    )


def indentation(c: Column) -> Column:
    """By the first indented line: 4_spaces, 2_spaces, tabs, unknown."""
    first = F.get(F.filter(lines(c), lambda x: F.rlike(x, F.lit(r"^(    |  |\t)"))), 0)
    return F.when(F.startswith(first, F.lit("    ")), "4_spaces").when(F.startswith(first, F.lit("  ")), "2_spaces").when(F.startswith(first, F.lit("\t")), "tabs").otherwise("unknown")


def unused_imports(c: Column) -> Column:
    """Whether a name that an import line brings is nowhere in the text, compared as text with single spaces."""
    own = F.filter(F.transform(lines(c), strip), lambda x: x.startswith("import ") | x.startswith("from "))
    words = lambda x: F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))
    plain = lambda w: F.array(F.substring_index(F.get(w, 1), ".", 1))
    after = lambda w: F.slice(w, F.array_position(w, "import").cast("int") + 1, F.size(w))
    several = lambda w: F.when(F.array_contains(w, "import"), F.transform(F.split(F.array_join(after(w), " "), ",", -1), strip)).otherwise(F.array().cast("array<string>"))
    names = F.flatten(F.transform(own, lambda x: F.when(x.startswith("import "), plain(words(x))).otherwise(several(words(x)))))
    return F.exists(names, lambda n: ~F.contains(c, n))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def readability(c: Column) -> Column:
    own = F.filter(lines(c), lambda x: strip(x) != "")
    length = F.greatest(1 - (line_length(c) - 80) / 80, F.lit(0.0))
    comments = F.least(5 * ratio(F.size(F.filter(own, lambda x: F.rlike(x, F.lit(r"^\s*#")))), F.size(own)), F.lit(1.0))
    return F.when(F.size(own) == 0, 0.5).otherwise((length + comments) / 2)


def simple_complexity(c: Column, language: str = "python") -> Column:
    """Struct of the line-based complexity measures of a file."""
    p = W.CODE_PATTERNS.get({"typescript": "javascript"}.get(language, language), W.CODE_PATTERNS["python"])
    comment = lambda x: reduce(lambda a, b: a | b, [F.rlike(x, F.lit("(?i)" + q)) for q in p["comments"]])
    zero, none = F.lit(0.0), F.lit(0)

    def measured(own_lines: Column, own: Column) -> Column:
        control, functions, classes = (matches(own, p[k]) for k in ("control", "functions", "classes"))
        operators = F.regexp_count(own, F.lit(r"[+\-*/=<>!&|%^~]"))
        operands = F.regexp_count(own, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"))
        n = F.size(own_lines)
        return F.struct((1 + control).cast("double").alias("cc"), (operators + operands).cast("double").alias("halstead"), n.alias("n"), F.size(F.filter(own_lines, comment)).alias("comments"), functions.alias("functions"), classes.alias("classes"), (own == "").alias("blank"))

    def named(m: Column) -> Column:
        pick = lambda x, z: F.when(m["blank"], z).otherwise(x)
        mi = F.greatest(F.lit(0.0), 100 - 20 * (F.least(m["n"] / 100, F.lit(2.0)) + F.least(m["cc"] / 10, F.lit(2.0))))
        return F.struct(
            pick(m["cc"], zero).alias("cyclomatic_complexity"),
            pick(mi, zero).alias("maintainability_index"),
            pick(m["halstead"], zero).alias("halstead_difficulty"),
            pick(n_lines(c), none).alias("lines_of_code"),
            pick(m["n"], none).alias("logical_lines"),
            pick(m["comments"], none).alias("comment_lines"),
            pick(m["functions"], none).alias("function_count"),
            pick(m["classes"], none).alias("class_count"),
            pick(m["n"], none).alias("nloc"),
            F.lit(language).alias("language"),
        )

    return let(filled_lines(c), lambda x: let(F.array_join(x, "\n"), lambda own: let(measured(x, own), named)))


def fallback_complexity(c: Column) -> Column:
    n = n_filled_lines(c)
    return F.struct(
        (1 + count_of(c, "if") + count_of(c, "for") + count_of(c, "while")).cast("double").alias("cyclomatic_complexity"),
        F.greatest(F.lit(0.0), 100 - n / 10).alias("maintainability_index"),
        (n / 10).alias("halstead_difficulty"),
        n_lines(c).alias("lines_of_code"),
        n.alias("logical_lines"),
        (count_of(c, "#") + count_of(c, "//")).alias("comment_lines"),
        (count_of(c, "def ") + count_of(c, "function ")).alias("function_count"),
        count_of(c, "class ").alias("class_count"),
        n.alias("nloc"),
        F.lit("unknown").alias("language"),
    )


def complexity_score(cc: Column, mi: Column, halstead: Column, nloc: Column) -> Column:
    return (
        0.4 * F.least(cc / 20, F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), 1 - mi / 100) + 0.2 * F.least(halstead / 50, F.lit(1.0)) + 0.1 * F.least(nloc / 1000, F.lit(1.0))
    )


def document_complexity(c: Column) -> Column:
    """Size, comments and line length of a generated file, as one number of two decimals; 0 for null and blank."""
    own = F.filter(lines(c), lambda x: strip(x) != "")
    comments = ratio(F.size(F.filter(own, lambda x: F.rlike(x, F.lit(r"^\s*#|//")))), F.size(own))
    score = F.round(F.least(F.lit(1.0), n_filled_lines(c) / 100 * 0.6 + comments * 0.2 + line_length(c) / 80 * 0.2), 2)
    return F.when(c.isNull() | (strip(c) == ""), 0.0).otherwise(score)


def branch_complexity(c: Column, language: str) -> Column:
    """1 less the share of 20 branch words; 1 for languages without a list."""
    words = W.BRANCH_WORDS.get(language)
    return 1 - F.least(reduce(add, [count_of(c, w) for w in words]) / 20, F.lit(1.0)) if words else F.lit(1.0)


def maintainability(c: Column) -> Column:
    base = F.when(n_filled_lines(c) > 100, 0.8).otherwise(1.0) * F.when(line_length(c) > 80, 0.9).otherwise(1.0)
    return F.least(base + 0.2 * comment_share(c), F.lit(1.0))


def file_complexity(c: Column) -> Column:
    """Definitions, control words, error handling and imports per line, at most 1."""
    def line_score(low: Column) -> Column:
        part = lambda words, w: F.when(any_of(low, words), w).otherwise(0.0)
        return reduce(add, [part(words, w) for words, w in W.EFFORT_WORDS])

    return F.least(ratio(F.aggregate(F.transform(lines(c), lambda x: F.lower(strip(x))), F.lit(0.0), lambda a, x: a + line_score(x)), n_lines(c)), F.lit(1.0))


def file_type(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(any_of(p, ["test", "spec"]), "test")
        .when(any_of(p, ["config", "settings", ".env", "package.json"]), "config")
        .when(any_of(p, ["readme", "doc"]), "documentation")
        .otherwise("source")
    )


def language_of_path(path: Column, unknown: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for kv in W.LANGUAGE_OF_SUFFIX.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))), F.lit(unknown))


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def quality_of_file(c: Column) -> Column:
    n = n_lines(c)
    return (
        F.lit(0.5)
        + F.when(comment_share(c) > 0.1, 0.2).otherwise(0.0)
        + F.when((n >= 50) & (n <= 500), 0.2).otherwise(0.0)
        + F.when(any_of(c, ["func ", "def ", "function "]), 0.1).otherwise(0.0)
    )


def chunks(c: Column, size: int = 512) -> Column:
    """Lines packed greedily into chunks of at most size characters; a longer line is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def close(s: Column) -> Column:
        return F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n")))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        cost = F.length(x) + 1
        full = (s["n"] + cost > size) & (F.size(s["open"]) > 0)
        return F.when(full, F.struct(close(s).alias("done"), F.array(x).alias("open"), cost.alias("n"))).otherwise(
            F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(x)).alias("open"), (s["n"] + cost).alias("n"))
        )

    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.aggregate(lines(c), start, step, close))


def grade(score: Column) -> Column:
    return reduce(lambda w, g: w.when(score >= g[0], g[1]), W.GRADES[1:], F.when(score >= W.GRADES[0][0], W.GRADES[0][1])).otherwise("F (Poor)")


def classification(score: Column) -> Column:
    return reduce(lambda w, g: w.when(score >= g[0], g[2]), W.GRADES[1:], F.when(score >= W.GRADES[0][0], W.GRADES[0][2])).otherwise("poor")


def passed(score: Column) -> Column:
    return score >= 2.0


def difficulty_of_coverage(share: Column) -> Column:
    """First closed range that holds the share; a boundary goes to the lower level, anything below to easy."""
    out = None
    for name, low, high in W.COVERAGE_RANGES:
        hit = (share >= low) & (share <= high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("easy")


def difficulty_of_length(length: Column, level: Column) -> Column:
    """Level by context length, moved by the project's complexity level."""
    base = F.when(length < 20_000, 0).when(length < 60_000, 1).when(length < 150_000, 2).otherwise(3)
    move = F.when(level == "easy", -1).when(level == "hard", 1).when(level == "expert", 2).otherwise(0)
    return F.element_at(F.array(*[F.lit(d) for d in W.DIFFICULTIES]), F.least(F.greatest(base + move, F.lit(0)), F.lit(3)) + 1)


def priority(category: Column, difficulty: Column) -> Column:
    table = lambda m, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c), F.lit(0))
    return 10 * table(W.DIFFICULTY_PRIORITY, difficulty) + table(W.CATEGORY_PRIORITY, category)


def risk_level(score: Column, n: Column) -> Column:
    return F.when((score >= 0.8) & (n == 0), "low").when((score >= 0.6) & (n <= 2), "medium").otherwise("high")


def duration(seconds: Column) -> Column:
    """Seconds as '42s', '3m 20s' or '2h 5m'."""
    s = F.floor(seconds)
    return (
        F.when(seconds < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor((s % 3600) / 60).cast("string"), F.lit("m")))
    )
