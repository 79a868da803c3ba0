"""Security rules, findings, risk; code smells; test and style shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W

HTML_RULES = [(r"<script", "medium", "Inline script"), (r"eval\(", "high", "Code injection vulnerability"), (r"javascript:", "high", "Script in a link"), (r"http://", "low", "Unencrypted link")]


def rules_of(language: str) -> list[tuple[str, str, str]]:
    return W.SECURITY_RULES.get(language, [])


def findings(files: DataFrame, rules: list[tuple[str, str, str]], key: str = "path", content: str = "content") -> DataFrame:
    """One row per match: key, line, severity, description, snippet (two lines around).  All rules are within a line."""
    lines = files.select(key, T.lines(F.col(content)).alias("_l")).select(key, "_l", F.posexplode("_l").alias("_i", "_x"))
    struct = [F.struct(F.lit(p).alias("p"), F.lit(s).alias("severity"), F.lit(d).alias("description"), F.regexp_count("_x", F.lit(p)).alias("n")) for p, s, d in rules]
    hit = lines.select(key, "_l", "_i", F.explode(F.filter(F.array(*struct), lambda r: r["n"] > 0)).alias("r"))
    each = hit.select(key, "_l", "_i", "r", F.explode(F.sequence(F.lit(1), F.col("r.n"))))
    start = F.greatest(F.col("_i") - 2, F.lit(0))
    return each.select(key, (F.col("_i") + 1).alias("line"), "r.severity", "r.description", F.array_join(F.slice("_l", start + 1, F.col("_i") + 3 - start), "\n").alias("snippet"))


def security_score(files: DataFrame, rules: list[tuple[str, str, str]], keys: list[str], content: str = "content") -> DataFrame:
    """Per group: findings, 1 less the severities, floored at 0, and the risk level.  Matches are counted in place."""
    counted = {s: sum((F.regexp_count(F.col(content), F.lit(p)) for p, sev, _ in rules if sev == s), F.lit(0)) for s in W.SEVERITY}
    out = files.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{s}") for s, c in counted.items()])
    score = F.greatest(F.lit(1.0) - sum((w * F.col(f"n_{s}") for s, w in W.SEVERITY.items()), F.lit(0.0)), F.lit(0.0))
    n = sum((F.col(f"n_{s}") for s in W.SEVERITY), F.lit(0))
    out = out.withColumns({"n_findings": n, "security_score": F.round(score, 6)})
    return out.withColumn("risk_level", T.risk_level(F.col("security_score"), F.col("n_findings")))


def repeated_lines(files: DataFrame, key: str = "path", content: str = "content", longer: int = 10, over: int = 2) -> DataFrame:
    """Lines of a file, stripped and longer than so many characters, that occur more than so often, with their numbers."""
    own = files.select(key, F.posexplode(T.lines(F.col(content))).alias("_i", "_x")).withColumn("line", T.strip(F.col("_x"))).filter(F.length("line") > longer)
    return own.groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.col("_i") + 1)).alias("lines")).filter(F.col("n") > over)


def long_functions(c: Column, language: str = "python", over: int = 20) -> Column:
    """Functions of more than so many filled lines: array of (line where it ends, length)."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.array().cast("array<struct<line:int,length:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        opens = T.any_of(x, ["func ", "def ", "function "])
        filled = T.strip(x) != ""
        n = s["n"] + filled.cast("int")
        ends = (T.strip(x) == "}") | (~F.startswith(x, F.lit(" ")) if language == "python" else F.lit(False))
        found = F.when(ends & (n > over), F.concat(s["out"], F.array(F.struct((s["i"] + 1).alias("line"), n.alias("length"))))).otherwise(s["out"])
        i = s["i"] + 1
        return F.when(opens, F.struct(i.alias("i"), F.lit(1).alias("n"), s["out"].alias("out"))).when(
            s["n"] > 0, F.struct(i.alias("i"), F.when(ends, 0).otherwise(n).alias("n"), found.alias("out"))
        ).otherwise(F.struct(i.alias("i"), s["n"].alias("n"), s["out"].alias("out")))

    return F.aggregate(T.lines(c), start, step, lambda s: s["out"])


def test_coverage(files: DataFrame, keys: list[str], path: str = "path", content: str = "content") -> DataFrame:
    """Lines of test files per line of other files, at most 1; 0 without tests or without other files."""
    test = F.contains(F.lower(path), F.lit("test"))
    n = T.n_lines(F.col(content))
    return files.groupBy(*keys).agg(F.least(T.ratio(F.sum(F.when(test, n).otherwise(0)), F.sum(F.when(~test, n).otherwise(0))), F.lit(1.0)).alias("test_coverage"))


def warnings_of(stderr: Column) -> Column:
    return F.filter(T.lines(stderr), lambda x: F.contains(F.lower(x), F.lit("warning")))


def go_naming(c: Column) -> Column:
    """Mean over functions and variables of 1 for names in camel case and 0.5 for others; 0.6 without names."""
    names = F.concat(F.regexp_extract_all(c, F.lit(r"func\s+([a-zA-Z_]\w*)"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"var\s+([a-zA-Z_]\w*)"), F.lit(1)))
    return T.ratio(F.aggregate(names, F.lit(0.0), lambda a, x: a + F.when(F.rlike(x, F.lit("^[a-zA-Z][a-zA-Z0-9]*$")), 1.0).otherwise(0.5)), F.size(names), 0.6)


def go_documentation(c: Column) -> Column:
    comments = T.ratio(F.size(F.filter(T.lines(c), lambda x: F.startswith(T.strip(x), F.lit("//")))), T.n_lines(c))
    functions = F.regexp_count(c, F.lit(r"(?m)^func\s+\w+"))
    documented = F.regexp_count(c, F.lit(r"(?m)^//.*\nfunc\s+\w+"))
    return F.least(2 * (0.4 * comments + 0.6 * T.ratio(documented, functions)), F.lit(1.0))
