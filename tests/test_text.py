import pytest
from pyspark.sql import functions as F

from heddle.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "n"), [("", 1), ("a\n", 2), ("a\nb", 2)])
def test_lines(spark, text, n):
    assert value(spark, T.n_lines(F.lit(text))) == n


def test_chunks(spark):
    assert value(spark, T.chunks(F.lit("aa\nbbb\ncccccccc\nd"), 8)) == ["aa\nbbb", "cccccccc", "d"]
    assert value(spark, T.chunks(F.lit(""))) == []


@pytest.mark.parametrize(("share", "level"), [(0.40, "easy"), (0.20, "easy"), (0.19, "easy"), (0.80, "hard"), (1.0, "expert")])
def test_difficulty_of_coverage(spark, share, level):
    assert value(spark, T.difficulty_of_coverage(F.lit(share))) == level


@pytest.mark.parametrize(("score", "letter"), [(4.0, "A"), (3.0, "B"), (2.0, "C"), (1.99, "F")])
def test_grade(spark, score, letter):
    assert value(spark, T.grade(F.lit(score)))[0] == letter


@pytest.mark.parametrize(("name", "style"), [("a_b", "snake_case"), ("aB", "camelCase"), ("Ab", "PascalCase"), ("ab", "other"), ("A_B", "PascalCase")])
def test_naming_style(spark, name, style):
    assert value(spark, T.naming_style(F.lit(name))) == style


@pytest.mark.parametrize(("score", "n", "risk"), [(1.0, 0, "low"), (0.7, 1, "medium"), (0.4, 3, "high")])
def test_risk(spark, score, n, risk):
    assert value(spark, T.risk_level(F.lit(score), F.lit(n))) == risk


@pytest.mark.parametrize(("path", "stem"), [("a/b.tar.gz", "b.tar"), (".env", ".env"), ("x", "x"), ("src/main.py", "main")])
def test_stem(spark, path, stem):
    assert value(spark, T.stem(F.lit(path))) == stem


def test_imports_on_top(spark):
    code = "import os\n" + "x = 1\n" * 20
    assert value(spark, T.imports_on_top(F.lit(code))) is True
    assert value(spark, T.imports_grouped(F.lit("import os\nimport numpy\nimport sys"))) is False
    assert value(spark, T.imports_grouped(F.lit("import os\nimport sys\nimport numpy"))) is True


def test_blank_complexity(spark):
    row = value(spark, T.simple_complexity(F.lit("  \n")))
    assert (row.cyclomatic_complexity, row.lines_of_code, row.language) == (0.0, 0, "python")
    row = value(spark, T.simple_complexity(F.lit("def f(x):\n    if x:\n        return 1"), "python"))
    assert (row.cyclomatic_complexity, row.function_count, row.nloc) == (2.0, 1, 3)


def test_duration(spark):
    assert [value(spark, T.duration(F.lit(s))) for s in (42, 200, 7500)] == ["42s", "3m 20s", "2h 5m"]
