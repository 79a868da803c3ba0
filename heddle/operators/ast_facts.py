"""Facts of a Python file's syntax tree, one Arrow-batched call per file; the rest of the scores is built on them.

A file that does not parse has ok = false and empty facts.  Async functions count as functions.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = (
    "ok boolean, functions array<string>, classes array<string>, imports array<string>, variables array<string>, "
    "function_details array<struct<name:string,args:array<string>,line:int,is_async:boolean>>, complexity int, total_lines int, "
    "n_functions int, handled int, documented int, typed int, function_complexity int, function_lines int, control int, "
    "methods array<int>, n_names int, good_names int, snake int, camel int"
)

# --- fixed values: begin ---
DEFENSIVE = ("is None", "is not None", "len(", "not ", "== 0", "!= 0")
GO = {
    "functions": r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\([^)]*\)",
    "types": r"type\s+(\w+)\s+(?:struct|interface)",
    "imports": [r'import\s+"([^"]+)"', r"import\s+`([^`]+)`"],
    "variables": r"(?:var|:=)\s+(\w+)",
    "branches": ["if", "for", "switch", "case", "select"],
    "arguments": r"func\s+(?:\([^)]*\)\s+)?\w+\s*\(([^)]*)\)",
}
JAVASCRIPT = {
    "functions": [r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", r"(\w+)\s*:\s*(?:async\s+)?function\s*\(", r"(\w+)\s*\([^)]*\)\s*\{"],
    "classes": r"class\s+(\w+)",
    "imports": [r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"],
    "variables": r"(?:const|let|var)\s+(\w+)",
    "branches": ["if", "while", "for", "switch", "case", "catch"],
}
# --- fixed values: end ---


def _doc(node: ast.AST) -> bool:
    body = getattr(node, "body", None)
    return bool(body) and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str)


def _guards(node: ast.AST) -> bool:
    """Raises, handles errors, or tests its input."""
    for child in ast.walk(node):
        if isinstance(child, (ast.Try, ast.Raise)):
            return True
        if isinstance(child, ast.If) and isinstance(child.test, ast.Compare) and any(p in ast.unparse(child.test) for p in DEFENSIVE):
            return True
    return False


def facts(code: str | None) -> dict:
    code = code or ""
    out: dict = {"ok": True, "total_lines": code.count("\n") + 1, "complexity": 0}
    out |= dict.fromkeys(("functions", "classes", "imports", "variables", "function_details", "methods"), ())
    out |= dict.fromkeys(("n_functions", "handled", "documented", "typed", "function_complexity", "function_lines", "control", "n_names", "good_names", "snake", "camel"), 0)
    try:
        nodes = list(ast.walk(ast.parse(code)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out | {"ok": False}
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    functions = [n for n in nodes if isinstance(n, kinds)]
    names = [n.name if isinstance(n, kinds) else n.id for n in nodes if isinstance(n, (*kinds, ast.Name))]
    imports = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
    imports += [f"{n.module}.{a.name}" if n.module else a.name for n in nodes if isinstance(n, ast.ImportFrom) for a in n.names]
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    return out | {
        "functions": [f.name for f in functions],
        "classes": [c.name for c in classes],
        "imports": imports,
        "variables": [t.id for n in nodes if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)],
        "function_details": [{"name": f.name, "args": [a.arg for a in f.args.args], "line": f.lineno, "is_async": isinstance(f, ast.AsyncFunctionDef)} for f in functions],
        "complexity": 1 + sum(isinstance(n, (ast.If, ast.While, ast.For, ast.Try, ast.With, ast.And, ast.Or)) for n in nodes) if code.strip() else 0,
        "n_functions": len(functions),
        "handled": sum(map(_guards, functions)),
        "documented": sum(map(_doc, functions)),
        "typed": sum(f.returns is not None or any(a.annotation is not None for a in f.args.args) for f in functions),
        "function_complexity": sum(1 + sum(isinstance(c, (ast.If, ast.While, ast.For, ast.Try)) for c in ast.walk(f)) for f in functions),
        "function_lines": sum(f.end_lineno - f.lineno for f in functions),
        "control": sum(isinstance(n, (ast.If, ast.For, ast.While, ast.Try)) for n in nodes),
        "methods": [sum(isinstance(m, kinds) for m in c.body) for c in classes],
        "n_names": len(names),
        "good_names": sum(len(n) > 2 and not n.startswith("_") and n.islower() for n in names),
        "snake": sum("_" in n for n in names),
        "camel": sum("_" not in n and any(c.isupper() for c in n[1:]) for n in names),
    }


def python_facts(code: Column) -> Column:
    """The struct of FACTS of a Python text."""

    @F.pandas_udf(FACTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for codes in batches:
            yield pd.DataFrame([facts(c) for c in codes], columns=[f.split()[0] for f in FACTS.split(", ")])

    return run(code)


def parse_python(files: DataFrame, content: str = "content") -> DataFrame:
    """files with facts, the struct of FACTS."""
    return files.withColumn("facts", python_facts(F.col(content)))


def symbols(f: Column) -> Column:
    """Distinct names that a file defines."""
    return F.array_distinct(F.concat(f["functions"], f["classes"], f["variables"]))


def valid_imports(code: Column) -> Column:
    """Share of import lines that parse by themselves."""

    def share(text: str | None) -> float:
        own = [x.strip() for x in (text or "").split("\n") if x.strip().startswith(("import ", "from "))]
        good = 0
        for x in own:
            try:
                ast.parse(x)
                good += 1
            except (SyntaxError, ValueError):
                pass
        return good / len(own) if own else 0.0

    @F.pandas_udf("double")
    def run(codes: pd.Series) -> pd.Series:
        return codes.map(share).astype(float)

    return run(code)


def _per_line(c: Column, *patterns: str, first: bool = False) -> Column:
    """The first group of each pattern's first match in each line; with first, of the first pattern that matches the line."""
    hits = lambda x: F.filter(F.array(*[F.regexp_extract(x, p, 1) for p in patterns]), lambda h: h != "")
    return F.flatten(F.transform(F.split(c, "\n", -1), lambda x: F.slice(hits(x), 1, 1) if first else hits(x)))


def _branches(c: Column, words: list[str]) -> Column:
    """1 and one for every line and word that the line holds."""
    held = lambda x: reduce(add, [F.rlike(x, F.lit(rf"\b{w}\b")).cast("int") for w in words])
    return F.aggregate(F.split(c, "\n", -1), F.lit(1), lambda n, x: n + held(x))


def _numbered_lines(c: Column, name: Callable[[Column], Column], more: Callable[[Column], list[Column]]) -> Column:
    """name, line_number and more of the lines for which name is not empty."""
    rows = F.transform(F.split(c, "\n", -1), lambda x, i: F.struct(name(x).alias("name"), (i + 1).alias("line_number"), *more(x)))
    return F.filter(rows, lambda r: r["name"] != "")


def go_functions(c: Column) -> Column:
    """name, line_number, args (the last word of each parameter) and is_method of a Go file's functions, one a line.

    is_method says that a parenthesis opens before the word func.
    """

    def more(x: Column) -> list[Column]:
        parts = F.filter(F.split(F.regexp_extract(x, GO["arguments"], 1), ","), lambda p: F.rlike(p, F.lit(r"\S")))
        method = F.contains(x, F.lit(")")) & (F.locate("(", x) > 0) & (F.locate("(", x) < F.locate("func", x))
        return [F.transform(parts, lambda p: F.regexp_extract(p, r"(\S+)\s*$", 1)).alias("args"), method.alias("is_method")]

    return _numbered_lines(c, lambda x: F.regexp_extract(x, GO["functions"], 1), more)


def javascript_functions(c: Column) -> Column:
    """name, line_number and is_async (the line has the word) of a JavaScript or TypeScript file's functions, one a line."""
    name = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in JAVASCRIPT["functions"]], F.lit(""))
    return _numbered_lines(c, name, lambda x: [F.contains(x, F.lit("async")).alias("is_async")])


def parse_go(c: Column) -> Column:
    """Functions, types, imports (of one line), variables and complexity of a Go file by line patterns; one match a line."""
    return F.struct(
        _per_line(c, GO["functions"]).alias("functions"),
        _per_line(c, GO["types"]).alias("types"),
        _per_line(c, *GO["imports"], first=True).alias("imports"),
        _per_line(c, GO["variables"]).alias("variables"),
        _branches(c, GO["branches"]).alias("complexity"),
        F.size(F.split(c, "\n", -1)).alias("total_lines"),
    )


def parse_javascript(c: Column) -> Column:
    """The same of a JavaScript or TypeScript file; a line's function is that of the first pattern that matches."""
    return F.struct(
        _per_line(c, *JAVASCRIPT["functions"], first=True).alias("functions"),
        _per_line(c, JAVASCRIPT["classes"]).alias("classes"),
        _per_line(c, *JAVASCRIPT["imports"]).alias("imports"),
        _per_line(c, JAVASCRIPT["variables"]).alias("variables"),
        _branches(c, JAVASCRIPT["branches"]).alias("complexity"),
        F.size(F.split(c, "\n", -1)).alias("total_lines"),
    )


def parse_generic(c: Column, keywords: tuple[str, ...] = ("if", "else", "for", "while", "return", "class", "def", "function", "import", "from")) -> Column:
    """First 50 of the sorted distinct words that are no keywords, and a complexity by length."""
    found = F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b[a-zA-Z_]\w*\b"), F.lit(0))), F.array(*[F.lit(k) for k in keywords])))
    return F.struct(F.slice(found, 1, 50).alias("words"), F.greatest(F.lit(1), F.floor(F.size(F.split(c, "\n", -1)) / 10)).cast("int").alias("complexity"))
