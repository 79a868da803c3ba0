"""Replies of models to files: a cascade from strict JSON to plain text, one Arrow-batched call per reply.

A reply becomes a map file name -> content, or null if no stage gives a viable result (a file of 50 characters or more).
Candidates for JSON are the balanced objects of the reply, outermost first, found by one scanner that knows strings and
escapes; each is read as it stands, then repaired.  The best candidate by score is taken, the first on ties.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: begin ---
SUFFIXES = {"go": "go", "python": "py", "javascript": "js", "typescript": "ts", "rust": "rs", "java": "java", "cpp": "cpp"}
INDICATORS = {
    "go": ["package main", "func main", 'import "', "type ", "func "],
    "python": ["def ", "import ", "from ", "class ", "__init__"],
    "javascript": ["function ", "const ", "let ", "var ", "=>"],
    "typescript": ["interface ", "type ", "function ", "const ", "=>"],
    "rust": ["fn ", "use ", "mod ", "struct ", "impl "],
    "java": ["public class", "private ", "public ", "static "],
    "cpp": ["#include", "int main", "class ", "namespace "],
}
NAME_KEYS = ["filename", "file", "name", "path", "file_path"]
TEXT_KEYS = ["content", "code", "source", "text", "body"]
SESSION_MARKS = ["session_", "step_", "phase_", "stage_"]
SESSION_STARTS = ("s1", "s2", "s3", "stage1", "stage2", "stage3")
CODE_SUFFIX = r"(?:go|py|js|ts|rs|java|cpp|h)"
FILE_ENDINGS = (".go", ".py", ".js", ".ts", ".rs", ".java", ".cpp", ".h", ".txt", ".md", ".json", ".xml", ".yml", ".yaml", ".conf", ".cfg", ".ini", ".properties")
FENCE_NAMES = {"python": "python|py", "javascript": "javascript|js", "typescript": "typescript|ts", "go": "go|golang", "rust": "rust|rs", "cpp": r"cpp|c\+\+"}
HEADERS = [r"(?:File|Filename):\s*([^\n]+)", rf"#+\s*([^\n]+\.{CODE_SUFFIX})", rf"//\s*([^\n]+\.{CODE_SUFFIX})"]
PAIRS = [rf'"([^"]+\.{CODE_SUFFIX})"\s*:\s*"((?:[^"\\]|\\.)*)"', rf"(\w+\.{CODE_SUFFIX})\s*[:=]\s*`([^`]+)`"]
# --- fixed values: end ---


def detect_language(text: str) -> str | None:
    """First language of which the text has two marks."""
    low = text.lower()
    return next((k for k, marks in INDICATORS.items() if sum(m.lower() in low for m in marks) >= 2), None)


def balanced(text: str) -> list[str]:
    """Outermost balanced objects, then those inside what never closes.

    One pass from the back over braces, quotes and backslashes notes for each of them, read outside and inside a string, at
    which mark an enclosing object would end; the objects are then read off from the front.
    """
    marks = [(m.start(), m.group()) for m in re.finditer(r'[{}"\\]', text)]
    n = len(marks)
    outside, inside = [-1] * (n + 2), [-1] * (n + 2)
    for k in range(n - 1, -1, -1):
        at, c = marks[k]
        if c == "\\":
            outside[k] = outside[k + 1]
            inside[k] = inside[k + 2 if k + 1 < n and marks[k + 1][0] == at + 1 else k + 1]
        elif c == '"':
            outside[k], inside[k] = inside[k + 1], outside[k + 1]
        else:
            inside[k] = inside[k + 1]
            end = outside[k + 1]
            outside[k] = k if c == "}" else outside[end + 1] if end >= 0 else -1
    out, after = [], 0
    for k, (at, c) in enumerate(marks):
        if c == "{" and at >= after and outside[k + 1] >= 0:
            after = marks[outside[k + 1]][0] + 1
            out.append(text[at:after])
    return out


def _line_breaks(text: str) -> str:
    """Raw line breaks inside strings, escaped."""
    out, quoted, skip = [], False, False
    for c in text:
        if quoted and not skip and c in "\n\r\t":
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c])
            continue
        if c == '"' and not skip:
            quoted = not quoted
        skip = c == "\\" and not skip
        out.append(c)
    return "".join(out)


def repairs(text: str) -> Iterator[str]:
    """The text, then milder to stronger repairs of it."""
    yield text
    step = re.sub(r",\s*([}\]])", r"\1", text)
    yield step
    yield (step := _line_breaks(step))
    step = re.sub(r"(?m)^\s*//.*$|/\*.*?\*/", "", step)
    yield re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', step)
    yield re.sub(r"(?<!\\)'", '"', step)


def loads(text: str):
    for t in repairs(text):
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, indent=2)


def many_sessions(files) -> bool:
    if not isinstance(files, dict):
        return False
    return any(isinstance(v, dict) and (any(m in str(k).lower() for m in SESSION_MARKS) or str(k).lower().startswith(SESSION_STARTS)) for k, v in files.items())


def flatten_sessions(files: dict) -> dict[str, str]:
    """Files of all sessions in order; a name that is taken gets its session in front."""
    out: dict[str, str] = {}
    for session, own in files.items():
        if isinstance(own, str):
            out[session] = own
        for name, content in own.items() if isinstance(own, dict) else ():
            if isinstance(content, str):
                out[f"{session}_{name}" if name in out else name] = content
            elif isinstance(content, (dict, list)):
                out[name] = _text(content)
    return out


def listed(items: list) -> dict[str, str]:
    """An array of files, under any of the usual keys."""
    out = {}
    for i, x in enumerate(items, 1):
        if isinstance(x, str):
            out[f"file_{i}.py"] = x
        elif isinstance(x, dict):
            name = next((x[k] for k in NAME_KEYS if k in x), None)
            content = next((x[k] for k in TEXT_KEYS if k in x), None)
            if content:
                out[name or f"file_{i}.py"] = _text(content)
    return out


def files_of(data) -> dict[str, str] | None:
    """Files of a decoded reply: files, solution, code, else objects that look like sessions or files."""
    if not isinstance(data, dict):
        return None
    solution = data.get("solution")
    for found in (data.get("files"), solution.get("files", solution) if isinstance(solution, dict) else None, data.get("code")):
        if isinstance(found, list):
            return listed(found) or None
        if isinstance(found, dict):
            return flatten_sessions(found) if many_sessions(found) else {k: _text(v) for k, v in found.items()}
    sessions = {k: v for k, v in data.items() if isinstance(v, dict) and any(m in str(k).lower() for m in SESSION_MARKS)}
    plain = {n: _text(c) for k, v in data.items() if isinstance(v, dict) and k not in sessions and any(str(n).endswith(FILE_ENDINGS) for n in v) for n, c in v.items()}
    direct = {k: v for k, v in data.items() if isinstance(v, str) and str(k).endswith(FILE_ENDINGS)}
    return {**flatten_sessions(sessions), **plain, **direct} or None


def json_score(files: dict[str, str], data: dict) -> float:
    return sum(10 + min(len(c) / 100, 100) - (50 if len(c) < 50 else 0) for c in files.values()) + 20 * ("approach" in data) + 30 * ("files" in data) + 10 * ("explanation" in data)


def unescape(text: str) -> str:
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        text = text.replace(a, b)
    return text


def from_json(reply: str, language: str) -> dict[str, str] | None:
    fenced = re.findall(r"```(?:json)?\s*\n?(.*?)\n?\s*```", reply, re.DOTALL | re.IGNORECASE)
    best, top = None, 0.0
    for text in dict.fromkeys(x for part in (*fenced, reply) for x in balanced(part)):
        data = loads(text)
        files = files_of(data)
        if files and (score := json_score(files, data)) > top:
            best, top = files, score
    return best


def from_pairs(reply: str, language: str) -> dict[str, str] | None:
    found = re.findall(PAIRS[0], reply, re.DOTALL)
    if found:
        return {name: unescape(code) for name, code in found}
    return dict(re.findall(PAIRS[1], reply, re.DOTALL)) or None


def from_fences(reply: str, language: str) -> dict[str, str] | None:
    own = re.findall(rf"```(?:{FENCE_NAMES.get(language, re.escape(language))})\s*\n(.*?)```", reply, re.DOTALL | re.IGNORECASE)
    if own:
        return {f"solution_{i}.{SUFFIXES.get(language, 'go')}": c.strip() for i, c in enumerate(own, 1)}
    every = re.findall(r"```[^\n`]*\n(.*?)```", reply, re.DOTALL)
    return {f"solution_{i}.{SUFFIXES.get(detect_language(c) or language, 'go')}": c.strip() for i, c in enumerate(every, 1)} or None


def from_headers(reply: str, language: str) -> dict[str, str] | None:
    out = {}
    for mark in HEADERS:
        heads = list(re.finditer(rf"(?:^|\n){mark}", reply, re.IGNORECASE))
        for h, after in zip(heads, [*heads[1:], None]):
            body = re.sub(r"^```[^\n]*\n|\n?```\s*$", "", reply[h.end() : after.start() if after else len(reply)].strip()).strip("\n")
            if len(body) > 10:
                out[h[1].strip()] = body
    return out or None


def viable(files: dict[str, str] | None) -> bool:
    return bool(files) and any(isinstance(c, str) and len(c.strip()) >= 50 for c in files.values())


def parse_reply(reply: str | None, language: str = "go") -> dict[str, str] | None:
    for stage in (from_json, from_pairs, from_fences, from_headers):
        files = stage(reply or "", language)
        if viable(files):
            return {str(k): _text(v) for k, v in files.items()}
    return None


def parse_replies(replies: DataFrame, reply: str = "reply", language: str = "language") -> DataFrame:
    """replies with files map<string,string>, null where nothing viable is found."""

    @F.pandas_udf("map<string,string>")
    def run(text: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([parse_reply(t, x or "go") for t, x in zip(text, lang, strict=True)], dtype=object)

    return replies.withColumn("files", run(F.col(reply), F.col(language)))


def solution_files(parsed: DataFrame) -> DataFrame:
    """Long form of parsed(model, scenario_id, files): a row per file with its place."""
    return parsed.filter("files is not null").select("model", "scenario_id", F.posexplode(F.map_entries("files")).alias("file_pos", "e")).select("model", "scenario_id", "file_pos", F.col("e.key").alias("path"), F.col("e.value").alias("content"))


def first_balanced(text: Column) -> Column:
    """The object at the start of a text, up to the brace that closes it; null if it starts with none or none closes it.

    A fold over the text's marks (braces, quotes, escaped characters) and what lies between them, in the JVM.
    """
    body = F.regexp_replace(text, r"^\s+", "")
    tokens = F.regexp_extract_all(body, F.lit(r'(?s)\\.|[{}"\\]|[^{}"\\]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("length"), F.lit(False).alias("closed"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(s["quoted"], 0).when(t == "{", 1).when(t == "}", -1).otherwise(0)
        quoted = F.when(t == '"', ~s["quoted"]).otherwise(s["quoted"])
        return F.when(s["closed"], s).otherwise(F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["length"] + F.length(t)).alias("length"), (depth == 0).alias("closed")))

    end = F.aggregate(tokens, start, step, lambda s: F.when(s["closed"], s["length"]))
    return F.when(F.startswith(body, F.lit("{")), F.substring(body, F.lit(1), end))


def first_object(text: Column) -> Column:
    """First JSON object of a text, as VARIANT: the text itself, what a fence holds or the object that it starts with, or the
    first object from a brace on."""
    fence = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1), F.lit(""))
    rest = F.nullif(F.regexp_extract(text, r"(?s)(\{.*)", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(fence), F.try_parse_json(first_balanced(fence)), F.try_parse_json(first_balanced(rest)))


def fences(text: Column) -> Column:
    """Bodies of the code fences of a text, stripped."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```[^\n`]*\n(.*?)```"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def sanitised(solution: str | None) -> dict[str, str]:
    """Files of a solution given as JSON: texts stay, objects and lists become JSON text, all else its text; {} if it is no object."""
    try:
        data = json.loads(solution or "")
    except ValueError:
        return {}
    if not isinstance(data, dict):
        return {}
    return {k: v if isinstance(v, str) else json.dumps(v, indent=2) if isinstance(v, (dict, list)) else str(v) for k, v in data.items()}


def sanitise(solution: Column) -> Column:
    """map<string,string> of sanitised()."""

    @F.pandas_udf("map<string,string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(sanitised)

    return run(solution)
