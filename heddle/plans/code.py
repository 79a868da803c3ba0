"""Queries over code: short programs in three languages, one per part, as the files of solutions.

The SQL states each score from the lines and texts of the programs by itself; only word lists are shared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import wordlists as W
from heddle.operators import metrics, parsing
from heddle.plans import tables as D

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


PROGRAMS = [
    ("src/store.py", "import os\nimport json\nfrom app import plugin\n\nclass Repository(Base):\n    \"\"\"Keeps items.\"\"\"\n    def load(self, path):\n        with open(path) as f:\n            return json.load(f)\n\n    def save_item(self, item):\n        assert item\n        if len(item) > 3:\n            raise ValueError(item)\n        return validate(item)\n"),
    ("src/run.py", "from app.service import *\nimport os, sys\n\ndef main():\n    # start\n    data = sorted(set(range(10)))\n    for i, x in enumerate(data):\n        print(i, x)\n    return os.system('ls')\n\ndef helper(a, b):\n    return main() + other(a)\n\ndef third():\n    pass\n"),
    ("tests/test_store.py", "import unittest\nfrom store import Repository\n\nclass StoreTest(unittest.TestCase):\n    def test_load(self):\n        self.assertEqual(Repository().load('x'), {})\n        f = open('y')\n        f.close()\n"),
    ("cmd/main.go", "package main\n\nimport \"fmt\"\n\n// Handler handles requests\ntype Handler interface {\n\tServe(input string) error\n}\n\ntype readOnlyStore struct {\n\tmutex sync.Mutex\n\tversion int\n}\n\nfunc NewStore(config Config) *readOnlyStore {\n\tlocalCopy := config\n\tgo worker(channel)\n\treturn &readOnlyStore{}\n}\n\nfunc main() {\n\tfmt.Println(len(os.Args))\n}\n"),
    ("web/app.js", "const express = require('express')\nlet userName = 'x'\n\nfunction handleRequest(request) {\n  const response = transform(request)\n  try {\n    return response.map(encode)\n  } catch (error) {\n    retry(error)\n  }\n}\n\nclass EventListener extends Base {\n  notify(event) { this.queue.push(event) }\n}\n"),
    ("src/cache.py", "import time\nimport numpy\nimport re\n\nfrom functools import lru_cache\n\n@lru_cache\nasync def fetch_data(url):\n    await pool.get(url)\n    return {k: v for k, v in zip([], [])}\n\ndef hash_password(p):\n    import hashlib\n    return hashlib.sha256(p.strip()).hexdigest()\n\nglobal_state = eval('1')\n"),
    ("README.md", "# Store\n\nThis module is backward compatible with v1; the api is extended, nothing is removed.\n\nUse the Docker image to deploy.\n"),
    ("config/settings.yaml", "version: 2\noption: value\nenv: ENVIRONMENT\n"),
]
FIELDS = "p(k, path, program) AS (VALUES " + ", ".join("({}, '{}', '{}')".format(k, a, b.replace("'", "''")) for k, (a, b) in enumerate(PROGRAMS)) + ")"
PICK = "(p_partkey * 7 + p_partkey // 5) % 8"
CODE = f"""{FIELDS}, f AS (SELECT CAST(p_partkey % 3 AS VARCHAR) AS model, CAST(p_partkey // 12 AS VARCHAR) AS scenario_id, CAST(p_partkey // 3 % 4 AS INT) AS file_pos, path, concat(program, '# ', p_partkey % 11, chr(10)) AS content FROM part JOIN p ON k = {PICK}),
x AS (SELECT *, lower(content) AS low, lower(path) AS lpath, string_split(content, chr(10)) AS l FROM f)"""


def code_files(spark, sf_dir):
    k = F.col("p_partkey")
    pick = ((k * 7 + F.floor(k / 5)) % 8 + 1).cast("int")
    of = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in PROGRAMS]), pick)
    # Programs are far longer than the numbers they are made from: these are dealt out first, or few tasks would hold all programs.
    parts = D.read(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(
        (k % 3).cast("string").alias("model"), F.floor(k / 12).cast("string").alias("scenario_id"), (F.floor(k / 3) % 4).cast("int").alias("file_pos"),
        of(0).alias("path"), F.concat(of(1), F.lit("# "), (k % 11).cast("string"), F.lit("\n")).alias("content"),
    )


def _lit(w: str) -> str:
    return "'" + w.replace("'", "''") + "'"


def hits(words, c="low"):
    return "(" + " + ".join(f"CAST(contains({c}, {_lit(w)}) AS INT)" for w in words) + ")"


def has(words, c="low"):
    return "(" + " OR ".join(f"contains({c}, {_lit(w)})" for w in words) + ")"


def groups(table, c="low"):
    return "(" + " + ".join(f"CAST({has(w, c)} AS INT)" for w in table.values()) + ")"


def yes(test, w):
    return f"CASE WHEN {test} THEN {w} ELSE 0 END"


def found(patterns):
    return "(" + " + ".join(f"len(regexp_extract_all(content, {_lit('(?i)' + p)}))" for p in patterns) + ")"


def strip(v):
    return rf"regexp_replace({v}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


IS_IMPORT = f"regexp_matches({strip('v')}, '^(import |from )')"
IMPORTS = f"list_filter(l, lambda v: {IS_IMPORT})"
OWN = f"list_filter(l, lambda v: {strip('v')} <> '')"


def at(test, of="l"):
    return f"list_filter(list_transform({of}, lambda v, i: CASE WHEN {test} THEN i END), lambda i: i IS NOT NULL)"


STANDARD = has(W.STANDARD_MODULES, "v")
GROUPED = f"coalesce(list_max({at(STANDARD, IMPORTS)}) < list_min({at('NOT ' + STANDARD, IMPORTS)}), true)"
BREAKS = at(f"NOT ({IS_IMPORT} OR {strip('v')} = '' OR starts_with({strip('v')}, '#'))")
HEAD_END = f"coalesce(list_max(list_filter({at(IS_IMPORT)}, lambda i: i < coalesce(list_min({BREAKS}), 1000000))) - 1, 0)"
CLASSES, FUNCTIONS = at(r"regexp_matches(v, '^\s*class ')"), at(r"regexp_matches(v, '^\s*def ')")
ORDERED = f"coalesce(list_max({CLASSES}) < list_min({FUNCTIONS}), true)"
NAMED = r"regexp_extract_all(content, 'interface\s+([A-Za-z]+)', 1)"
PROPER = f"len(list_filter({NAMED}, lambda v: regexp_matches(v, '(er|able|Interface)$')))"
MUTATIONS = " + ".join(f"CAST((length(content) - length(replace(content, {_lit(m)}, ''))) / {len(m)} AS INT)" for m in W.MUTATIONS)
S, B = W.STATE, W.COMPATIBILITY
PER_FILE = {
    "pattern_consistency": "least(" + " + ".join(f"least({hits(w)} / {len(w)}, 0.3)" for w in W.ARCHITECTURE.values()) + rf" + {yes(r'''len(regexp_extract_all(content, 'class\s+\w+')) > 0 OR len(regexp_extract_all(content, 'def\s+\w+')) > 2''', 0.3)} + {yes(r'''len(list_filter(l, lambda v: regexp_matches(v, '^(    |\t)'))) > 0.3 * len(l)''', 0.2)}, 1)",
    "file_organization": f"{yes(f'len({IMPORTS}) <= 10', 0.3)} + {yes(ORDERED, 0.3)} + {yes(f'len(l) - len({OWN}) < 0.3 * len(l)', 0.2)} + {yes(has(['#', chr(34) * 3], 'content'), 0.2)}",
    "dependency_structure": f"CASE WHEN len({IMPORTS}) > 0 THEN {yes(GROUPED, 0.4)} + 0.3 + {yes(f'len(list_filter({IMPORTS}, lambda v: contains(v, {_lit(chr(42))}))) = 0', 0.3)} ELSE 0 END",
    "dependency_order": f"CASE WHEN {HEAD_END} < least(10, len(l) // 4) THEN 1.0 ELSE 0.5 END",
    "interface_usage": f"least(0.25 * {groups(W.INTERFACES)} + 0.2 * coalesce({PROPER} / nullif(len({NAMED}), 0), 0), 1)",
    "state_management": f"greatest({yes(has(S['immutability']), 0.3)} - {yes(has(S['shared_state']), 0.1)} + {yes(has(S['state_isolation']), 0.3)} + {yes(has(S['state_validation']), 0.1)} - {yes(f'({MUTATIONS}) > 10', 0.2)}, 0)",
    "coordination": f"least(0.25 * {groups(W.COORDINATION)}, 1)",
    "modification": f"least(0.25 * {groups(W.MODIFICATION)} + {yes(has(['version', 'changelog']), 0.1)}, 1)",
    "data_flow": f"least(0.2 * {groups(W.DATA_FLOW)} + 0.4 * ({' + '.join(f'CAST({has(w)} AS INT)' for w in W.FLOW_STEPS)}) / 3, 1)",
    "compatibility": "least(" + " + ".join(yes(has(w), 0.1 if k == "deprecation" else 0.3) for k, w in B.items()) + f" + {yes('contains(low, ' + _lit('api') + ') AND NOT contains(low, ' + _lit('breaking') + ')', 0.2)}, 1)",
    "reuse": f"least(0.25 * {groups(W.REUSE)}, 1)",
    "extension": f"least(0.25 * {groups(W.EXTENSION)} + {yes(has(W.CONFIGURABLE), 0.15)} + {yes(has(W.MODULAR), 0.1)}, 1)",
    "disruption": f"greatest(0.3 * {hits(W.DISRUPTION['non_breaking'])} + 0.2 * {hits(W.DISRUPTION['isolation'])} - 0.2 * {hits(W.DISRUPTION['breaking_changes'])}, 0)",
    "readability": rf"CASE WHEN len({OWN}) = 0 THEN 0.5 ELSE (greatest(1 - (list_sum(list_transform({OWN}, lambda v: length(v))) / len({OWN}) - 80) / 80, 0) + least(5 * len(list_filter({OWN}, lambda v: regexp_matches(v, '^\s*#'))) / len({OWN}), 1)) / 2 END",
}


@query(f"WITH {CODE} SELECT path, content, count(*) AS n, {', '.join(f'round(any_value({v}), 9) AS {k}' for k, v in PER_FILE.items())} FROM x GROUP BY path, content")
def file_metrics(spark, sf_dir):
    scores = {k: F.round(v.cast("double"), 9).alias(k) for k, v in metrics.file_scores(F.col("content")).items()}
    x = code_files(spark, sf_dir).groupBy("path", "content").agg(F.count(F.lit(1)).alias("n"))
    return x.select("path", "content", "n", *[scores[k] for k in PER_FILE])


def any_of(test):
    return f"max(CAST({test} AS INT))"


def dense(patterns, scale):
    return f"least({scale} * sum({found(patterns)}) / sum(len(l)), 1)"


def indicators(words):
    return f"({' + '.join(any_of(has([w])) for w in words)}) / {len(words)}"


def shares(table):
    return f"({' + '.join(any_of(has(w)) for w in table.values())}) / {len(table)}"


MANAGED, ACQUIRED = f"sum({found(W.RESOURCE_PATTERNS)})", f"sum({found(W.ACQUISITION_PATTERNS)})"
PER_SOLUTION = {
    "approach_consistency": f"CASE WHEN count(*) < 2 THEN 0.8 ELSE ({' + '.join(f'1 / (1 + var_pop({hits(w)}))' for w in W.APPROACH.values())}) / {len(W.APPROACH)} END",
    "shared_state": f"CASE WHEN {any_of(has(['global', 'static', 'shared']))} = 1 THEN avg({PER_FILE['coordination']}) ELSE 0.8 END",
    "input_validation": dense(W.VALIDATION_PATTERNS, 10),
    "security_practices": f"greatest({shares(W.SECURITY_PRACTICES)} - least(0.2 * ({' + '.join(any_of(has([w])) for w in W.SECURITY_ISSUES)}), 0.5), 0)",
    "resource_management": f"CASE WHEN {ACQUIRED} = 0 THEN CASE WHEN {MANAGED} = 0 THEN 1.0 ELSE 0.8 END ELSE least({MANAGED} / {ACQUIRED}, 1) END",
    "test_indication": f"{yes(any_of(has(['test'], 'lpath')) + ' = 1', 0.4)} + {yes(f'sum({found(W.ASSERTION_PATTERNS)}) > 0', 0.4)} + {yes(any_of(has(W.TEST_FRAMEWORKS)) + ' = 1', 0.2)}",
    "configuration": f"0.25 * ({any_of(has(W.CONFIG_FILES, 'lpath'))} + {any_of(has(W.ENVIRONMENT_WORDS, 'content'))} + {any_of(has(W.BUILD_FILES, 'lpath'))} + {any_of(has(W.DEPLOY_WORDS))})",
    "algorithm_efficiency": f"greatest(({' + '.join(any_of(f'regexp_matches(content, {_lit(p)})') for p in W.EFFICIENT_PATTERNS)}) / {len(W.EFFICIENT_PATTERNS)} - least(0.1 * sum({found(W.INEFFICIENT_PATTERNS)}), 0.5), 0)",
    "design_patterns": shares(W.DESIGN),
    "performance": dense(W.OPTIMIZATION_PATTERNS, 20),
    "modern_practices": indicators(W.MODERN),
    "scalability": indicators(W.SCALABILITY),
    "integration": indicators(W.INTEGRATION),
    "extensibility": dense(W.EXTENSIBILITY_PATTERNS, 10),
    "has_readme": any_of(has(["readme"], "lpath")),
    "comment_lines": f"sum(len(list_filter(l, lambda v: starts_with({strip('v')}, '#'))))",
    "func_words": "sum((length(low) - length(replace(low, 'func ', ''))) / 5)",
    "pattern_consistency": f"avg({PER_FILE['pattern_consistency']})",
    "state_management": f"least(avg({PER_FILE['state_management']}), 1)",
}


@query(f"WITH {CODE} SELECT model, scenario_id, count(*) AS n_files, {', '.join(f'round(CAST({v} AS DOUBLE), 9) AS {k}' for k, v in PER_SOLUTION.items())} FROM x GROUP BY model, scenario_id")
def solution_metrics(spark, sf_dir):
    x = metrics.text_metrics(code_files(spark, sf_dir))
    return x.select("model", "scenario_id", "n_files", *[F.round(F.col(k).cast("double"), 9).alias(k) for k in PER_SOLUTION])


WORD = "([a-zA-Z_][a-zA-Z0-9_]*)"


@query(rf"""WITH {CODE}, d AS (SELECT DISTINCT model, scenario_id, unnest(list_concat(regexp_extract_all(content, 'def\s+{WORD}', 1), regexp_extract_all(content, 'class\s+{WORD}', 1))) AS name FROM x),
c AS (SELECT model, scenario_id, file_pos, unnest(regexp_extract_all(content, '{WORD}\s*\(', 1)) AS name FROM x),
s AS (SELECT c.model, c.scenario_id, file_pos, avg(CASE WHEN d.name IS NOT NULL OR c.name IN ({', '.join(_lit(b) for b in W.BUILTIN_FUNCTIONS)}) THEN 1.0 ELSE 0.0 END) AS share FROM c LEFT JOIN d ON d.model = c.model AND d.scenario_id = c.scenario_id AND d.name = c.name GROUP BY ALL)
SELECT x.model, x.scenario_id, round(avg(coalesce(share, 0)), 9) AS "references" FROM x LEFT JOIN s USING (model, scenario_id, file_pos) GROUP BY ALL""")
def cross_references(spark, sf_dir):
    return metrics.cross_references(code_files(spark, sf_dir)).select("model", "scenario_id", F.round("references", 9).alias("references"))


STYLE = "CASE WHEN contains(name, '_') AND lower(name) = name AND regexp_matches(name, '[a-z]') THEN 's' WHEN regexp_matches(name, '^[a-z].*[A-Z]') THEN 'c' WHEN regexp_matches(name, '^[A-Z]') THEN 'p' ELSE 'o' END"
NAMES = rf"n AS (SELECT model, scenario_id, file_pos, unnest(list_concat({', '.join(f'regexp_extract_all(content, {_lit(p)}, 1)' for p in (rf'func\s+{WORD}', rf'var\s+{WORD}', rf'type\s+{WORD}'))}, {', '.join(f'regexp_extract_all(content, {_lit(p)}, 1)' for p in (rf'def\s+{WORD}', rf'{WORD}\s*:?='))})) AS name FROM x), y AS (SELECT *, {STYLE} AS style FROM n)"


@query(f"""WITH {CODE}, {NAMES}, c AS (SELECT model, scenario_id, style, count(*) AS n FROM y GROUP BY ALL), m AS (SELECT model, scenario_id, least(1.2 * max(n) / sum(n), 1) AS naming FROM c GROUP BY ALL)
SELECT DISTINCT x.model, x.scenario_id, round(coalesce(naming, 0.5), 9) AS naming FROM x LEFT JOIN m USING (model, scenario_id)""")
def naming_mix(spark, sf_dir):
    return metrics.naming_mix(code_files(spark, sf_dir)).select("model", "scenario_id", F.round("naming", 9).alias("naming"))


#: Prompts that ask for changes, for every second scenario.
ASKS = " ".join([W.MODIFY_WORDS[0], W.COMPATIBILITY_WORDS[0], W.DISRUPTION_WORDS[0]]).lower()
MEANS = ", ".join(f"{'least(' * (k == 'disruption')}avg({PER_FILE[k]}){', 1)' * (k == 'disruption')} AS {k}" for k in ("pattern_consistency", "file_organization", "dependency_structure", "interface_usage", "modification", "data_flow", "compatibility", "reuse", "extension", "disruption"))
TEXTUAL = ("shared_state", "algorithm_efficiency", "design_patterns", "performance", "modern_practices")
COMPOSED = {
    "architectural_coherence": "0.4 * pattern_consistency + 0.3 * file_organization + 0.2 * naming + 0.1 * dependency_structure",
    "cross_file_reasoning": "0.35 * interface_usage + 0.3 * shared_state + 0.25 * CASE WHEN asks THEN modification ELSE 0.6 END + 0.1 * data_flow",
    "innovation": "0.3 * algorithm_efficiency + 0.25 * design_patterns + 0.25 * performance + 0.2 * modern_practices",
    "incremental_development": "0.4 * CASE WHEN asks THEN compatibility ELSE 0.7 END + 0.3 * greatest(reuse - 0.5 * (n_filled - n_distinct) / n_filled, 0) + 0.2 * extension + 0.1 * CASE WHEN asks THEN disruption ELSE 0.7 END",
}


@query(f"""WITH {CODE}, {NAMES}, c AS (SELECT model, scenario_id, style, count(*) AS n FROM y GROUP BY ALL), m AS (SELECT model, scenario_id, least(1.2 * max(n) / sum(n), 1) AS naming FROM c GROUP BY ALL),
o AS (SELECT model, scenario_id, unnest(list_transform({OWN}, lambda v: {strip('v')})) AS line FROM x), u AS (SELECT model, scenario_id, count(*) AS n_filled, count(DISTINCT line) AS n_distinct FROM o GROUP BY ALL),
t AS (SELECT model, scenario_id, CAST(scenario_id AS INT) % 2 = 0 AS asks, {MEANS}, {', '.join(f'{PER_SOLUTION[k]} AS {k}' for k in TEXTUAL)} FROM x GROUP BY ALL),
j AS (SELECT t.*, coalesce(naming, 0.5) AS naming, n_filled, n_distinct FROM t LEFT JOIN m USING (model, scenario_id) LEFT JOIN u USING (model, scenario_id))
SELECT model, scenario_id, {', '.join(f'round(CAST(least(greatest({v}, 0), 1) AS DOUBLE), 9) AS {k}' for k, v in COMPOSED.items())} FROM j""")
def solution_compositions(spark, sf_dir):
    """Those of the composed scores that texts alone give."""
    files = code_files(spark, sf_dir)
    x = metrics.text_metrics(files).join(metrics.naming_mix(files), metrics.KEYS, "left").join(metrics.line_duplication(files), metrics.KEYS, "left")
    x = x.withColumn("_prompt", F.when(F.col("scenario_id").cast("int") % 2 == 0, ASKS).otherwise(""))
    scores = metrics.compositions()
    return x.select("model", "scenario_id", *[F.round(scores[k], 9).alias(k) for k in COMPOSED])


SOLUTION = """concat('{"a.py": "x = ', p_partkey, '", "b": {"k": [1, ', p_partkey, ']}, "c": ', p_partkey, ', "d": null}')"""


@query(f"""SELECT p_partkey, concat('x = ', p_partkey) AS a, concat('{{', chr(10), '  "k": [', chr(10), '    1,', chr(10), '    ', p_partkey, chr(10), '  ]', chr(10), '}}') AS b, CAST(p_partkey AS VARCHAR) AS c, 'None' AS d, 4 AS n FROM part""")
def sanitised_solutions(spark, sf_dir):
    x = D.read(spark, sf_dir, "part").select("p_partkey", parsing.sanitise(F.expr(SOLUTION)).alias("m"))
    return x.select("p_partkey", F.col("m")["a.py"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"), F.col("m")["d"].alias("d"), F.size("m").alias("n"))
