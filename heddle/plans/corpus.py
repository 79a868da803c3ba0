"""Queries over texts as project files (documents, pages, embeddings, benchmark)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W
from heddle.operators import metrics, retrieval, security, selection, vectors
from heddle.plans import tables as D

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINES = "string_split(content, chr(10))"
STRIP = r"regexp_replace({0}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
FILLED = f"list_filter(list_transform({LINES}, lambda x: {STRIP.format('x')}), lambda x: x <> '')"
RAW = f"list_filter({LINES}, lambda x: {STRIP.format('x')} <> '')"
AVG_LEN = f"coalesce(list_sum(list_transform({RAW}, lambda x: length(x))) / nullif(len({RAW}), 0), 0)"
COMMENTS = rf"len(list_filter({LINES}, lambda x: regexp_matches(x, '^\s*(//|#)'))) / len({LINES})"
COMPLEXITY = rf"round(least(1.0, len({FILLED}) / 100 * 0.6 + coalesce(len(list_filter({RAW}, lambda x: regexp_matches(x, '^\s*#|//'))) / nullif(len({RAW}), 0), 0) * 0.2 + {AVG_LEN} / 80 * 0.2), 2)"


@query(f"""WITH {D.FILES} SELECT path, len({LINES}) AS n_lines, len({FILLED}) AS n_filled, round({AVG_LEN}, 6) AS line_length, round({COMMENTS}, 6) AS comment_share FROM f""")
def document_line_stats(spark, sf_dir):
    c = F.col("content")
    return D.files(spark, sf_dir).select("path", T.n_lines(c).cast("bigint").alias("n_lines"), T.n_filled_lines(c).cast("bigint").alias("n_filled"), F.round(T.line_length(c), 6).alias("line_length"), F.round(T.comment_share(c), 6).alias("comment_share"))


@query(f"WITH {D.FILES} SELECT path, {COMPLEXITY} AS complexity FROM f")
def document_complexity(spark, sf_dir):
    return D.files(spark, sf_dir).select("path", T.document_complexity(F.col("content")).alias("complexity"))


#: The documents with white space for what is no ASCII letter, digit or mark: word boundaries then agree in all engines.
def _ascii(c):
    return F.regexp_replace(c, r"[^\x00-\x7F]", " ")


ASCII = r"regexp_replace(content, '[^\x00-\x7F]', ' ', 'g')"


def _count(patterns: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(t, '(?i){p}'))" for p in patterns)


P = W.CODE_PATTERNS["python"]
SIMPLE = rf"""s AS (SELECT path, project, array_to_string(list_filter(list_transform(string_split({ASCII}, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> ''), chr(10)) AS t, len(string_split(content, chr(10))) AS n FROM f),
c AS (SELECT path, project, n AS lines_of_code, len(string_split(t, chr(10))) AS nloc, 1.0 + {_count(P['control'])} AS cc, {_count(P['functions'])} AS functions, {_count(P['classes'])} AS classes,
  len(regexp_extract_all(t, '[+*/=<>!&|%^~-]')) + len(regexp_extract_all(t, '\b[a-zA-Z_][a-zA-Z0-9_]*\b')) AS halstead FROM s),
m AS (SELECT *, greatest(0.0, 100 - 20 * (least(nloc / 100, 2.0) + least(cc / 10, 2.0))) AS mi FROM c)"""


@query(rf"WITH {D.FILES}, {SIMPLE} SELECT path, CAST(cc AS DOUBLE) AS cyclomatic_complexity, round(mi, 6) AS maintainability_index, CAST(halstead AS DOUBLE) AS halstead_difficulty, lines_of_code, nloc, functions AS function_count, classes AS class_count FROM m")
def simple_complexity(spark, sf_dir):
    x = D.files(spark, sf_dir).withColumn("c", T.simple_complexity(_ascii(F.col("content"))))
    whole = lambda n: F.col(f"c.{n}").cast("bigint").alias(n)
    return x.select("path", "c.cyclomatic_complexity", F.round("c.maintainability_index", 6).alias("maintainability_index"), "c.halstead_difficulty", whole("lines_of_code"), whole("nloc"), whole("function_count"), whole("class_count"))


@query(rf"""WITH {D.FILES}, {SIMPLE}, a AS (SELECT project, count(*) AS file_count, avg(cc) AS cc, avg(mi) AS mi, avg(halstead) AS h, sum(nloc) AS nloc, sum(functions) AS fn, sum(classes) AS cl, count_if(cc < 5) AS low, count_if(cc >= 5 AND cc < 15) AS medium, count_if(cc >= 15) AS high FROM m GROUP BY project)
SELECT project, file_count, round(cc, 6) AS avg_cc, round(mi, 6) AS avg_mi, round(h, 6) AS avg_halstead, CAST(nloc AS BIGINT) AS total_lines, CAST(fn AS BIGINT) AS total_functions, CAST(cl AS BIGINT) AS total_classes, CAST(low AS BIGINT) AS low, CAST(medium AS BIGINT) AS medium, CAST(high AS BIGINT) AS high,
  round(0.4 * least(cc / 20, 1.0) + 0.3 * greatest(0.0, 1 - mi / 100) + 0.2 * least(h / 50, 1.0) + 0.1 * least(nloc / 1000, 1.0), 6) AS complexity_score FROM a""")
def repository_complexity(spark, sf_dir):
    x = selection.repository_complexity(D.files(spark, sf_dir).withColumn("content", _ascii(F.col("content"))))
    r = lambda n: F.round(n, 6).alias(n)
    return x.select("project", "file_count", r("avg_cc"), r("avg_mi"), r("avg_halstead"), "total_lines", "total_functions", "total_classes", "low", "medium", "high", r("complexity_score"))


FILE_TYPE = """CASE WHEN p LIKE '%test%' OR p LIKE '%spec%' THEN 'test' WHEN p LIKE '%config%' OR p LIKE '%settings%' OR p LIKE '%.env%' OR p LIKE '%package.json%' THEN 'config' WHEN p LIKE '%readme%' OR p LIKE '%doc%' THEN 'documentation' ELSE 'source' END"""


@query(f"SELECT page_id, {FILE_TYPE} AS file_type FROM (SELECT page_id, lower(url) AS p FROM pages)")
def file_type_classify(spark, sf_dir):
    return D.read(spark, sf_dir, "pages").select("page_id", T.file_type(F.col("url")).alias("file_type"))


@query(f"""WITH {D.FILES}, c AS (SELECT project, lower(path) AS p, {COMPLEXITY} AS x FROM f), a AS (SELECT project, count(*) AS n_files, round(avg(x), 6) AS complexity, avg(CASE WHEN {FILE_TYPE} = 'documentation' THEN 1.0 ELSE 0.0 END) AS doc_share FROM c GROUP BY project),
m AS (SELECT *, CASE WHEN n_files < 10 THEN 'too few files' WHEN n_files > 100 THEN 'too many files' WHEN complexity < 0.3 THEN 'too simple' WHEN complexity > 1.0 THEN 'too complex' WHEN doc_share < 0.01 THEN 'too little documentation' ELSE 'ok' END AS message FROM a)
SELECT *, message = 'ok' AS valid FROM m""")
def project_constraints(spark, sf_dir):
    return selection.project_constraints(D.files(spark, sf_dir))


@query(f"WITH {D.FILES} SELECT project, round(sum(CASE WHEN pos % 3 = 0 THEN length(content) ELSE 0 END) / sum(length(content)), 6) AS information_coverage FROM f GROUP BY project")
def information_coverage(spark, sf_dir):
    return selection.information_coverage(D.files(spark, sf_dir), F.col("pos") % 3 == 0).select("project", F.round("information_coverage", 6).alias("information_coverage"))


def _effort() -> str:
    parts = " + ".join(f"CASE WHEN {' OR '.join(f'contains(x, {w!r})' for w in words)} THEN {v} ELSE 0 END" for words, v in W.EFFORT_WORDS)
    low = f"lower({STRIP.format('y')})"
    return f"least(list_sum(list_transform(list_transform({LINES}, lambda y: {low}), lambda x: {parts})) / len({LINES}), 1.0)"


SCORE = f"round(0.3 * least(length(content) / 10000, 1.0) + 0.2 * {_effort()}, 6)"
RANKED = f"k AS (SELECT *, {SCORE} AS score FROM f), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY score DESC, pos) AS INT) AS rank FROM k)"


@query(f"WITH {D.FILES}, {RANKED} SELECT project, path, score, rank FROM n")
def relevance_rank(spark, sf_dir):
    return selection.rank_files(D.files(spark, sf_dir), "none").select("project", "path", "score", "rank")


def _prefix(order: str, core: str, target: float) -> str:
    return f"""w AS (SELECT *, {core} AS core FROM n), b AS (SELECT *, sum(length(content)) OVER (PARTITION BY project) AS total, coalesce(sum(length(content)) OVER (PARTITION BY project ORDER BY core DESC, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT project, path FROM b WHERE core OR before / total < {target}"""


@query(f"WITH {D.FILES}, {RANKED}, {_prefix('rank', 'false', 0.3)}")
def adaptive_selection(spark, sf_dir):
    return selection.adaptive_selection(D.files(spark, sf_dir), "none", 0.3).select("project", "path")


@query(f"WITH {D.FILES}, n AS (SELECT * FROM f), {_prefix('length(content) DESC, pos', 'pos % 10 = 0', 0.5)}")
def expand_selection(spark, sf_dir):
    return selection.expand_selection(D.files(spark, sf_dir), F.col("pos") % 10 == 0, 0.5).select("project", "path")


@query(f"WITH {D.FILES}, n AS (SELECT project, path, CAST(row_number() OVER (PARTITION BY project ORDER BY length(content) DESC, pos) AS INT) AS rank FROM f) SELECT * FROM n WHERE rank <= 4")
def topk_longest(spark, sf_dir):
    return selection.longest(D.files(spark, sf_dir)).select("project", "path", "rank")


@query(f"""WITH {D.FILES}, c AS (SELECT path, round((pos % 101) / 100, 2) AS share FROM f)
SELECT path, share, CASE WHEN share BETWEEN 0.2 AND 0.4 THEN 'easy' WHEN share BETWEEN 0.4 AND 0.6 THEN 'medium' WHEN share BETWEEN 0.6 AND 0.8 THEN 'hard' WHEN share BETWEEN 0.8 AND 1.0 THEN 'expert' ELSE 'easy' END AS difficulty FROM c""")
def difficulty_from_coverage(spark, sf_dir):
    x = D.files(spark, sf_dir).select("path", F.round((F.col("pos") % 101) / 100, 2).alias("share"))
    return x.withColumn("difficulty", T.difficulty_of_coverage(F.col("share")))


def _by_category(category: str) -> str:
    """Files under names (D.NAMED) with core and score, as the category sees them."""
    core = " OR ".join(f"contains(lower(path), '{w.lower()}')" for w in W.CORE_FILES[category])
    words = " + ".join(f"CAST(contains(lower(path), '{w}') AS INT)" for w in W.RELEVANT_WORDS[category])
    return f"SELECT '{category}' AS category, *, {core} AS core, round(least({words}, 5) + 0.3 * least(length(content) / 10000, 1.0) + 0.2 * x, 6) AS score FROM f"


EFFORT = f"{D.NAMED.replace('f AS', 'g AS', 1)}, f AS (SELECT *, {_effort()} AS x FROM g)"


@query(f"""WITH {EFFORT}, k AS ({" UNION ALL ".join(_by_category(c) for c in W.CATEGORIES)})
SELECT category, project, path, core, score, CAST(row_number() OVER (PARTITION BY category, project ORDER BY score DESC, pos) AS INT) AS rank FROM k""")
def category_relevance(spark, sf_dir):
    """Every file as each of the eight categories ranks it."""
    return selection.rank_by_category(D.named_files(spark, sf_dir), W.CATEGORIES).select("category", "project", "path", "core", "score", "rank")


TRIES = [0.5, 0.4 + 0.75 * (0.6 - 0.4), 0.4 + 0.9 * (0.6 - 0.4), 0.6, 0.4]


@query(f"""WITH {EFFORT}, k AS ({_by_category("bug_investigation")}), t(attempt, target) AS (VALUES {", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(TRIES))}),
b AS (SELECT *, length(content) AS n, sum(length(content)) OVER (PARTITION BY project) AS total, coalesce(sum(length(content)) OVER (PARTITION BY project ORDER BY core DESC, score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
s AS (SELECT project, attempt, path, n, total FROM b, t WHERE core OR before / total < target),
c AS (SELECT project, attempt, least(sum(n) / any_value(total), 1.0) AS coverage FROM s GROUP BY ALL),
l AS (SELECT *, CASE WHEN coverage BETWEEN 0.2 AND 0.4 THEN 'easy' WHEN coverage BETWEEN 0.4 AND 0.6 THEN 'medium' WHEN coverage BETWEEN 0.6 AND 0.8 THEN 'hard' WHEN coverage BETWEEN 0.8 AND 1.0 THEN 'expert' ELSE 'easy' END AS level FROM c),
w AS (SELECT project, coalesce(min(CASE WHEN level = 'medium' THEN attempt END), 0) AS attempt FROM l GROUP BY project)
SELECT s.project, CAST(s.attempt AS INT) AS attempt, s.path, round(l.coverage, 6) AS coverage, l.level FROM s JOIN w ON w.project = s.project AND w.attempt = s.attempt JOIN l ON l.project = s.project AND l.attempt = s.attempt""")
def select_for_difficulty(spark, sf_dir):
    x = selection.select_for_difficulty(D.named_files(spark, sf_dir), "bug_investigation", 0.4, 0.6, "medium")
    return x.withColumn("coverage", F.round("coverage", 6))


@query(rf"""WITH RECURSIVE {D.FILES}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM f WHERE content <> ''),
w AS (SELECT path, l, 1 AS i, 0 AS idx, length(l[1]) + 1 AS n, l[1] AS t, false AS closed FROM l
  UNION ALL SELECT path, l, i + 1, CASE WHEN n + length(l[i + 1]) + 1 > 512 THEN idx + 1 ELSE idx END, CASE WHEN n + length(l[i + 1]) + 1 > 512 THEN length(l[i + 1]) + 1 ELSE n + length(l[i + 1]) + 1 END,
    CASE WHEN n + length(l[i + 1]) + 1 > 512 THEN l[i + 1] ELSE concat(t, chr(10), l[i + 1]) END, false FROM w WHERE i < len(l)),
e AS (SELECT path, CAST(idx AS INT) AS idx, max_by(t, i) AS t FROM w GROUP BY path, idx)
SELECT path, idx, length(t) AS n_chars, md5(t) AS digest FROM e""")
def chunk_lines(spark, sf_dir):
    x = retrieval.chunk_files(D.files(spark, sf_dir))
    return x.select("path", "idx", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


STOP = ", ".join(repr(w) for w in W.STOP_WORDS)


@query(rf"""WITH b AS (SELECT item_id, list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F]+', '9', 'g'), '[a-z0-9_]+'), lambda w: regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN ({STOP}))[1:10] AS k FROM benchmark),
d AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT item_id, doc_id, len(list_filter(k, lambda w: contains(t, w))) AS score FROM b, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, concat('doc_', doc_id, '.txt')) AS rank FROM s WHERE score > 0) SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS INT) AS score FROM r WHERE rank <= 5""")
def keyword_topk(spark, sf_dir):
    docs = D.files(spark, sf_dir).select("project", "path", F.lit(0).alias("idx"), F.col("content").alias("text"), "pos")
    q = D.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace(F.lower("text"), r"[^\x00-\x7F]+", "9").alias("prompt"))
    top = retrieval.best(retrieval.keyword_scores(docs, q)).join(docs.select("path", "pos"), "path")
    return top.select(F.col("query_id").alias("item_id"), "rank", F.col("pos").alias("doc_id"), "score")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(coalesce(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 0), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    v = D.read(spark, sf_dir, "embeddings")
    return retrieval.cosine_top_k(v, v.filter("vec_id % 100 = 0"))


@query(SQL["cosine_topk"].replace("rank <= 5", "rank <= 3"))
def cosine_index_topk(spark, sf_dir):
    """The same by the index of cells; so many cells are searched that nothing is missed here, which the SQL would show."""
    v = D.read(spark, sf_dir, "embeddings")
    index = vectors.CellIndex(v, cells=32)
    return index.search(v.filter("vec_id % 100 = 0"), k=3, probes=32)


@query(f"""WITH {D.FILES}, l AS (SELECT project, unnest({FILLED}) AS l FROM f), c AS (SELECT project, l, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT project, sum(n) AS n, count(*) AS d FROM c GROUP BY project)
SELECT project, CAST(n AS BIGINT) AS n_filled, d AS n_distinct, round(greatest(1 - 2 * (n - d) / n, 0.0), 6) AS dry FROM a""")
def dry_ratio(spark, sf_dir):
    x = metrics.line_duplication(D.files(spark, sf_dir), ["project"])
    return x.withColumn("dry", F.round(metrics.dry(F.col("n_filled"), F.col("n_distinct")), 6))


@query(f"""WITH {D.FILES}, l AS (SELECT path, unnest({LINES}) AS x, generate_subscripts({LINES}, 1) AS i FROM f), s AS (SELECT path, {STRIP.format('x')} AS line, i FROM l)
SELECT path, line, count(*) AS n, array_to_string(list_sort(list(CAST(i AS INT))), ',') AS lines FROM s WHERE length(line) > 10 GROUP BY path, line HAVING count(*) > 2""")
def duplicate_line_smell(spark, sf_dir):
    return security.repeated_lines(D.files(spark, sf_dir)).withColumn("lines", F.array_join(F.transform("lines", lambda i: i.cast("string")), ","))


@query(f"""WITH {D.FILES}, w AS (SELECT project, unnest(regexp_extract_all(content, '[a-zA-Z_][a-zA-Z0-9_]*')) AS w FROM f),
s AS (SELECT project, CASE WHEN contains(w, '_') AND lower(w) = w AND regexp_matches(w, '[a-z]') THEN 'snake_case' WHEN regexp_matches(w, '^[a-z].*[A-Z]') THEN 'camelCase' WHEN regexp_matches(w, '^[A-Z]') THEN 'PascalCase' ELSE 'other' END AS style FROM w)
SELECT project, style, count(*) AS n FROM s GROUP BY ALL""")
def naming_style_mix(spark, sf_dir):
    w = D.files(spark, sf_dir).select("project", F.explode(F.regexp_extract_all("content", F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))).alias("w"))
    return w.groupBy("project", T.naming_style(F.col("w")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {D.FILES} SELECT path, 0.5 + CASE WHEN {COMMENTS} > 0.1 THEN 0.2 ELSE 0 END + CASE WHEN len({LINES}) BETWEEN 50 AND 500 THEN 0.2 ELSE 0 END + CASE WHEN contains(content, 'func ') OR contains(content, 'def ') OR contains(content, 'function ') THEN 0.1 ELSE 0 END AS quality FROM f")
def quality_file_score(spark, sf_dir):
    return D.files(spark, sf_dir).select("path", F.round(T.quality_of_file(F.col("content")), 6).alias("quality"))


@query(f"""WITH {D.FILES}, n AS (SELECT project, pos % 5 = 0 AS test, len({LINES}) AS n FROM f) SELECT project, round(least(coalesce(sum(CASE WHEN test THEN n ELSE 0 END) / nullif(sum(CASE WHEN test THEN 0 ELSE n END), 0), 0), 1.0), 6) AS test_coverage FROM n GROUP BY project""")
def test_coverage_ratio(spark, sf_dir):
    f = D.files(spark, sf_dir).withColumn("path", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("Test_"), "path")).otherwise(F.col("path")))
    return security.test_coverage(f, ["project"]).select("project", F.round("test_coverage", 6).alias("test_coverage"))


RULES = security.HTML_RULES
COUNTS = {s: " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p, v, _ in RULES if v == s) or "0" for s in W.SEVERITY}


@query(f"""WITH {D.PAGES}, c AS (SELECT project, {", ".join(f"CAST(sum({x}) AS BIGINT) AS n_{s}" for s, x in COUNTS.items())} FROM p GROUP BY project), s AS (SELECT *, n_high + n_medium + n_low AS n_findings, round(greatest(1.0 - 0.3 * n_high - 0.2 * n_medium - 0.1 * n_low, 0.0), 6) AS security_score FROM c)
SELECT *, CASE WHEN security_score >= 0.8 AND n_findings = 0 THEN 'low' WHEN security_score >= 0.6 AND n_findings <= 2 THEN 'medium' ELSE 'high' END AS risk_level FROM s""")
def security_scan(spark, sf_dir):
    return security.security_score(D.pages(spark, sf_dir), RULES, ["project"])


@query(f"""WITH {D.PAGES}, l AS (SELECT page_id, unnest({LINES}) AS x, generate_subscripts({LINES}, 1) AS line FROM p), u(r, severity, description) AS (VALUES {", ".join(f"('{p}', '{s}', '{d}')" for p, s, d in RULES)}),
m AS (SELECT page_id, line, severity, description, len(regexp_extract_all(x, r)) AS n FROM l, u) SELECT page_id, CAST(line AS INT) AS line, severity, description, count(*) AS n FROM (SELECT *, unnest(range(n)) FROM m WHERE n > 0) GROUP BY ALL""")
def security_findings(spark, sf_dir):
    x = security.findings(D.pages(spark, sf_dir), RULES, key="page_id")
    return x.groupBy("page_id", "line", "severity", "description").agg(F.count(F.lit(1)).alias("n"))


WORDS = ["the", "tion", "ing", "ment", "function", "zu"]


@query(f"""WITH {D.FILES} SELECT project, round(({" + ".join(f"max(CAST(contains(lower(content), '{w}') AS INT))" for w in WORDS)}) / {len(WORDS)}, 6) AS share FROM f GROUP BY project""")
def indicator_flags(spark, sf_dir):
    return D.files(spark, sf_dir).groupBy("project").agg(F.round(metrics.indicator_share(F.col("content"), WORDS), 6).alias("share"))


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in words)


@query(f"""WITH {D.FILES}, h AS (SELECT project, {", ".join(f"{_hits(w)} AS {k}" for k, w in W.APPROACH.items())} FROM f)
SELECT project, round(({" + ".join(f"1 / (1 + var_pop({k}))" for k in W.APPROACH)}) / {len(W.APPROACH)}, 6) AS approach_consistency FROM h GROUP BY project""")
def approach_consistency(spark, sf_dir):
    parts = [1 / (1 + F.var_pop(T.hits(F.lower("content"), w).cast("double"))) for w in W.APPROACH.values()]
    return D.files(spark, sf_dir).groupBy("project").agg(F.round(sum(parts[1:], parts[0]) / len(parts), 6).alias("approach_consistency"))


@query(rf"""WITH {D.FILES} SELECT path, round(CASE WHEN len({FILLED}) > 100 THEN 0.8 ELSE 1.0 END * CASE WHEN {AVG_LEN} > 80 THEN 0.9 ELSE 1.0 END + 0.2 * {COMMENTS}, 6) AS raw, round(1 - least(({" + ".join(f"(length(content) - length(replace(content, '{w}', ''))) / {len(w)}" for w in W.BRANCH_WORDS['python'])}) / 20, 1.0), 6) AS branch FROM f""")
def maintainability(spark, sf_dir):
    c = F.col("content")
    base = F.when(T.n_filled_lines(c) > 100, 0.8).otherwise(1.0) * F.when(T.line_length(c) > 80, 0.9).otherwise(1.0)
    return D.files(spark, sf_dir).select("path", F.round(base + 0.2 * T.comment_share(c), 6).alias("raw"), F.round(T.branch_complexity(c, "python"), 6).alias("branch"))
