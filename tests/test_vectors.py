"""Vector search by blocks and by cells against numpy, and retrieval by embeddings with its fallback."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import retrieval, vectors


def plain(rows, asked, k):
    out = set()
    for qid, q in asked:
        scored = []
        for i, v in rows:
            if i != qid and len(v) == len(q):
                n = np.linalg.norm(q) * np.linalg.norm(v)
                scored.append((-round(float(np.dot(q, v) / n) if n else 0.0, 6), i))
        out |= {(qid, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    middles = r.normal(size=(12, 16))
    rows = [(i, (middles[i % 12] + 0.6 * r.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 16) for i in range(300)]  # copies
    rows += [(3000, [0.0] * 16), (3001, [1.0, 2.0]), (3002, [2.0, 1.0])]
    bad = [(4000, None), (4001, []), (4002, [None] * 16), (4003, [float("nan")] * 16), (None, [1.0] * 16), (4004, [float("inf")] * 16)]
    return rows, spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumns({"id": F.lit(1), "key": F.lit("k"), "d": F.lit(2)}).repartition(5).cache()


def test_exact_search(spark, table):
    rows, df = table
    asked = [x for x in rows if x[0] % 100 == 0] + [(3001, [1.0, 2.0])]
    queries = df.filter("vec_id % 100 = 0 or vec_id = 3001 or vec_id > 3999")
    got = vectors.exact_top_k(df, queries, k=7, block_rows=64, query_rows=3).collect()
    assert {tuple(r) for r in got} == plain(rows, asked, 7)


def test_exact_search_within_a_key(spark, table):
    rows, df = table
    two = df.withColumn("p", F.when(F.col("vec_id") % 2 == 0, "even"))
    got = vectors.exact_top_k(two, two.filter("vec_id in (4, 7)"), k=3, key="p", block_rows=50).collect()
    want = set().union(*(plain([x for x in rows if x[0] % 2 == p], [x for x in rows if x[0] == q], 3) for q, p in ((4, 0), (7, 1))))
    assert {tuple(r) for r in got} == want


def test_the_index_finds_nine_of_ten_and_all_with_all_cells(spark, table):
    rows, df = table
    index = vectors.CellIndex(df, sample=600)
    assert len(index.centres) > 20
    queries = df.filter("vec_id % 50 = 0")
    want = {(r[0], r[2]) for r in plain(rows, [x for x in rows if x[0] % 50 == 0], 5)}
    found = {(r.query_id, r.vec_id) for r in index.search(queries, 5).collect()}
    assert len(want & found) >= 0.9 * len(want)
    every = {tuple(r) for r in index.search(queries, 5, probes=len(index.centres)).collect()}
    assert every == plain(rows, [x for x in rows if x[0] % 50 == 0], 5)
    kept = index.blocks.selectExpr("sum(length(ids) / 8) as n").first().n
    assert kept == len(rows)


def test_nothing_to_search(spark, table):
    none = table[1].limit(0)
    assert vectors.exact_top_k(none, none).count() == vectors.exact_top_k(table[1], none).count() == 0
    assert vectors.CellIndex(none).search(table[1].limit(3)).count() == 0


@pytest.mark.parametrize("index", [False, True])
def test_retrieval_by_embeddings_and_its_fallback(spark, index):
    texts = {"a.py": "red lantern glows in the cave", "b.py": "numbers add up to totals", "c.py": "a river runs to the sea", "d.py": None}
    files = spark.createDataFrame([("p", k, v) for k, v in texts.items()], "project string, path string, content string")
    queries = spark.createDataFrame([(1, "which lantern glows"), (2, "totals of numbers"), (3, ""), (4, None)], "query_id int, prompt string")
    out = {r.query_id: r.context for r in retrieval.retrieve(files, queries, "embedding", k=1, index=index).collect()}
    assert out[1].startswith("From a.py (chunk 1, similarity: 0.") and out[1].endswith(":\nred lantern glows in the cave")
    assert out[2].startswith("From b.py (chunk 1, similarity: ") and set(out) == {1, 2}
    zeros = retrieval.retrieve(files, queries, "embedding", k=1, vectoriser=lambda ts: [[0.0, 0.0]] * len(ts)).collect()
    assert {r.query_id: r.context for r in zeros} == {1: "From a.py (chunk 1, keyword matches: 2):\nred lantern glows in the cave", 2: "From b.py (chunk 1, keyword matches: 2):\nnumbers add up to totals"}


def test_retrieval_within_projects(spark):
    files = spark.createDataFrame([("p", "a.py", "lantern"), ("q", "b.py", "lantern lantern cave"), ("q", "c.py", "sea")], "project string, path string, content string")
    queries = spark.createDataFrame([(1, "p", "lantern cave"), (2, "q", "lantern cave"), (3, "q", "..")], "query_id int, project string, prompt string")
    out = {r.query_id: r.context for r in retrieval.retrieve(files, queries, "embedding", k=1).collect()}
    assert out[1].startswith("From a.py (chunk 1, sim") and out[2].startswith("From b.py (chunk 1, sim") and out[3] == "From b.py:\nlantern lantern cave"
