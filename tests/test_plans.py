"""Registered queries over small tables of their own."""

from pyspark.sql import functions as F

from heddle.functions import wordlists as W
from heddle.operators import metrics, selection
from heddle.plans import QUERIES, code


def test_lengths_are_rounded_as_sql_rounds(spark, tmp_path):
    rows = [(4, 19999.4), (8, 19999.5), (12, 59999.5), (1, 19999.5), (5, 20000.5), (9, None), (13, 149999.7), (3, 19999.49)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.difficulty for r in QUERIES["difficulty_of_length"](spark, str(tmp_path)).collect()}
    assert got == {4: "easy", 8: "easy", 12: "medium", 1: "medium", 5: "medium", 9: "expert", 13: "expert", 3: "hard"}


def test_category_relevance_goes_through_texts_once(spark, tmp_path, monkeypatch):
    rows = [(k, f"def f{k}():\n    return {k}\n" * (1 + k % 5) if k % 7 else None, "en", "ab"[k % 2] if k % 5 else None) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    measured, of = [], selection.T.file_complexity
    monkeypatch.setattr(selection.T, "file_complexity", lambda c: measured.append(1) or of(c))
    got = QUERIES["category_relevance"](spark, str(tmp_path)).cache()
    assert len(measured) == 1
    assert got.count() == 40 * len(W.CATEGORIES)
    from heddle.plans import tables as D

    for c in W.CATEGORIES:
        alone = selection.rank_files(D.named_files(spark, str(tmp_path)), c).select("project", "path", "score", "rank").collect()
        assert sorted(map(str, got.filter(F.col("category") == c).select("project", "path", "score", "rank").collect())) == sorted(map(str, alone))


def test_copies_of_a_file_are_measured_once(spark):
    rows = [("m", str(k), 0, "a.py", "assert x\n# global\n") for k in range(50)] + [("m", "0", 1, "a.py", None), ("m", "0", 2, None, ""), ("m", "1", 1, "test.py", "func f\n"), ("n", "1", 0, None, None)]
    files = spark.createDataFrame(rows, "model string, scenario_id string, file_pos int, path string, content string")
    x = metrics.text_metrics(files)
    got = {(r.model, r.scenario_id): r for r in x.collect()}
    assert len(got) == 51 and (got["m", "0"].n_files, got["m", "1"].n_files, got["n", "1"].n_files) == (3, 2, 1)
    assert (got["m", "1"].n_lines, got["m", "1"].func_words, got["m", "1"].comment_lines, got["m", "2"].comment_lines) == (5, 1, 1, 1)
    assert got["m", "1"].test_indication == 0.8 and got["m", "2"].test_indication == 0.4 and got["n", "1"].n_lines is None
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    texts = [line for line in plan.splitlines() if "Aggregate [model#" in line]
    assert texts and not any("content" in line for line in texts)  # no text goes into the sums by solution


def test_programs_are_made_in_many_tasks(spark, tmp_path):
    spark.range(2000).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    dealt = code.code_files(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("k")).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 700
