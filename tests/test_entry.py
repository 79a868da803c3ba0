import __spark_entry__


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_filters_and_columns(spark):
    plan = __spark_entry__.queries()["model_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "props" not in scan and "value" in scan
