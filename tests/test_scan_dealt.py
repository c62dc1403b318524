"""The queries of the exact scan deal a table of few splits over the cores, else one long task is the whole query."""

import pytest

from quillspark.operators.evidence import TASKS_A_CORE
from quillspark.plans.evidence import QUERIES


@pytest.mark.parametrize("name", ["reports_json", "sql_table_function", "topic_findings", "all_findings"])
def test_rows_are_dealt_before_the_scan(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("REPARTITION_BY_NUM")
    assert min(k for k in (plan.find("MapInArrow"), plan.find("PythonUDTF")) if k >= 0) < dealt
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism  # as many tasks as cores leave all waiting for the longest
    assert f", {tasks})" in plan[:dealt].rsplit("\n", 1)[-1]
