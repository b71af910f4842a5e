"""Plan properties: pruning and pushdown reach the scans, hot paths stay JVM-side."""

import os

import pytest

from parley.plans import catalog

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_clean_all_prunes_and_pushes_down(spark):
    plan = physical(catalog.queries()["clean_all"](spark, SF))
    # the events scan reads only the columns the chat view needs
    assert "value:double" not in plan
    # the customer scan reads two columns
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
    # cleaning is built-in expressions: no Python in the batch cleaning path
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_rouge_n_has_no_python_and_no_ngram_shuffle(spark):
    from parley.operators import evaluate as ev
    df = spark.createDataFrame([(1, "a b c", "a b d")], "seq long, pred string, label string")
    plan = physical(ev.rouge_n(df, 2))
    assert "Exchange" not in plan and "EvalPython" not in plan
