"""Plan-shape regressions for the registered queries (scale properties)."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

PY_NODES = r"^\(\d+\) (?:BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|PythonUDF)"
FULL_COLUMNS = {"lineitem": 11, "events": 6, "orders": 6, "part": 6}


def _plan(spark, name):
    df = E.queries()[name](spark, SF001)
    df.write.format("noop").mode("overwrite").save()
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["p4_poisson_posterior", "p3_bandit_posterior", "p6_hazard_posterior",
                                  "a7_weibull_suffstats", "v2_timeline_density", "n7_trial_sequence",
                                  "a2_ab_suffstats", "l1_list_events"])
def test_no_python_and_pruned_scans(spark, name):
    plan = _plan(spark, name)
    assert not re.search(PY_NODES, plan, re.M), "Python evaluation in a hot path"
    for block in re.split(r"\n(?=\(\d+\) )", plan):
        if not re.match(r"\(\d+\) Scan parquet", block):
            continue
        table = re.search(r"Location: \w+ \[.*?/(\w+)\.parquet\]", block).group(1)
        cols = re.search(r"ReadSchema: struct<(.*)>", block).group(1).count(":")
        assert cols < FULL_COLUMNS.get(table, 99), f"{name} reads every column of {table}"


def test_window_filter_reaches_the_scan(spark):
    plan = _plan(spark, "p4_poisson_posterior")
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
