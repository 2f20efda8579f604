"""The median of raw summaries is picked by position."""

from __future__ import annotations

import math

import __spark_entry__ as entry
from compare import connect, differences
from panelweave.operators import summary
from test_whole_cover import FOLDER


def test_median_by_position(spark):
    values = {"a": [1.0, 2.0, 4.0], "b": [1.0, 3.0, 3.0, 8.0, None], "c": [5.0] * 100, "d": [None], None: [2.0, 6.0], "e": [0.0, 0.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, value double").repartition(4)
    out = summary.raw_log_summary(df, ["k"], 10)
    found = {r["k"]: r["log_median"] for r in out.collect()}
    assert {k: None if v is None else round(math.exp(v), 9) for k, v in found.items()} == {"a": 2.0, "b": 3.0, "c": 5.0, "d": None, None: 4.0, "e": None}
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median(" not in plan and "percentile(" not in plan


def test_query_equals_sql_over_all_rows(spark):
    sql = entry.oracle_sql()["raw_log_summary"]
    assert differences(entry.queries()["raw_log_summary"](spark, FOLDER), connect(FOLDER), sql) == []
