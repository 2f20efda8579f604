"""The panel takes every unit of the tables; what has counts but no cover is shown on a small fixture."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelweave.plans import inputs as I

FOLDER = "/root/testdata/sf0.001"


def test_no_line_is_left_out(spark):
    assert I.cover_raw(spark, FOLDER).agg(F.sum("n_points")).first()[0] == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Three customers: counts and cover, counts only (an order without lines), cover only (an order of 2001)."""
    folder = str(tmp_path_factory.mktemp("small"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")

    put("region", [(0, "REEF")], "r_regionkey int, r_name string")
    put("nation", [(0, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(1, "C8", 0), (2, "C9", 0), (3, "C7", 0)], "c_custkey long, c_name string, c_nationkey int")
    put("orders", [
        (k, c, "F", 1.0, "1-URGENT", datetime(y, 5, 1)) for k, c, y in ((1, 1, 1996), (2, 2, 1996), (3, 2, 1996), (4, 3, 2001))
    ], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate timestamp_ntz")
    put("lineitem", [(1, "A", "F"), (1, "N", "F"), (4, "R", "O")], "l_orderkey long, l_returnflag string, l_linestatus string")
    return folder


def test_counts_without_cover_stay_in_the_join(spark, small):
    found = {r["transect_no"]: (r["Priority_urgent"], r["hc"], r["reef_name"]) for r in I.join_panel(spark, small).collect()}
    assert found == {"8": (1.0, 50.0, "REEF"), "9": (2.0, None, "REEF"), "7": (None, 100.0, None)}
    assert {r["transect_no"] for r in I.panel_keys(spark, small).collect()} == {"8", "7"}
