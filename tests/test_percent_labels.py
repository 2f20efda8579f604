"""Labels of percent changes are those of C printf, whatever the ratio."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import text


def test_labels_equal_printf(spark):
    ratios = [0.9996, 0.999855, 1.0, 1.0635, 0.9375, 1.0625, 1.1235, 0.2375, 3.00005, 12345.6785, 1e-9, *[1 + i / 1e6 for i in range(-6000, 6000, 7)],
              *[i / 2000 for i in range(1, 4000)]]
    out = spark.createDataFrame([(r,) for r in ratios], "r double").select("r", text.percent_change_label(F.col("r")).alias("label"))
    wrong = [(r, label, "%.1f%%" % (100.0 * (r - 1.0))) for r, label in out.collect() if label != "%.1f%%" % (100.0 * (r - 1.0))]
    assert wrong == []


def test_missing_and_endless_ratios_keep_their_labels(spark):
    values = [None, float("nan"), float("inf"), 1e20]
    out = spark.createDataFrame([(v,) for v in values], "r double").select(text.percent_change_label(F.col("r")).alias("label"))
    assert [r["label"] for r in out.collect()] == ["n%", "NaN%", "Infinity%", "10000000000000000000000.0%"]
