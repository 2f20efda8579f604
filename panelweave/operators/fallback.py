"""Families tried one after another: a later one is fitted only to the keys that all earlier ones left without a usable fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.effects import FINISHED
from panelweave.operators.fit import FitSpec, fit
from panelweave.session import Ledger, bounded_join
from panelweave.sources.candidates import Candidate


def fit_in_order(panel: DataFrame, spec: FitSpec, candidates: list[Candidate]) -> tuple[DataFrame, list[int]]:
    """The first usable fit of each key (keys, name, attempt, status), and the number of keys fitted at each stage.

    Keys in which nothing was counted are not tried again; keys for which every candidate fails are absent. The coefficient tables
    hold one row per key, so what a stage leaves over is counted there and never among the observations.
    """
    keys, ledger = list(spec.keys), Ledger(panel.sparkSession)
    found, tried, left = [], [], panel
    for attempt, candidate in enumerate(candidates, 1):
        fitted = fit(left, spec, [candidate])
        ends = ledger.keep(fitted.coef.select(*keys, "name", F.lit(attempt).alias("attempt"), "status"), f"attempt{attempt}")
        ended = F.col("status").isin(*FINISHED)
        found.append(ends.filter(ended))
        failed = ends.filter(~ended & (F.col("status") != "all_zero")).select(*keys)
        counts = ends.agg(F.count_if(F.col("status") != "all_zero"), F.count_if(~ended & (F.col("status") != "all_zero"))).first()
        tried.append(counts[0])
        if counts[1] == 0:
            break
        left = bounded_join(left, failed, keys, "left_semi", rows=counts[1])
    return reduce(DataFrame.unionByName, found), tried
