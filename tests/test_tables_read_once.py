"""Queries that need counts, cover and chosen candidates read the large tables once for all of them."""

from __future__ import annotations

import pytest

from panelweave.plans import inputs as I
from panelweave.plans import models

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["chosen_family_effects", "collate_all"])
def test_tables_are_read_once(spark, monkeypatch, name):
    read = []
    plain = I.read_table

    def told(spark, folder, table, *rest):
        read.append(table)
        return plain(spark, folder, table, *rest)

    monkeypatch.setattr(I, "read_table", told)
    models.QUERIES[name](spark, FOLDER)
    assert (read.count("lineitem"), read.count("orders")) == (1, 2)  # orders once for cover, once for counts


def test_lines_pass_one_join(spark):
    """Orders have met their units before, so the lines are dealt by one key only."""
    lines = I.cover_raw(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes = [(len(line) - len(line.lstrip(" :+-")), line) for line in lines]
    place = next(i for i, (_, line) in enumerate(nodes) if "Relation" in line and "l_orderkey" in line)
    depth, joins = nodes[place][0], 0
    for at, line in reversed(nodes[:place]):
        if at < depth:
            depth, joins = at, joins + ("Join Inner" in line)
    assert joins == 1
