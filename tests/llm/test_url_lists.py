"""URL lists that need more bits than one filter may have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelweave.llm import url_filter


@pytest.fixture
def small_filters(monkeypatch):
    monkeypatch.setattr(url_filter, "LEVEL_BITS_LIMIT", 1 << 12)
    monkeypatch.setattr(url_filter, "PART_BITS", 1 << 10)


def test_long_list_is_split_and_exact(spark, small_filters):
    universe = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = spark.range(0, 9000, 3).select(F.concat(F.lit("h"), "id").alias("key"))
    cascade = url_filter.build_cascade(universe, listed)
    assert isinstance(cascade, url_filter.SplitCascade) and cascade.parts > 10
    assert {r["key"] for r in cascade.only_listed(universe).collect()} == {f"h{i}" for i in range(0, 5000, 3)}


def test_long_list_judges_like_a_short_one(spark, small_filters, monkeypatch):
    urls = [f"http://{'www.' if i % 4 else ''}h{i}.example.com/{'en/' if i % 5 else ''}x" for i in range(3000)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[0], None, "no url", "http:///x"])], "page_id long, url string")
    listed = spark.range(0, 3000, 2).select(F.concat(F.lit("h"), "id", F.lit(".example.com")).alias("key"))
    rules = (url_filter.Rule("h2.example.com/en/", "allow"),)

    def judged():
        found = url_filter.judge_urls(pages, rules, listed).select("row.page_id", "host", "path", "rule", "verdict").collect()
        return sorted(map(tuple, found), key=lambda r: r[0])

    split = judged()
    blocked = {r[0] for r in split if r[4] == "block"}
    assert blocked == {*range(0, 3000, 2), 3000} - {2}
    monkeypatch.setattr(url_filter, "LEVEL_BITS_LIMIT", 1 << 24)
    assert judged() == split
