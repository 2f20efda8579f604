"""Archives of a whole table: files end by compressed size, shards by quantiles of ids, copies are revisits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import warc
from panelweave.llm.common import new_folder

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    whole = spark.read.parquet(f"{FOLDER}/pages.parquet")
    copies = whole.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1_000_000)
    return whole.unionByName(copies).unionByName(copies.withColumn("page_id", F.col("page_id") + 1_000_000))


def test_files_roll_by_compressed_size_and_copies_are_revisits(spark, pages):
    folder, limit = new_folder(spark), 40_000
    manifest = warc.write_archives(pages, folder, shard_bytes=500_000, file_bytes=limit)
    files = manifest.toPandas().sort_values(["shard", "part"])
    last = files.groupby("shard")["part"].transform("max") == files["part"]
    assert (files.loc[~last, "bytes"] >= limit).all() and files["bytes"].max() < limit + 40_000
    assert files["shard"].nunique() >= 2 and (files.groupby("shard").size() > 1).any()
    got = warc.read_archives(manifest, folder).toPandas().set_index("page_id")
    want = pages.toPandas()
    want["html"] = want["html"].fillna("")
    want["first"] = want.groupby("html")["page_id"].transform("min")
    assert len(got) == len(want) and (want["first"] != want["page_id"]).sum() > 100
    for row in want.itertuples():
        record = got.loc[row.page_id]
        if row.first == row.page_id:
            assert record["record_type"] == "response" and bytes(record["payload"]).decode() == row.html
        else:
            assert record["record_type"] == "revisit" and record["refers_to"] == row.first


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_splitters_are_quantiles(spark, shards):
    values = [5, 5, 5, 5, 9, *range(100, 400, 3)]
    ids = spark.createDataFrame([(v,) for v in values] + [(None,)], "id long")
    found = np.sort(np.array(values))
    want = sorted(set(found[np.arange(1, shards) * len(found) // shards].tolist()))
    assert warc._splitters(ids, shards, per_shard=1000) == want
    assert warc._splitters(ids.repartition(6), shards, per_shard=1000) == want
    assert warc._splitters(ids.limit(0), shards) == []
