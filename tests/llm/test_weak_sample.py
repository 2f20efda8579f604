"""What reaches the one task that trains the scorer of weak labels."""

from __future__ import annotations

import numpy as np
import pandas as pd

from helpers import sentence
from panelweave.llm import weak_labels


def rows_of_a_hot_id(spark):
    rows = [(k, sentence(k, 40)) for k in range(40)]
    rows += [(7, sentence(7, 40))] * 300 + [(8, sentence(500, 30))] * 300 + [(9, " ".join(sentence(k, 90) for k in range(300)))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_training_sees_one_bounded_row_an_id(spark, monkeypatch):
    def fit(key, rows):
        most = max((len(x) for x in rows.drop(columns=["posterior", "all"]).iloc[:, 0]), default=0)
        return pd.DataFrame({"weights": [np.array([len(rows), most] + [0.0] * weak_labels.WIDTH)[: weak_labels.WIDTH + 1].astype("<f8").tobytes()]})

    seen = []
    monkeypatch.setattr(weak_labels, "_fit", fit)
    real = np.frombuffer
    monkeypatch.setattr(weak_labels.np, "frombuffer", lambda data, *a, **k: seen.append(real(data, *a, **k)) or seen[-1])
    found, _ = weak_labels.quality(rows_of_a_hot_id(spark))
    rows, most = seen[-1][:2]
    assert rows == 40 and most <= 10 * (2 * weak_labels.WIDTH + 1)
    monkeypatch.undo()
    assert weak_labels.quality(rows_of_a_hot_id(spark))[0].count() == 641


def test_packed_features_are_those_of_the_text():
    import pyarrow as pa

    texts = [sentence(1, 30), "", "one one One"]
    (batch,) = weak_labels._packed_features(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["id", "text"])]))
    row, place, value = weak_labels.features([t.encode() for t in texts])
    for k, data in enumerate(batch.column("seen").to_pylist()):
        n = len(data) // 10
        assert np.frombuffer(data, "<u2", n).tolist() == place[row == k].tolist()
        assert np.frombuffer(data, "<f8", n, 2 * n).tolist() == value[row == k].tolist()
