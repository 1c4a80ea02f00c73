"""Scans in pieces give the rows of scans of whole sequences."""

from __future__ import annotations

import random

import pytest

from locusloom.operators import chunks, scans

MATRIX = {"m": [{"A": 1.0, "C": -1.0, "G": 0.2, "T": 0.0}, {"A": 0.3, "C": 0.9, "G": -0.7, "T": 0.1}, {"A": -0.2, "C": 0.4, "G": 1.1, "T": -1.0}]}


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_pieces_find_what_whole_scans_find(spark, size):
    rng = random.Random(size)
    rows = [(k, "".join(rng.choices("ACGTN", weights=[6, 5, 5, 6, 0.1], k=n))) for k, n in enumerate((0, 1, 2, 3, 4, 50, 301, 1200 if size > 1 else 90))]
    rows += [(20, None), (21, "ATG" + "GCA" * 70 + "TAA"), (22, "C" * 400), (23, "TTA" + "GCA" * 70 + "CAT"), (24, ("ATG" + "GCC" * 30) * 6)]
    frame = spark.createDataFrame(rows, "record_id long, seq string")
    whole, parts = scans.scan_orfs(frame, 15).collect(), chunks.scan_long_orfs(frame, 15, size).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and any(r["record_id"] == 21 for r in parts) and any(r["record_id"] == 23 and r["strand"] == -1 for r in parts)
    whole, parts = (f.select("record_id", "matrix", "start", "strand", "score").collect() for f in (scans.scan_matrices(frame, MATRIX, {"m": 1.5}), chunks.scan_long_matrices(frame, MATRIX, {"m": 1.5}, size)))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and parts


def test_pieces_of_a_batch_are_scanned_at_once_and_texts_once(spark, monkeypatch):
    """What is found does not depend on how many pieces are looked at together; the plan holds no second scan of the texts."""
    import numpy as np

    rng = random.Random(5)
    texts = ["".join(rng.choices("ACGTN", weights=[6, 5, 5, 6, 0.1], k=n)) for n in (0, 2, 3, 40, 400, 900)]
    whole = lambda k: (np.array([0] * k), np.array([len(t) for t in texts[:k]]), np.array([0] * k), np.array([len(t) for t in texts[:k]]))
    for strand in (1, -1):
        together = chunks._scan(texts, *whole(6), strand, 15)[0]
        alone = [chunks._scan([t], *(np.array([v]) for v in (0, len(t), 0, len(t))), strand, 15)[0] for t in texts]
        assert [x.tolist() for x in together[1:]] == [np.concatenate([a[j] for a in alone]).tolist() for j in (1, 2, 3)] and len(together[0])
    found = chunks.scan_long_orfs(spark.createDataFrame([(1, texts[-1])], "record_id long, seq string"), 15, 100)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
