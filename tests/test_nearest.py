"""The metric index against brute force, and how much of a group it compares in full."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.operators import nearest


def brute(ids, v):
    d = np.zeros((len(ids), len(ids)))
    for k in range(v.shape[1]):
        d += (v[:, k, None] - v[None, :, k]) ** 2
    d = np.round(d, 9)
    np.fill_diagonal(d, np.inf)
    return {i: (min(ids[j] for j in np.flatnonzero(row == row.min())), row.min()) for i, row in zip(ids, d, strict=True)}


@pytest.mark.parametrize("block", [16, 512])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "TOGETHER", 300)
    rnd = np.random.default_rng(3)
    groups = {
        1: rnd.normal(size=(500, 8)), 2: np.repeat(rnd.normal(size=(6, 5)), 40, axis=0), 3: np.round(rnd.normal(size=(300, 3))), 4: np.array([[1.0, 2.0]]), 5: np.array([[1.0], [1.0]]),
        6: np.concatenate([rnd.normal(c * 50, 1, size=(60, 6)) for c in range(6)]), 7: np.zeros((50, 4)), 8: rnd.normal(size=(200, 4)) + 1e6,
    }
    rows, expected = [], {}
    for g, v in groups.items():
        ids = [int(x) for x in rnd.permutation(len(v)) + 10_000 * g]
        rows += [(i, g, x.tolist()) for i, x in zip(ids, v, strict=True)]
        if len(v) > 1:
            expected |= brute(ids, v)
    rows.append((5, None, [1.0]))
    frame = spark.createDataFrame(rows, "id long, group int, v array<double>").repartition(5)
    found = {r.id: (r.nearest, r.d) for r in nearest.nearest_in_group(frame).collect()}
    assert found.keys() == expected.keys()
    assert all(found[i][0] == n and abs(found[i][1] - d) < 1e-8 * max(1, d) for i, (n, d) in expected.items())


def test_clusters_do_not_meet(spark, monkeypatch):
    """Of far clusters no two blocks meet, so the work grows with the clusters' sizes."""
    monkeypatch.setattr(nearest, "BLOCK", 32)
    rnd = np.random.default_rng(4)
    v = np.concatenate([rnd.normal(c * 1000, 1, size=(100, 5)) for c in range(20)])
    frame = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "id long, group int, v array<double>")
    found, finds = nearest.search(frame)
    compared = finds.agg(F.sum("compared")).first()[0]
    assert found.count() == len(v) and compared < 0.1 * len(v) ** 2 / 2


def test_share_of_pairs_on_embeddings(spark, monkeypatch):
    """On the given vectors fewer than half of the pairs of different blocks are compared in full."""
    monkeypatch.setattr(nearest, "BLOCK", 32)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("v"))
    _, finds = nearest.search(rows)
    compared = finds.agg(F.sum("compared")).first()[0]
    pairs = rows.groupBy("group").count().selectExpr("sum(count * (count - 1) / 2) as n").first().n
    print(f"compared in full: {compared / pairs:.3f} of all pairs of a group")
    assert compared < 0.5 * pairs
