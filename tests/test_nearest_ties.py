"""Equal vectors in nearest neighbours: right ties, and searched once."""

import numpy as np
import pytest

from tidemark.plans.nearest import nearest


@pytest.mark.parametrize("same", [False, True])
def test_equal_vectors_are_searched_once(spark, same):
    rng = np.random.default_rng(4)
    corpus = rng.integers(0, 3, size=(400, 2)).astype(float)
    asked = corpus if same else rng.integers(0, 3, size=(200, 2)) + 0.25
    report = []
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, vec array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>").repartition(2)
    got = {}
    for r in nearest(q, c, 3, skip_same_id=same, report=report).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    for i, v in enumerate(asked):
        d = np.sqrt(((corpus - v) ** 2).sum(1))
        best = [j for j in sorted(range(len(corpus)), key=lambda j: (d[j], j)) if not same or j != i][:3]
        assert got[i] == [(n, j, d[j]) for n, j in enumerate(best, 1)]
    assert report[0]["queries"] == 9


def test_a_task_keeps_only_the_nearest_of_each_batch(spark, monkeypatch):
    """Many near rows on one distance must not add up over the batches of a block."""
    from tidemark.plans import nearest as plan
    monkeypatch.setattr(plan, "ASKED_ROWS", 4)
    turn = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    corpus = np.stack([np.cos(turn), np.sin(turn)], 1)
    asked = np.arange(1, 13)[:, None] * np.array([[0.0, 1e-9]])
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>")
    got = {}
    for r in plan.nearest(q, c, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for i, v in enumerate(asked):
        d = np.sqrt(((corpus - v) ** 2).sum(1))
        assert got[i] == sorted(range(200), key=lambda j: (d[j], j))[:3]
