"""What a task of the nearest neighbours and of the exact silhouette holds at once does not grow with a batch."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidemark.operators import clustering as cl
from tidemark.plans import nearest as plan


def test_visits_leave_a_few_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    q, centres = rng.normal(size=(300, 16)), rng.normal(size=(80, 16))
    pdf = pd.DataFrame({"query_id": np.arange(300), "vec": list(q), "limit": np.where(np.arange(300) % 3, np.inf, np.nan)})
    ids, sizes, radii, slices = np.arange(80) + 5, np.full(80, 50), np.full(80, 5.0), 1 + np.arange(80) % 2
    args = centres, ids, sizes, radii, slices, 5, 20.0
    whole = pd.concat(plan._visits(iter([pdf]), *args))
    monkeypatch.setattr(plan, "VISIT_ROWS", 100)
    monkeypatch.setattr(plan, "CELLS", 80 * 40)
    parts = list(plan._visits(iter([pdf]), *args))
    assert max(map(len, parts)) <= 100 < len(whole)
    key = ["query_id", "pivot", "slice", "bound"]
    got, want = (t[key].sort_values(key).reset_index(drop=True) for t in (pd.concat(parts), whole))
    pd.testing.assert_frame_equal(got, want)


def test_exact_silhouette_holds_few_distances(spark, monkeypatch):
    rng = np.random.default_rng(2)
    xs, label = rng.normal(size=(90, 2)), np.append(rng.integers(0, 3, size=89), 7)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(xs, label))], "id long, vec array<double>, cluster long")
    monkeypatch.setattr(cl, "MOST_DISTANCES", 64)
    real = cl._euclidean_sums
    monkeypatch.setattr(cl, "_euclidean_sums", lambda df: real(df, 40))
    got = cl.silhouette(rows, exact=True).first()
    d = np.sqrt(((xs[:, None] - xs[None, :]) ** 2).sum(2))
    want = []
    for i, c in enumerate(label):
        size = (label == c).sum()
        a = d[i, label == c].sum() / max(1, size - 1)
        b = min(d[i, label == o].mean() for o in set(label) - {c})
        want.append(0.0 if size == 1 else (b - a) / max(a, b))
    assert got.rows == 90 and abs(got.silhouette - np.mean(want)) < 1e-9
