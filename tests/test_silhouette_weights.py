"""Exact silhouette with equal points, over several blocks."""

import numpy as np

from tidemark.operators import clustering as cl


def test_exact_silhouette_folds_equal_points(spark, monkeypatch):
    rng = np.random.default_rng(1)
    xs = rng.integers(0, 4, size=(150, 2)).astype(float)
    label = np.append(rng.integers(0, 3, size=149), 7)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(xs, label))], "id long, vec array<double>, cluster long").repartition(3)
    real, seen = cl._euclidean_sums, []
    monkeypatch.setattr(cl, "_euclidean_sums", lambda df: seen.append(real(df, 7)) or seen[0])
    got = cl.silhouette(rows, exact=True).first()
    d = np.sqrt(((xs[:, None] - xs[None, :]) ** 2).sum(2))
    want = []
    for i, c in enumerate(label):
        size = (label == c).sum()
        a = d[i, label == c].sum() / max(1, size - 1)
        b = min(d[i, label == o].mean() for o in set(label) - {c})
        want.append(0.0 if size == 1 else (b - a) / max(a, b))
    assert got.rows == 150 and abs(got.silhouette - np.mean(want)) < 1e-9
    distinct = len({(*v, c) for v, c in zip(xs, label)})
    assert len({r.id for r in seen[0].collect()}) == distinct < 60
