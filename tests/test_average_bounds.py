"""Average linkage from centres and spreads against the distances of all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import clustering as cl

CHAIN = np.c_[np.arange(120) * 2500.0, np.zeros(120)]
SHAPES = {"normal": np.random.default_rng(3).normal(size=(150, 2)), "wide": np.random.default_rng(4).normal(size=(90, 6)),
          "chain": CHAIN, "heaps": np.random.default_rng(6).normal(size=(150, 3)) * 0.1 + np.arange(150)[:, None] // 30}


def direct(x, w):
    d = np.triu(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * (w[:, None] * w[None]), 1)
    return cl._merged(np.arange(len(x)), w, d + d.T, np.full(len(x), np.inf), "average", None, 0)


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("weighted", [False, True])
def test_merges_equal_those_from_all_distances(shape, weighted):
    x = SHAPES[shape]
    w = np.random.default_rng(5).integers(1, 5, len(x)).astype(float) if weighted else np.ones(len(x))
    rows = pd.DataFrame({"cluster": np.arange(len(x)), "point": np.arange(len(x)), "vec": list(x), "weight": w}).sample(frac=1, random_state=1)
    got, want = (t.sort_values(["a", "b"])[["a", "b", "height", "round", "into"]].to_numpy(float) for t in (cl._average_merges(rows, 1, 0), direct(x, w)))
    assert got.shape == want.shape and np.allclose(got, want)


def test_a_chain_over_blocks_takes_no_rounds_over_all_pairs(spark, monkeypatch):
    seen, whole = [], cl._in_blocks
    monkeypatch.setattr(cl, "_in_blocks", lambda members, rows, block_rows: seen.append(rows) or whole(members, rows, block_rows))
    points = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(CHAIN)], "id long, vec array<double>")
    _, tree = cl.merge_tree(points, "average", 20)
    got = sorted((r.a, r.b, round(r.height, 6)) for r in tree.collect())
    assert got == sorted((int(r.a), int(r.b), round(r.height, 6)) for r in direct(CHAIN, np.ones(len(CHAIN))).itertuples())
    assert len(seen) <= 1  # the last clusters are folded once
