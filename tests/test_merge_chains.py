"""Evenly spaced points tie to the lower number, so only the first pair of a chain is mutual: blocks merge chains by themselves."""

import numpy as np
import pytest

from tidemark.operators import clustering as cl
from test_clustering import points


@pytest.mark.parametrize("how", ["average", "ward"])
def test_chains_take_few_rounds(spark, monkeypatch, how):
    xs = np.array([[10.0 * i, 0.0] for i in range(60)])
    rounds, placed = [], cl._in_blocks
    monkeypatch.setattr(cl, "_in_blocks", lambda *args: rounds.append(args[1]) or placed(*args))
    trees = []
    for block in (20, 2_000):  # all points in one block are merged by one task
        _, tree = cl.merge_tree(points(spark, xs), how, block)
        trees.append({(r.a, r.b): r.height for r in tree.collect()})
    assert len(rounds) <= 6, rounds
    assert trees[0] == trees[1] and len(trees[0]) == 59
