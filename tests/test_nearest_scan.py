"""Blocks whose leaves rule out little are read by one product, with the same pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.plans import nearest as plan


def _kept(asked, corpus, row, col, k):
    exact = np.sqrt(((asked[row] - corpus[col]) ** 2).sum(1))
    out = []
    for q in range(len(asked)):
        at = row == q
        out.append(sorted(zip(exact[at], col[at]))[:k])
    return out


@pytest.mark.parametrize("dims", [2, 16])
def test_reach_holds_the_nearest(dims):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(700, dims))
    corpus[50:60] = corpus[40]
    asked = np.vstack([rng.normal(size=(40, dims)), corpus[40:45]])
    bounds = np.full(len(asked), np.inf)
    row, col = plan._reach(asked, bounds, corpus, plan._leaves(corpus), 6)
    whole = np.repeat(np.arange(len(asked)), len(corpus)), np.tile(np.arange(len(corpus)), len(asked))
    assert _kept(asked, corpus, row, col, 6) == _kept(asked, corpus, *whole, 6)
    few = corpus[:3]
    row, col = plan._reach(asked, bounds, few, plan._leaves(few), 6)
    assert _kept(asked, few, row, col, 6) == _kept(asked, few, np.repeat(np.arange(len(asked)), 3), np.tile(np.arange(3), len(asked)), 6)


def test_many_dimensions_do_not_walk_leaves(monkeypatch):
    def walked(*args):
        raise AssertionError("leaf by leaf")
    monkeypatch.setattr(plan, "_walk", walked)
    rng = np.random.default_rng(4)
    corpus = rng.normal(size=(2000, 16))
    row, _ = plan._reach(corpus[:50], np.full(50, np.inf), corpus, plan._leaves(corpus), 5)
    assert len(row) >= 250 and len(row) < 0.2 * 50 * 2000
