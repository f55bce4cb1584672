"""The block search for best partners against all pairs."""

from __future__ import annotations

import random

import pytest

from tidemark.functions.similarity import whole_percents
from tidemark.operators import matching as op
from tidemark.plans import subsequences as sub


def _words():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé\U0001F600") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 18, 45, 70])))
    asked = sorted({word() for _ in range(90)})
    held = sorted({word() for _ in range(300)} | {a[:len(a) // 2] + "z" + a[len(a) // 2 + 1:] for a in asked[::2]})
    rng.shuffle(held)
    return asked, held, [("~" if i % 3 else "") + x for i, x in enumerate(held)]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 0.82, 0.9, 1.0])
def test_best_of_block_equals_all_pairs(threshold):
    asked, held, values = _words()
    i, j, score = sub.best_of_block(asked, held, values, threshold)
    got = {asked[a]: (values[b], float(s)) for a, b, s in zip(i, j, score)}
    want = {}
    for a in asked:
        found = [(-s, v) for s, v in zip(whole_percents([a] * len(held), held), values) if s >= threshold]
        if found:
            want[a] = (min(found)[1], -min(found)[0])
    assert got == want


def test_best_fuzzy_over_several_blocks_writes_no_candidate_pairs(spark, monkeypatch):
    asked, held, _ = _words()
    left = spark.createDataFrame([(w,) for w in asked], "low string")
    right = spark.createDataFrame([(w.upper() if n % 2 else w,) for n, w in enumerate(held)] + [(None,)], "low string")
    want = sorted(map(tuple, op.best_match(op.fuzzy_match(left, right, "low", "low", 0.75)).collect()))
    monkeypatch.setattr(sub, "ASKED_ROWS", 40)
    monkeypatch.setattr(sub, "HELD_ROWS", 70)

    def refuse(*_):
        raise AssertionError("candidate pairs")

    monkeypatch.setattr(op, "_candidates", refuse)
    assert want and sorted(map(tuple, op.best_fuzzy(left, right, "low", "low", 0.75).collect())) == want
