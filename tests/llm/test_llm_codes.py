"""Vector codes against a direct version in Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string"


def direct(rows, entries=256, parts=4, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab, _ in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    dims = len(kept[0][1])
    cut = [slice(dims * p // parts, dims * (p + 1) // parts) for p in range(parts)]
    books = [[list(r[1][c]) for r in kept[:entries]] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for c, book in zip(cut, books):
            own = defaultdict(list)
            for r in kept:
                own[nearest(r[1][c], book)[1]].append(r[1][c])
            for j, members in own.items():
                book[j] = [sum(x) // len(members) for x in zip(*members)]
    errors = defaultdict(int)
    out = {}
    for i, v, lab in kept:
        best = [nearest(v[c], b) for c, b in zip(cut, books)]
        out[i] = ("".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), lab)
        errors[lab] += out[i][1]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, long(e), long(errors[lab]), sha) for i, (c, e, lab) in out.items()}


def long(x):
    return x if x < 1 << 63 else None


def result(df):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()}


def f32(x):
    return float(np.float32(x))


@pytest.mark.parametrize("scale,entries", [(1.0, 256), (0.002, 20), (3e30, 7)])
def test_codes_equal_the_direct_version(spark, scale, entries):
    rng = random.Random(8)
    centres = [[rng.gauss(0, scale) for _ in range(8)] for _ in range(6)]
    rows = [(i * 3 - 40, [f32(x + rng.gauss(0, scale / 5)) for x in rng.choice(centres)], rng.choice([None, 0, 1]), "x") for i in range(300)]
    rows += [(2000, None, 1, "x"), (2001, [None] * 8, 1, "x"), (2002, [float("nan")] * 8, 1, "x"), (2003, [math.inf] * 8, None, "x")]
    rows += [(3000 + i, rows[0][1], 2, "x") for i in range(50)]  # ties
    got = result(vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries))
    assert got == direct(rows, entries)


def test_cells_keep_every_nearest_entry():
    rng = np.random.default_rng(3)
    book = rng.integers(-200, 200, (64, 4))
    book[10] = book[3]
    cache = vector_codes.CellCache(book, cells=100)
    for _ in range(5):
        rows = rng.integers(-300, 300, (400, 4))
        index, best = cache.nearest(rows)
        away = vector_codes.distances(rows, book)
        assert (best == away.min(axis=1)).all() and (index == away.argmin(axis=1)).all()
    assert cache.shift > 0 and np.mean([len(x) for x in cache.left]) < 32


def test_odd_rows(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [1.0, 2.0], 0, "a"), (1, [1.0, 2.0], 0, "a"), (None, [5.0, 5.0], None, "b"), (2, [1.0], None, "c"), (3, [], 1, "d")]
    got = sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA), parts=2).collect())
    assert got == [(0, "0202", 0, 0), (1, "0000", 0, 0), (1, "0000", 0, 0), (2, None, None, 0), (3, None, None, None)]
    empty = [(1, [], 0, "a"), (2, [], 0, "a")]
    assert sorted((r.vec_id, r.code, r.error) for r in vector_codes.compress(spark.createDataFrame(empty, SCHEMA)).collect()) == [
        (1, "00000000", 0), (2, "00000000", 0)]
