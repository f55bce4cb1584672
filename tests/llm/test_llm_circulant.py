"""Circulant MinHash classes against all pairs."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import circulant_minhash as circulant

SCHEMA = "doc_id bigint, text string, component_id int, kept string"


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def corpus(seed, group):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)] + ["É", "Üb er", "x,"]
    texts = []
    for _ in range(50):
        text = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        texts.append(" ".join(text))
        for _ in range(rng.choice([0, 1, 4])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("\n".join(copy).upper().replace("É", "é") if rng.random() < 0.3 else "\t".join(copy))
    seed_text = [rng.choice(words) for _ in range(200)]
    texts.append(" ".join(seed_text))
    for i in range(group):  # near copies of one text, most of them not similar to each other
        copy = list(seed_text)
        for j in rng.sample(range(20), 3):
            copy[j * 10 + rng.randrange(10)] = f"X{i}"
        texts.append(" ".join(copy))
    chain = [rng.choice(words) for _ in range(120)]
    for i in range(30):  # each similar to its neighbours only
        texts.append(" ".join(chain[i:i + 70]))
    texts += ["short one", "Short one", "", None, None, " \n", texts[0], texts[-1], "four words are here"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, 1, "x") for i, t in enumerate(texts)]


def direct(rows, percent=85):
    known = [(i, sets(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in known)


@pytest.mark.parametrize("seed,percent,block", [(1, 85, 256), (2, 85, 8), (3, 70, 16)])
def test_components_equal_all_pairs(spark, seed, percent, block):
    rows = corpus(seed, 120)
    got = circulant.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), percent=percent, block=block)
    assert sorted(tuple(r) for r in got.collect()) == direct(rows, percent)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(circulant, "HOT_COPIES", 3)
    assert circulant.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(5, a, 1, ""), (5, b, 1, ""), (6, a + " x", 1, ""), (7, b + " y", 1, ""), (None, a, 1, ""), (9, a, 1, ""), (9, a, 1, ""), (8, a, 1, "")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in circulant.near_duplicates(table).collect())
    assert got == [(0, 76, None, None), (5, 76, 5, True), (5, 76, 5, True), (6, 77, 5, False), (7, 77, 5, False), (8, 76, 5, False), (9, 76, 5, False),
                   (9, 76, 5, False)]
    assert sorted((r.doc_id or 0, r.text) for r in circulant.keep_lowest(table).collect()) == [(0, a), (5, a), (5, b)]


def test_permutations_and_recall():
    """pi and sigma have no two equal values; coordinates agree as often as sets overlap, and the shifts are one permutation's."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert len(np.unique(circulant.pi(x))) == len(np.unique(circulant.sigma(x))) == len(np.unique(x))
    found, agree = 0, []
    for _ in range(300):
        shared, own = rng.integers(0, 1 << 63, 170, dtype=np.uint64), rng.integers(0, 1 << 63, 30, dtype=np.uint64)
        a, b = (circulant.signature(np.concatenate([shared, own[s]]), circulant.BANDS * circulant.ROWS) for s in (slice(0, 15), slice(15, 30)))
        agree.append((a == b).mean())
        found += (circulant.band_keys(a, circulant.BANDS, circulant.ROWS) == circulant.band_keys(b, circulant.BANDS, circulant.ROWS)).any()
    assert found == 300 and abs(np.mean(agree) - 0.85) < 0.01
