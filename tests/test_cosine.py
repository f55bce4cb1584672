"""Blocked cosine search and the fallback search against direct versions."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidemark.operators import matching, retrieval
from tidemark.plans import cosine


def grams(text):
    text = re.sub(r"\s\s+", " ", text.lower())
    return Counter(text[i:i + n] for n in (2, 3) for i in range(len(text) - n + 1))


def direct(queries, choices, threshold, k):
    """Weights of a query come from that query and all choices; the best k choices of each distinct query."""
    counted = {c: grams(c) for c in choices}
    total = len(choices) + 1
    df = Counter(g for c in choices for g in counted[c])
    out = []
    for q in sorted(set(queries)):
        mine = grams(q)

        def idf(g, mine=mine):
            return math.log((1 + total) / (1 + df[g] + (g in mine))) + 1
        qq = math.sqrt(sum((n * idf(g)) ** 2 for g, n in mine.items()))
        scored = []
        for c in set(choices):
            dot = sum(n * idf(g) * counted[c][g] * idf(g) for g, n in mine.items())
            norm = qq * math.sqrt(sum((n * idf(g)) ** 2 for g, n in counted[c].items()))
            if norm and dot / norm >= threshold:
                scored.append((-round(dot / norm, 9), c))
        out += [(q, c, -s) for s, c in sorted(scored)[:k]]
    return sorted(out)


def texts(seed, n, words):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdeé ü") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(1, words))).replace("  ", " ").strip() or "x" for _ in range(n)]


def test_best_matches_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cosine, "TERMS", 64)
    monkeypatch.setattr(cosine, "CHOICES", 8)
    choices = [t for t in texts(1, 90, 12) if len(t) <= 64]
    choices += choices[:7]
    queries = [t for t in texts(2, 40, 12) if len(t) <= 64] + choices[3:5] + ["zz", "q"]
    left = spark.createDataFrame([(q,) for q in queries] + [(None,)], "l string")
    right = spark.createDataFrame([(c,) for c in choices] + [(None,)], "r string")
    for threshold, k in ((0.2, 3), (0.5, 1)):
        got = matching.best_ngram_match(left, right, "l", "r", threshold, k).collect()
        assert sorted((r.left_value, r.right_value, round(r.score, 9)) for r in got) == direct(queries, choices, threshold, k)
    every = matching.ngram_match(left, right, "l", "r", 0.3).collect()
    assert sorted((r.left_value, r.right_value, round(r.score, 9)) for r in every) == direct(queries, choices, 0.3, 10 ** 6)


def test_blocks_do_not_change_the_result(spark):
    left = spark.createDataFrame([(t,) for t in texts(3, 60, 60)], "l string")
    right = spark.createDataFrame([(t,) for t in texts(4, 80, 60)], "r string")
    qg = matching._gram_counts(left.distinct().withColumnRenamed("l", "q"), "q", "q").withColumnRenamed("gram", "term")
    cg = matching._gram_counts(right.distinct().withColumnRenamed("r", "c"), "c", "c").withColumnRenamed("gram", "term")
    df = cg.groupBy("term").count().withColumnRenamed("count", "df")
    one, many = (sorted((r.q, r.c, round(r.score, 9)) for r in cosine.best_cosine(qg, cg, df, 80, 0.1, 2, rows).collect()) for rows in (1024, 13))
    assert one == many and len(one) > 60


def test_search_with_fallback_equals_direct_search(spark):
    rng = np.random.default_rng(5)
    corpus = [(i, rng.normal(size=4).tolist(), t) for i, t in enumerate(texts(6, 60, 8))]
    asked = [(100 + i, (np.array(corpus[i][1]) * (1 if i % 2 else -1)).tolist(), corpus[(i + 3) % 60][2] + " x") for i in range(20)]
    schema = "id long, vec array<double>, text string"
    got = retrieval.search_with_fallback(spark.createDataFrame(asked, schema.replace("id", "qid", 1)), spark.createDataFrame(corpus, schema),
                                         "qid", "id", "vec", "text", 3, 0.9, 0.3)

    def hits(vec):
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        scored = sorted((-round(float(unit(vec) @ unit(v)), 9), i) for i, v, _ in corpus)
        return [(i, -s) for s, i in scored[:3] if -s >= 0.9]

    want = []
    best = {q: c for q, c, _ in direct([t for _, _, t in asked], [t for _, _, t in corpus], 0.3, 1)}
    for qid, vec, text in asked:
        found = hits(vec)
        if found:
            want += [(qid, i, s, "vector") for i, s in found]
        elif text in best:
            first = min(i for i, _, t in corpus if t == best[text])
            want += [(qid, i, s, "text") for i, s in hits(corpus[first][1])]
    assert sorted((r.query_id, r.id, round(r.score, 9), r.via) for r in got.collect()) == sorted(want)
    assert {w[3] for w in want} == {"vector", "text"}
