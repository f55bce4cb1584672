"""Term weights against direct counting, with hot and rare terms."""

import math
import random
from collections import Counter

from tidemark.operators import retrieval as ret


def test_term_weights_with_few_hot_terms(spark, monkeypatch):
    monkeypatch.setattr(ret, "HOT_TERMS", 5, raising=False)
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [None, "x" * 90 + " w1"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "w1 again under one key")]
    got = {(r.id, r.term): (r.tf, r.weight) for r in ret.term_weights(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    bags = {}
    for i, t in rows:
        bags.setdefault(i, Counter()).update(t.split() if t else [])
    df = Counter(t for bag in bags.values() for t in bag)
    idf = {t: math.log((1 + len(rows)) / (1 + c)) + 1 for t, c in df.items()}
    want = {}
    for i, bag in bags.items():
        length = math.sqrt(sum((c * idf[t]) ** 2 for t, c in bag.items()))
        want.update({(i, t): (c, c * idf[t] / length) for t, c in bag.items()})
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_rows_of_hot_terms_are_not_shuffled_by_term(spark):
    docs = spark.createDataFrame([(i, f"common words and w{i}") for i in range(50)], "id long, t string")
    plan = ret.term_weights(docs, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=broadcast" in plan
