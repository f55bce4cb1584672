"""Equal train rows are fitted as one row with a weight, with the result of fitting them all."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import modeling as op


def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        a, b, c = int(rng.integers(6)), int(rng.integers(4)), "xy"[int(rng.integers(2))]
        rows.append((i, a, b, c, "no" if a + b + rng.normal(0, 2) < 4 else "yes", float(3 * a - b)))
    return spark.createDataFrame(rows, "id long, a int, b int, c string, y string, worth double").repartition(3)


@pytest.mark.parametrize("model,target", [("logistic_regression", "y"), ("naive_bayes", "y"), ("svm", "y"), ("decision_tree", "y"),
                                          ("linear_regression", "worth"), ("decision_tree", "worth")])
def test_equal_rows_are_one_with_a_weight(spark, monkeypatch, model, target):
    seen, spread = [], op.spread

    def counted(df):
        seen.append(df.count())
        return spread(df)

    monkeypatch.setattr(op, "spread", counted)
    known, features = op.WEIGHTED, ["a", "b", "c"] if target == "y" else ["a", "b"]
    fits = []
    for weighted in (known, ()):
        monkeypatch.setattr(op, "WEIGHTED", weighted)
        fits.append(op.train(table(spark), "id", target, features, "classification" if target == "y" else "regression", model, iterations=300))
    (one, scored), (every, plain) = fits
    assert seen[0] <= 6 * 4 * 2 * 2 and 700 < seen[1] == one.info["train_rows"] == every.info["train_rows"]
    stages = one.pipeline.stages[-1], every.pipeline.stages[-1]
    if hasattr(stages[0], "coefficients") and model != "naive_bayes":
        digits = 0.02 if model == "svm" else 1e-4  # the hinge loss has no slope at its optimum
        assert np.allclose(*[s.coefficients.toArray() for s in stages], atol=digits) and abs(stages[0].intercept - stages[1].intercept) <= digits
    if model == "decision_tree":
        assert np.allclose(*[s.featureImportances.toArray() for s in stages])
    got, want = ({r.id: r.prediction for r in x.collect()} for x in (scored, plain))
    assert got.keys() == want.keys() and all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-6 for i in got)


def test_split_takes_the_lowest_hashes_of_each_class(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None) for i in range(300)] + [(300, "single")]
    got = {r.id: r.part for r in op.train_test_split(spark.createDataFrame(rows, "id long, y string"), "id", 0.2, 42, "y").collect()}
    want = set()
    for y in ("a", "b", "c", None, "single"):
        ids = sorted((i for i, v in rows if v == y), key=lambda i: (int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16), str(i)))
        want.update(ids[:math.floor(len(ids) * 0.2 + 0.5)])
    assert {i for i, part in got.items() if part == "test"} == want and len(got) == 301


@pytest.mark.parametrize("target", ["y", "worth"])
def test_a_forest_of_few_distinct_rows_is_fitted_on_them(spark, monkeypatch, tmp_path, target):
    """Trees draw distinct rows with their numbers; the forest scores, ranks features and is stored as one of all rows."""
    features, problem = (["a", "b", "c"], "classification") if target == "y" else (["a", "b"], "regression")
    fits, seen, grown = [], [], op._forest

    def counted(ready, *given):
        seen.append(ready.count())
        return grown(ready, *given)

    monkeypatch.setattr(op, "_forest", counted)
    monkeypatch.setattr(op, "TREES", 24)
    for rows in (100, 100_000):
        monkeypatch.setattr(op, "FOREST_ROWS", rows)
        fits.append(op.train(table(spark), "id", target, features, problem, "random_forest"))
    (one, scored), (every, plain) = fits
    assert len(seen) == 1 and seen[0] <= 6 * 4 * 2 * 2 and one.info["train_rows"] == every.info["train_rows"] > 700
    assert one.pipeline.stages[-1].getNumTrees == 24 and one.pipeline.stages[-1].numFeatures == len(one.inputs)
    a, b = (dict(op.feature_importance(m, spark).collect()) for m in (one, every))
    assert a.keys() == b.keys() and all(abs(a[f] - b[f]) < 0.1 for f in a)
    if target == "y":
        both = scored.select("id", F.col("probabilities")[1].alias("p")).join(plain.select("id", F.col("probabilities")[1].alias("q")), "id")
    else:
        both = scored.select("id", F.col("prediction").alias("p")).join(plain.select("id", F.col("prediction").alias("q")), "id")
    off, most, n = both.agg(F.avg(F.abs(F.col("p") - F.col("q"))), F.max(F.abs(F.col("p") - F.col("q"))), F.count("p")).first()
    assert n > 150 and off < (0.05 if target == "y" else 0.5), (off, most)
    op.save_model(one, spark, str(tmp_path), "forest")
    again = op.score(op.load_model(spark, str(tmp_path), "forest"), table(spark), "id", one.fills)
    first = op.score(one, table(spark), "id", one.fills)
    assert again.select("id", "prediction").exceptAll(first.select("id", "prediction")).count() == 0
