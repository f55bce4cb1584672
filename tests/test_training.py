"""Trained models against direct computations on a small table."""

import math
import re

import numpy as np
import pytest

from tidemark.operators import modeling as op

FEATURES = ["a", "b", "c"]


def table(spark, classes):
    rng = np.random.default_rng(classes)
    rows = []
    for i in range(240):
        y = i % classes
        a, b, c = rng.normal(y * 1.5, 1.0), rng.normal(-y, 1.5), rng.normal(0, 1)
        rows.append((i, float(a), float(b), float(c), "klm"[y], float(3 * a - b + rng.normal(0, 0.1))))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y string, worth double").repartition(3)


def fitted(spark, model, problem="classification", classes=3, target="y"):
    df = table(spark, classes)
    trained, scored = op.train(df, "id", target, FEATURES, problem, model, depth=8, iterations=200)
    rows = {r.id: r for r in df.collect()}
    test = {r.id: r for r in scored.collect()}
    train = [rows[i] for i in sorted(rows) if i not in test]
    assert len(test) + len(train) == 240 and 40 <= len(test) <= 60
    return trained, scored, train, [rows[i] for i in sorted(test)], test


def matrix(rows, scaler=None):
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    return x if scaler is None else (x - scaler[0]) / scaler[1]


def scales(rows):
    x = matrix(rows)
    return x.mean(axis=0), x.std(axis=0)


def weighted_metrics(y, p):
    """Accuracy, precision, recall and F1 weighted by class size."""
    out = [float(np.mean([a == b for a, b in zip(y, p)])), 0.0, 0.0, 0.0]
    for c in sorted(set(y)):
        hit = sum(a == b == c for a, b in zip(y, p))
        precision, recall = hit / max(1, p.count(c)), hit / y.count(c)
        share = y.count(c) / len(y)
        f1 = 2 * precision * recall / (precision + recall) if hit else 0.0
        out = [out[0], out[1] + share * precision, out[2] + share * recall, out[3] + share * f1]
    return out


def check_metrics(scored, test, truth):
    got = op.classification_metrics(scored, "y").first()
    want = weighted_metrics([r.y for r in truth], [test[r.id].prediction for r in truth])
    assert np.allclose([got.accuracy, got.precision, got.recall, got.f1], want)


def test_naive_bayes(spark):
    _, scored, train, truth, test = fitted(spark, "naive_bayes")
    x, labels = matrix(train), np.array([r.y for r in train])
    scores = []
    for c in "klm":
        part = x[labels == c]
        var = part.var(axis=0) + 1e-9 * x.var(axis=0).max()
        scores.append(math.log(len(part) / len(x)) - 0.5 * (np.log(2 * np.pi * var) + (matrix(truth) - part.mean(axis=0)) ** 2 / var).sum(axis=1))
    assert [test[r.id].prediction for r in truth] == ["klm"[i] for i in np.argmax(scores, axis=0)]
    check_metrics(scored, test, truth)


def test_nearest_neighbours(spark):
    _, scored, train, truth, test = fitted(spark, "knn")
    scaler = scales(train)
    d = ((matrix(truth, scaler)[:, None] - matrix(train, scaler)[None]) ** 2).sum(-1)
    for r, row in zip(truth, d):
        near = [train[j].y for j in sorted(range(len(train)), key=lambda j: (row[j], train[j].id))[:5]]
        best = max(sorted(set(near)), key=near.count)
        assert test[r.id].prediction == best and test[r.id].confidence == pytest.approx(near.count(best) / 5)
    check_metrics(scored, test, truth)


def test_logistic_regression_is_at_its_optimum(spark):
    """The gradient of the summed loss with a penalty of half the squared weights is zero, and probabilities follow from the weights."""
    trained, _, train, truth, test = fitted(spark, "logistic_regression", classes=2)
    stage = trained.pipeline.stages[-1]
    w, bias = stage.coefficients.toArray(), stage.intercept
    p = 1 / (1 + np.exp(-(matrix(train) @ w + bias)))
    error = p - np.array([r.y == "l" for r in train])
    assert np.abs(matrix(train).T @ error + w).max() < 0.05 and abs(error.sum()) < 0.05
    for r, q in zip(truth, 1 / (1 + np.exp(-(matrix(truth) @ w + bias)))):
        assert np.allclose(test[r.id].probabilities, [1 - q, q]) and test[r.id].prediction == ("l" if q > 0.5 else "k")


def test_linear_svm_is_near_its_optimum(spark):
    trained, _, train, truth, test = fitted(spark, "svm", classes=2)
    stage = trained.pipeline.stages[-1]
    scaler = scales(train)
    x, sign = matrix(train, scaler), np.array([1.0 if r.y == "l" else -1.0 for r in train])

    def loss(w, b):
        return np.maximum(0, 1 - sign * (x @ w + b)).sum() + 0.5 * (w ** 2).sum()

    w, b = stage.coefficients.toArray(), stage.intercept
    rng = np.random.default_rng(1)
    best = min(loss(w + d[:3], b + d[3]) for d in rng.normal(0, 0.2, (2000, 4)))
    assert loss(w, b) <= best * 1.02
    assert [test[r.id].prediction for r in truth] == ["l" if s > 0 else "k" for s in matrix(truth, scaler) @ w + b]


def walk(node, row):
    while node["split"] is not None:
        node = node["left"] if row[node["split"][0]] <= node["split"][1] else node["right"]
    return node["value"]


def tree_of(text):
    """A tree from Spark's printed form."""
    lines = [x.strip() for x in text.split("\n")[1:] if x.strip()]

    def read(at):
        if lines[at].startswith("Predict"):
            return {"split": None, "value": float(lines[at].split(":")[1])}, at + 1
        name, edge = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
        left, at = read(at + 1)
        right, at = read(at + 1)  # past the line of the else branch
        return {"split": (int(name), float(edge)), "left": left, "right": right}, at

    return read(0)[0]


@pytest.mark.parametrize("problem,target", [("classification", "y"), ("regression", "worth")])
def test_decision_tree(spark, problem, target):
    """Predictions follow the printed tree; its splits on the train rows give the importances, as gains weighted by rows."""
    trained, scored, train, truth, test = fitted(spark, "decision_tree", problem, target=target)
    stage = trained.pipeline.stages[-1]
    tree = tree_of(stage.toDebugString)
    names = "klm"
    for r, row in zip(truth, matrix(truth)):
        value = walk(tree, row)
        want = names[int(value)] if target == "y" else value
        assert test[r.id].prediction == pytest.approx(want) if target == "worth" else test[r.id].prediction == want
    y = np.array([names.index(r.y) if target == "y" else r.worth for r in train], float)

    def impurity(v):
        return 1 - sum((v == c).mean() ** 2 for c in set(v)) if target == "y" else v.var()

    gains = np.zeros(3)

    def look(node, x, v):
        if node["split"] is None:
            return
        f, edge = node["split"]
        left = x[:, f] <= edge
        gains[f] += len(v) * impurity(v) - left.sum() * impurity(v[left]) - (~left).sum() * impurity(v[~left])
        look(node["left"], x[left], v[left])
        look(node["right"], x[~left], v[~left])

    look(tree, matrix(train), y)
    got = {r.feature: r.importance for r in op.feature_importance(trained, spark).collect()}
    assert np.allclose([got[f] for f in FEATURES], gains / gains.sum(), atol=1e-6)
    if target == "worth":
        m = op.regression_metrics(scored, "worth").first()
        a, p = np.array([r.worth for r in truth]), np.array([test[r.id].prediction for r in truth])
        assert np.allclose([m.mse, m.rmse, m.mae, m.r2], [((a - p) ** 2).mean(), ((a - p) ** 2).mean() ** 0.5, np.abs(a - p).mean(), 1 - ((a - p) ** 2).mean() / a.var()])
    else:
        check_metrics(scored, test, truth)


@pytest.mark.parametrize("problem,target", [("classification", "y"), ("regression", "worth")])
def test_random_forest_is_the_mean_of_its_trees(spark, problem, target):
    trained, _, _, truth, test = fitted(spark, "random_forest", problem, target=target)
    forest = trained.pipeline.stages[-1]
    assert forest.getNumTrees == 100
    if target == "worth":
        trees = [tree_of(t.toDebugString) for t in forest.trees]
        for r, row in zip(truth[:10], matrix(truth[:10])):
            assert test[r.id].prediction == pytest.approx(np.mean([walk(t, row) for t in trees]))
    else:
        for r in truth:
            assert sum(test[r.id].probabilities) == pytest.approx(1) and test[r.id].prediction == "klm"[int(np.argmax(test[r.id].probabilities))]


def test_auto_choice_and_store(spark, tmp_path):
    for classes, want in ((2, "logistic_regression"), (3, "random_forest")):
        assert op.auto_model("classification", classes) == want
    trained, _, _, _, _ = fitted(spark, "decision_tree")
    op.save_model(trained, spark, str(tmp_path), "one")
    again = op.load_model(spark, str(tmp_path), "one")
    rows = table(spark, 3)
    first, second = ({r.id: r.prediction for r in op.score(m, rows, "id").collect()} for m in (trained, again))
    assert first == second and len(first) == 240 and again.features == FEATURES


def test_feature_recommendations_are_all_listed(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(x), float(2 * x), float(z), "pq"[i % 2], float(x + z)) for i, (x, z) in enumerate(rng.normal(size=(80, 2)))],
                               "a double, twice double, z double, t string, y double")
    got = {tuple(r) for r in op.feature_recommendations(df, "y").collect()}
    nums = ["a", "twice", "z"]
    want = {("ratio", x, y) for i, x in enumerate(nums) for y in nums[i + 1:]} | {("group_mean", x, "t") for x in nums} | {("redundant", "a", "twice")}
    made = {(x, y) for kind, x, y in got if kind == "interaction"}
    assert {g for g in got if g[0] != "interaction"} == want
    assert {frozenset(p) for p in made} == {frozenset(p) for p in (("a", "twice"), ("a", "z"), ("twice", "z"))}
