"""Shared plans against plain Python."""

import numpy as np
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions.arithmetic import _chi_square_tail, kolmogorov_p
from tidemark.plans.components import connected_components
from tidemark.plans.counts import column_summary, duplicate_count
from tidemark.plans.nearest import _leaves, _walk, nearest
from tidemark.plans.ranks import at_ranks, numeric_counts, quantiles, running
from tidemark.plans.sizing import fits

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=200), st.integers(1, 8))
def test_running_equals_cumulative_sum(spark, values, buckets):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {r.v: (r.n_upto, r.n_total) for r in running(df, ["k"], "v", ["n"], buckets).collect()}
    for v in set(values):
        assert got[float(v)] == (sum(x <= v for x in values), len(values))


def test_quantiles_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    # a third of the rows hold one value
    values = np.concatenate([rng.normal(size=700) ** 3, np.full(350, 2.5)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    probs, names = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], list("abcdef")
    want = np.quantile(values, probs)
    row = quantiles(df, probs, names).first()
    assert np.allclose([row[n] for n in names], want)
    counted = numeric_counts(df)
    for buckets in (1, 3, 1000):
        found = at_ranks(counted, ["column_name"], "value", {"x": lambda total: F.floor(total / 3)}, buckets).first()
        assert (found.x, found["_total"]) == (np.sort(values)[350], 1050)


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert quantiles(df, [0.5], ["m"]).first().m == 2.0


def test_summary_counts_nulls_nan_and_signed_zero(spark):
    df = spark.createDataFrame([(0.0, "x"), (-0.0, None), (float("nan"), "X"), (None, "x")], "a double, b string")
    got = {r.column_name: r for r in column_summary(df).collect()}
    assert (got["a"].missing, got["a"].distinct_count) == (2, 1)
    assert (got["b"].missing, got["b"].distinct_count, got["b"].largest_class) == (1, 2, 2)


def test_duplicates_treat_null_as_equal(spark):
    long_text = "y" * 500
    df = spark.createDataFrame([(None, long_text), (None, long_text), (1, long_text), (1, long_text + "z")], "a int, b string")
    assert duplicate_count(df).first().duplicate_rows == 1


def test_components_match_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    edges += [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(700, 740)] + [(900, 900)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in parent}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_nearest_matches_brute_force_with_hot_spot(spark):
    rng = np.random.default_rng(3)
    # a third of the corpus is one spot with many equal points
    corpus = np.vstack([rng.normal(size=(200, 3)), np.tile([[5.0, 5.0, 5.0]], (60, 1)), 5 + rng.normal(size=(40, 3)) * 1e-3])
    asked = np.vstack([rng.normal(size=(30, 3)), [[5.0, 5.0, 5.0]] * 10])
    c = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(corpus)], "id long, vec array<double>").repartition(5)
    q = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(asked)], "query_id long, vec array<double>")
    got = {}
    for r in nearest(q, c, 4, pivots=7, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for i, v in enumerate(asked):
        d = np.sqrt(((corpus - v) ** 2).sum(1))
        assert got[i] == sorted(range(len(corpus)), key=lambda j: (d[j], j))[:4]


def test_leaves_bound_the_work_and_visits_are_reported(spark):
    rng = np.random.default_rng(9)
    corpus = np.vstack([rng.normal(size=(500, 4)) * 0.1 + 5 * rng.normal(size=4) for _ in range(8)]) + 1000.0
    asked = corpus[::40] + rng.normal(size=(100, 4)) * 0.01
    row, col, read = _walk(asked, np.full(100, np.inf), corpus, _leaves(corpus), 3)
    assert read < 0.2 * len(asked) * len(corpus)
    for i, v in enumerate(asked):
        d = ((corpus - v) ** 2).sum(1)
        assert set(np.argsort(d)[:3]) <= set(col[row == i])
    report = []
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, vec array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>")
    got = {r.query_id: r.id for r in nearest(q, c, 1, block_rows=100, report=report).collect()}
    assert got == {i: int(((corpus - v) ** 2).sum(1).argmin()) for i, v in enumerate(asked)}
    assert report[0]["queries"] == 100 and report[0]["visits"] < 0.3 * 100 * report[0]["pivots"]


def test_test_statistics(spark):
    assert abs(_chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(_chi_square_tail(18.307038053275146, 10) - 0.05) < 1e-12
    assert _chi_square_tail(0.0, 3) == 1.0
    row = spark.range(1).select(kolmogorov_p(F.lit(0.0), F.lit(50), F.lit(60)).alias("same"),
                                kolmogorov_p(F.lit(1.0), F.lit(50), F.lit(60)).alias("apart")).first()
    assert row.same == 1.0 and row.apart < 1e-10


def test_fits_counts(spark):
    assert fits(spark.range(100), 100) and not fits(spark.range(101), 100)
