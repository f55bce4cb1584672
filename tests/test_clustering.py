"""Clusters against brute force on small inputs."""

import numpy as np

from tidemark.operators import clustering as cl


def points(spark, xs):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(xs)], "id long, vec array<double>").repartition(3)


def brute_dbscan(xs, eps, need):
    d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= need
    label = np.full(len(xs), -1)
    n = 0
    for i in range(len(xs)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], n
            while stack:
                a = stack.pop()
                for b in np.nonzero((d[a] <= eps) & core & (label < 0))[0]:
                    label[b] = n
                    stack.append(b)
            n += 1
    for i in np.nonzero(~core)[0]:
        near = [j for j in np.nonzero(core)[0] if d[i, j] <= eps]
        if near:
            label[i] = label[min(near, key=lambda j: (d[i, j], j))]
    return label


def sample(dims):
    rng = np.random.default_rng(dims)
    return np.vstack([rng.normal(size=(60, dims)), rng.normal(size=(40, dims)) * 0.05 + 0.5, rng.uniform(-6, 6, size=(25, dims))])


def test_dbscan_matches_brute_force(spark):
    for dims, direct in ((2, 250_000), (2, 0), (1, 250_000)):
        xs = sample(dims)
        got = {r.id: r.cluster for r in cl.dbscan(points(spark, xs), 0.5, 5, direct).collect()}
        assert [got[i] for i in range(len(xs))] == brute_dbscan(xs, 0.5, 5).tolist()


def brute_merge(xs, k, how):
    """Greedy merging of the two nearest clusters."""
    groups = [[i] for i in range(len(xs))]
    d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1))

    def gap(a, b):
        if how == "ward":
            return 2 * len(a) * len(b) / (len(a) + len(b)) * ((xs[a].mean(0) - xs[b].mean(0)) ** 2).sum()
        return {"single": np.min, "complete": np.max, "average": np.mean}[how](d[np.ix_(a, b)])

    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: gap(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    label = np.empty(len(xs), int)
    for n, g in enumerate(groups):
        label[g] = n
    return label


def test_merge_trees_match_greedy_merging(spark):
    rng = np.random.default_rng(8)
    xs = np.vstack([rng.normal(size=(15, 2)), rng.normal(size=(10, 2)) * 0.3 + 3, rng.uniform(-4, 8, size=(9, 2))])
    xs = np.vstack([xs, xs[:4], xs[:2]])  # copies
    for how in cl.LINKAGES:
        for k, block in ((4, 2_000), (4, 9))[:1 if how in ("single", "complete") else 2]:
            want = brute_merge(xs, k, how)
            got = {r.id: r.cluster for r in cl.hierarchical(points(spark, xs), k, how, block_rows=block).collect()}
            assert len({(got[i], want[i]) for i in range(len(xs))}) == k == len(set(got.values())), (how, block)


def test_large_clusters_are_cut_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    xs = np.vstack([rng.normal(size=(30, 2)), rng.normal(size=(12, 2)) * 0.3 + 9, rng.uniform(12, 20, size=(6, 2))])
    nearest = cl._nearest

    def bounded(x, y, linkage):
        assert len(x) <= 7 and len(y) <= 7
        return nearest(x, y, linkage)

    monkeypatch.setattr(cl, "_nearest", bounded)
    for how in cl.LINKAGES:
        want = brute_merge(xs, 3, how)
        got = {r.id: r.cluster for r in cl.hierarchical(points(spark, xs), 3, how, block_rows=7).collect()}
        assert len({(got[i], want[i]) for i in range(len(xs))}) == 3 == len(set(got.values())), how


def test_ward_skips_blocks_that_are_too_far(spark, monkeypatch):
    monkeypatch.setattr(cl, "ALL_PAIRS_BLOCKS", 3)
    rng = np.random.default_rng(6)
    xs = np.vstack([rng.uniform(size=(40, 2)) * 4 + [20 * g, 0] for g in range(3)])
    report = []
    named, tree = cl.merge_tree(points(spark, xs), "ward", 8, report)
    place = {tuple(r.vec): r.cluster for r in named.collect()}
    assert tree.count() == len(xs) - 1 and max(r["read"] / r["pairs"] for r in report[:3]) < 0.5, report
    want = brute_merge(xs, 3, "ward")
    kept = [r for r in tree.collect() if r.height < 100]
    root = {c: c for c in place.values()}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for r in kept:
        root[find(r.b)] = find(r.a)
    assert len({(find(place[tuple(x)]), w) for x, w in zip(xs, want)}) == 3


def test_ties_still_give_k_clusters(spark):
    xs = np.array([[float(i), 0.0] for i in range(6)] + [[0.0, 0.0]])
    for how in ("single", "ward"):
        assert len({r.cluster for r in cl.hierarchical(points(spark, xs), 2, how).collect()}) == 2
    assert len({r.cluster for r in cl.hierarchical(points(spark, xs), 9, "average").collect()}) == 6


def test_silhouette_both_forms(spark):
    rng = np.random.default_rng(4)
    xs = rng.normal(size=(40, 2))
    label = (xs[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(i, list(map(float, v)), int(c)) for i, (v, c) in enumerate(zip(xs, label))], "id long, vec array<double>, cluster long")
    for exact in (False, True):
        d = ((xs[:, None] - xs[None]) ** 2).sum(-1)
        d = np.sqrt(d) if exact else d
        s = []
        for i in range(40):
            same = (label == label[i]) & (np.arange(40) != i)
            a, b = d[i, same].mean(), d[i, label != label[i]].mean()
            s.append((b - a) / max(a, b))
        assert abs(cl.silhouette(rows, exact).first().silhouette - np.mean(s)) < 1e-9


def test_features_reject_gaps(spark):
    import pytest
    with pytest.raises(ValueError):
        cl.prepare_features(spark.createDataFrame([(1, None), (2, 3.0)], "id int, x double"), "id")
    with pytest.raises(ValueError):
        cl.prepare_features(spark.createDataFrame([], "id int, x double"), "id")
