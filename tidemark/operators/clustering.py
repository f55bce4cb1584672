"""Clustering of numeric columns: k-means, density, hierarchical, and the silhouette."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.arithmetic import ratio
from tidemark.functions.kinds import is_missing, numeric_columns, ref
from tidemark.operators.cleaning import fit_scaler, scale
from tidemark.plans.components import connected_components, shortened
from tidemark.plans.ranks import running
from tidemark.plans.sizing import broadcast_if_small
from tidemark.plans.spanning import blocks_on_curve, bounding_boxes, close_blocks, curve, minimum_spanning_tree, near_boxes, passes_for
from tidemark.session import settle

SLICE_ROWS = 20_000
DIRECT_PAIRS = 250_000
#: Distances that the exact silhouette holds at once.
MOST_DISTANCES = 1 << 20


def prepare_features(df: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(id, vec): standardized numeric columns. Empty input or any null is an error."""
    cols = list(cols if cols is not None else [c for c in numeric_columns(df) if c != key])
    if not cols:
        raise ValueError("no numeric columns")
    gaps = sum([is_missing(df, c).cast("long") for c in df.columns], F.lit(0).cast("long"))
    state = df.agg(F.count(F.lit(1)).alias("n"), F.sum(gaps).alias("gaps")).first()
    if not state.n or state.gaps:
        raise ValueError("input is empty or contains null values")
    scaled = scale(df, fit_scaler(df, cols))
    return scaled.select(ref(key).alias("id"), F.array(*[ref(c) for c in cols]).alias("vec"))


def with_vector(points: DataFrame) -> DataFrame:
    return points.withColumn("features", array_to_vector("vec"))


def kmeans(points: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(id, vec, cluster) by Spark ML k-means."""
    rows = with_vector(points)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("id", "vec", F.col("cluster").cast("long").alias("cluster"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def silhouette(clustered: DataFrame, exact: bool = False) -> DataFrame:
    """Mean silhouette over all rows, one row.

    The default uses squared Euclidean distances, whose mean to a cluster needs
    only the cluster's count, sum and sum of squares: one aggregation and a
    projection. ``exact`` uses plain Euclidean distances, which has no such form
    and costs every pair of distinct points; equal points of a cluster are one with
    a weight, blocks of bounded size keep it within memory, and only sums per point
    and cluster leave a block.
    """
    sums = _euclidean_sums(clustered) if exact else _squared_sums(clustered).withColumn("copies", F.lit(1).cast("long"))
    own = F.col("cluster") == F.col("other")
    per = sums.groupBy("id", "cluster").agg(
        F.max("copies").alias("copies"),
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own, ratio(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.agg(ratio(F.sum(s * F.col("copies")), F.sum("copies")).alias("silhouette"),
                   F.coalesce(F.sum("copies"), F.lit(0).cast("long")).alias("rows"))


def _squared_sums(clustered: DataFrame) -> DataFrame:
    """(id, cluster, other, n, total): summed squared distances of a row to each cluster."""
    dims = clustered.select("cluster", F.posexplode("vec").alias("i", "x"), _dot(F.col("vec"), F.col("vec")).alias("q"))
    per_dim = dims.groupBy("cluster", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))
    # clusters x dimensions cells; the summary holds one row per cluster
    stats = per_dim.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda z: z["s"]).alias("s"),
        F.max("n").alias("n"), F.max("q").alias("q"))
    summary = stats.agg(F.collect_list(F.struct(F.col("cluster").alias("other"), "s", "n", "q")).alias("all")).first()["all"]
    cells = []
    for row in summary:
        centre = F.array(*[F.lit(float(x)) for x in row["s"]])
        total = row["n"] * _dot(F.col("vec"), F.col("vec")) + F.lit(float(row["q"])) - 2 * _dot(F.col("vec"), centre)
        cells.append(F.struct(F.lit(row["other"]).alias("other"), F.lit(row["n"]).alias("n"), F.greatest(total, F.lit(0.0)).alias("total")))
    return clustered.select("id", "cluster", F.inline(F.array(*cells)))


def _euclidean_sums(clustered: DataFrame, block_rows: int = 4_000) -> DataFrame:
    """(id, cluster, other, total, n, copies) per distinct point of a cluster, known by its smallest id; n counts rows.

    Distances are symmetric, so each pair of blocks is met once and gives the sums of both.
    """
    rows = settle(clustered.groupBy("cluster", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "silhouette")
    blocks = max(1, math.ceil(rows.count() / block_rows))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = placed.withColumnRenamed("block", "lb").withColumn("rb", F.explode(F.sequence(F.col("lb"), F.lit(blocks - 1))))
    right = placed.withColumnRenamed("block", "rb").withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("rb"))))
    id_type = rows.schema["id"].dataType.simpleString()

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "cluster": [], "other": [], "total": [], "n": [], "copies": []})
        alone, (x, y) = a["lb"].iloc[0] == b["rb"].iloc[0], (np.vstack(t["vec"].to_numpy()) for t in (a, b))
        ids, others = a["id"].to_numpy(), b["id"].to_numpy()
        (mine, of_a, size_a), (theirs, of_b, size_b) = ((*np.unique(t["cluster"].to_numpy(), return_inverse=True), t["copies"].to_numpy()) for t in (a, b))
        # a column per cluster, with the copies of its points
        to_a, to_b = (np.zeros((len(c), n)) for c, n in ((of_a, len(mine)), (of_b, len(theirs))))
        to_a[np.arange(len(of_a)), of_a], to_b[np.arange(len(of_b)), of_b] = size_a, size_b
        seen_a, seen_b = np.zeros((len(x), len(theirs))), np.zeros((len(y), len(mine)))
        squares, step = (y * y).sum(1), max(1, MOST_DISTANCES // len(y))
        for at in range(0, len(x), step):
            rows = slice(at, at + step)
            d = x[rows] @ y.T
            d *= -2
            d += (x[rows] * x[rows]).sum(1)[:, None]
            d += squares
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            d[ids[rows, None] == others[None, :]] = 0.0
            seen_a[rows] = d @ to_b
            seen_b += d.T @ to_a[rows]
        parts = []
        for one, names, total, held in ((a, theirs, seen_a, to_b), (b, mine, seen_b, to_a))[:1 if alone else 2]:
            for k, other in enumerate(names):
                parts.append(pd.DataFrame({"id": one["id"], "cluster": one["cluster"], "other": other, "total": total[:, k],
                                           "n": int(held[:, k].sum()), "copies": one["copies"]}))
        return pd.concat(parts)

    cells = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInPandas(
        sums, f"id {id_type}, cluster long, other long, total double, n long, copies long")
    return cells.groupBy("id", "cluster", "other").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("copies").alias("copies"))


# ---- density clusters ----

def _cells(points: DataFrame, eps: float) -> tuple[DataFrame, float, int]:
    """Points with their grid cell. The cell diagonal is eps, so all points of a cell are neighbours."""
    dims = len(points.select("vec").first()["vec"])
    side = eps / math.sqrt(dims) * (1 - 1e-12)
    cell = F.transform("vec", lambda x: F.floor(x / side).cast("long"))
    return points.withColumn("cell", cell), side, dims


def _neighbour_cells(cells: DataFrame, side: float, eps: float, dims: int) -> DataFrame:
    """(a, b): distinct occupied cells whose boxes come within eps, both directions.

    Candidates meet in coarse buckets over the first (at most three) dimensions,
    each covering a cell's whole reach, so only adjacent buckets are joined.
    """
    reach = math.ceil(eps / side)
    used = min(dims, 3)
    bucket = [F.floor(F.col("cell")[i] / reach) for i in range(used)]
    home = cells.select(F.col("cell").alias("b"), F.struct(*[c.alias(f"x{i}") for i, c in enumerate(bucket)]).alias("bucket"))
    shifts = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = cells.select(F.col("cell").alias("a"), *[c.alias(f"x{i}") for i, c in enumerate(bucket)])
    for i in range(used):
        around = around.withColumn("_s", F.explode(shifts)).withColumn(f"x{i}", F.col(f"x{i}") + F.col("_s")).drop("_s")
    around = around.select("a", F.struct(*[f"x{i}" for i in range(used)]).alias("bucket"))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double")),
                      F.lit(0.0), lambda acc, d: acc + d * d)
    return around.join(home, "bucket").filter(F.col("a") != F.col("b")).filter(gap * side * side <= eps * eps * (1 + 1e-9)).select("a", "b")


def _square_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, d: acc + d)


def _near_pairs(askers: DataFrame, pool: DataFrame, links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Askers (few per cell) against the pool rows of neighbour cells.

    A full cell is cut into slices of bounded size and its askers are repeated
    for each slice, so a cell with a third of the rows is many tasks.
    """
    cuts = sizes.select(F.col("cell").alias("b"), F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices"))
    visits = (askers.select(F.col("id").alias("aid"), F.col("vec").alias("avec"), F.col("cell").alias("a")).join(links, "a")
              .join(cuts, "b").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices"))
    held = (pool.select(F.col("id").alias("bid"), F.col("vec").alias("bvec"), F.col("cell").alias("b")).join(cuts, "b")
            .withColumn("slice", F.pmod(F.xxhash64("bid"), F.col("slices")).cast("int")).drop("slices"))
    return visits.join(held, ["b", "slice"]).withColumn("d2", _square_distance(F.col("avec"), F.col("bvec")))


def _linked_cells(core: DataFrame, links: DataFrame, side: float, eps: float, dims: int, direct: int = DIRECT_PAIRS) -> DataFrame:
    """(a, b): neighbour cells with two core points within eps of each other.

    Small cell pairs compare points. Large ones are refined level by level like a
    dual tree: sub-boxes that lie wholly within eps decide 'yes', boxes too far
    apart drop out, and only undecided boxes are split, so two dense cells never
    pair all their points.
    """
    sizes = core.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    pairs = (links.filter(F.col("a") < F.col("b")).join(sizes.select(F.col("cell").alias("a"), F.col("n").alias("na")), "a")
             .join(sizes.select(F.col("cell").alias("b"), F.col("n").alias("nb")), "b"))
    pairs = settle(pairs.withColumn("large", F.col("na") * F.col("nb") > direct), "cellpairs")
    small = pairs.filter(~F.col("large")).select("a", "b")
    side_of = lambda c: core.select(F.col("cell").alias(c), F.col("vec").alias(f"v{c}"))
    met = (small.join(side_of("a"), "a").join(side_of("b"), "b")
           .filter(_square_distance(F.col("va"), F.col("vb")) <= eps * eps).select("a", "b").distinct())
    open_pairs = pairs.filter("large").select("a", "b")
    if open_pairs.isEmpty():
        return met
    wanted = open_pairs.select(F.col("a").alias("cell")).unionByName(open_pairs.select(F.col("b").alias("cell"))).distinct()
    dense = settle(core.join(wanted, "cell", "left_semi").select("cell", "vec"), "dense")
    undecided = open_pairs.withColumn("sa", F.lit("")).withColumn("sb", F.lit(""))
    for level in range(1, 48):
        width = side / 2**level
        sub = F.concat_ws(",", F.transform("vec", lambda x: F.floor(x / width).cast("string")))
        parent = F.concat_ws(",", F.transform("vec", lambda x: F.floor(x / (width * 2)).cast("string"))) if level > 1 else F.lit("")
        spread = dense.select("cell", parent.alias("parent"), sub.alias("sub"), F.posexplode("vec").alias("i", "x"))
        edges = spread.groupBy("cell", "parent", "sub", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        boxes = edges.groupBy("cell", "parent", "sub").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("box"))
        boxes = settle(boxes, "boxes")
        ba = boxes.select(F.col("cell").alias("a"), F.col("parent").alias("sa"), F.col("sub").alias("na"), F.col("box").alias("xa"))
        bb = boxes.select(F.col("cell").alias("b"), F.col("parent").alias("sb"), F.col("sub").alias("nb"), F.col("box").alias("xb"))
        far = F.aggregate(F.zip_with("xa", "xb", lambda p, q: F.greatest(p["hi"] - q["lo"], q["hi"] - p["lo"])), F.lit(0.0), lambda acc, d: acc + d * d)
        near = F.aggregate(F.zip_with("xa", "xb", lambda p, q: F.greatest(p["lo"] - q["hi"], q["lo"] - p["hi"], F.lit(0.0))),
                           F.lit(0.0), lambda acc, d: acc + d * d)
        tested = settle(undecided.join(ba, ["a", "sa"]).join(bb, ["b", "sb"]).select(
            "a", "b", "na", "nb", (far <= eps * eps).alias("yes"), (near <= eps * eps).alias("maybe")).filter("maybe"), "tested")
        yes = tested.filter("yes").select("a", "b").distinct()
        met = met.unionByName(yes)
        undecided = tested.filter("not yes").join(yes, ["a", "b"], "left_anti").select(
            "a", "b", F.col("na").alias("sa"), F.col("nb").alias("sb"))
        if undecided.isEmpty():
            return met
    # boxes are now below rounding of the coordinates: one point decides
    last = undecided.join(side_of("a"), "a").join(side_of("b"), "b").filter(
        _square_distance(F.col("va"), F.col("vb")) <= eps * eps).select("a", "b").distinct()
    return met.unionByName(last)


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 5, direct: int = DIRECT_PAIRS) -> DataFrame:
    """(id, cluster, core): density clusters, -1 for noise; a point counts itself.

    Points of a cell are mutual neighbours, so a cell with ``min_samples`` points
    needs no distances at all. Border points join their nearest core point, ties
    to the smaller id, and clusters are numbered by their smallest core id, so the
    result does not depend on row order or partitioning.
    """
    placed, side, dims = _cells(points.select("id", "vec"), eps)
    placed = settle(placed, "placed")
    sizes = settle(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    links = settle(_neighbour_cells(sizes.select("cell"), side, eps, dims), "links")
    thin_cells = sizes.filter(F.col("n") < min_samples)
    thin = placed.join(thin_cells.select("cell", "n"), "cell")  # fewer than min_samples rows per cell
    counted = _near_pairs(thin, placed, links, sizes).filter(F.col("d2") <= eps * eps).groupBy("aid").agg(F.count(F.lit(1)).alias("seen"))
    judged = thin.join(counted, thin["id"] == counted["aid"], "left").withColumn(
        "core", F.col("n") + F.coalesce("seen", F.lit(0)) >= min_samples).select("id", "vec", "cell", "core")
    judged = settle(judged, "judged")
    thick = placed.join(thin_cells.select("cell"), "cell", "left_anti").withColumn("core", F.lit(True))
    flagged = thick.unionByName(judged)
    core = settle(flagged.filter("core").select("id", "vec", "cell"), "core")
    name = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    joined = _linked_cells(core, links, side, eps, dims, direct)
    graph = joined.select(name("a").alias("src"), name("b").alias("dst")).unionByName(
        core.select(name("cell").alias("src"), name("cell").alias("dst")).distinct())
    component = connected_components(graph)
    heads = core.groupBy(name("cell").alias("node"), "cell").agg(F.min("id").alias("first")).join(component, "node")
    firsts = heads.groupBy("component").agg(F.min("first").alias("first"))
    numbered = running(firsts.select(F.col("first").alias("value"), "component", F.lit(1).alias("one")), [], "value", ["one"])
    labels = settle(heads.select("cell", "component").join(
        numbered.select("component", (F.col("one_upto") - 1).cast("long").alias("cluster")), "component").select("cell", "cluster"), "labels")
    inside = core.join(labels, "cell").select("id", "cluster", F.lit(True).alias("core"))
    loose = judged.filter(~F.col("core"))
    core_sizes = core.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    own = core.select(F.col("cell").alias("a")).distinct().select("a", F.col("a").alias("b"))
    near = (_near_pairs(loose, core, links.unionByName(own), core_sizes).filter(F.col("d2") <= eps * eps)
            .groupBy("aid").agg(F.min_by("b", F.struct("d2", "bid")).alias("cell")))
    border = near.join(labels, "cell").select("aid", "cluster")
    outside = loose.join(border, loose["id"] == border["aid"], "left").select(
        "id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.lit(False).alias("core"))
    return inside.unionByName(outside)


def cluster_count(clustered: DataFrame) -> DataFrame:
    """Clusters without noise, noise rows, all rows."""
    return clustered.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("clusters"),
                         F.count_if(F.col("cluster") == -1).alias("noise"), F.count(F.lit(1)).alias("rows"))


# ---- hierarchical ----

LINKAGES = ("single", "complete", "average", "ward")


#: Numbers in the largest array of coordinate differences.
CELLS = 4_000_000
#: Points and clusters up to which 'average' goes on in one task, from centres and spreads.
ONE_TASK_POINTS = 200_000
#: The same for clusters in more dimensions than boxes can tell apart, and clusters under one box.
ONE_TASK_CLUSTERS, BOX_DIMS, LEAF_CLUSTERS = 20_000, 4, 32
#: Up to this many blocks, reading all pairs of them takes less time than finding the near ones.
ALL_PAIRS_BLOCKS = 16


def _gaps(x: pd.DataFrame, y: pd.DataFrame, linkage: str) -> tuple[list, list, np.ndarray]:
    """(names, weights, whether cut) of x and of y by cluster, and their distances folded over the rows at hand.

    Rows are sorted by cluster. 'average' gives weighted sums, 'ward' wants one row per cluster.
    """
    heads = [np.flatnonzero(np.concatenate(([True], np.diff(t["cluster"].to_numpy()) != 0))) for t in (x, y)]
    points, weights = [np.vstack(t["vec"].to_numpy()) for t in (x, y)], [t["weight"].to_numpy() for t in (x, y)]
    sides = [(t["cluster"].to_numpy()[h], np.add.reduceat(w, h), t["cut"].to_numpy()[h]) for t, h, w in zip((x, y), heads, weights)]
    fold = {"single": np.minimum, "complete": np.maximum, "average": np.add, "ward": np.add}[linkage]
    step, parts = max(1, CELLS // max(1, points[1].size)), []
    for at in range(0, len(points[0]), step):
        d, w = sum((x[at:at + step, None] - y[None, :]) ** 2 for x, y in zip(points[0].T, points[1].T)), weights[0][at:at + step, None]
        if linkage == "ward":
            d = 2 * w * weights[1] / (w + weights[1]) * d
        else:
            d = np.sqrt(d) * (w * weights[1] if linkage == "average" else 1)
        parts.append(fold.reduceat(d, heads[1], axis=1))
    return *sides, fold.reduceat(np.vstack(parts), heads[0], axis=0)


def _nearest(x: pd.DataFrame, y: pd.DataFrame, linkage: str) -> pd.DataFrame:
    """(cluster, partner, other, value, pairs) of two blocks, or of one with itself.

    Clusters that lie whole in their blocks give their nearest, with partner -1; a pair with a
    cut cluster gives what its points here add to its distance.
    """
    if not len(x) or not len(y):
        return pd.DataFrame({"cluster": [], "partner": [], "other": [], "value": [], "pairs": []})
    alone = x["lb"].iloc[0] == x["rb"].iloc[0]
    (mine, here, cut), (theirs, there, cut_there), fold = _gaps(x.sort_values("cluster", kind="stable"), y.sort_values("cluster", kind="stable"), linkage)
    if alone:  # the same number for a pair from both ends, whatever the order of a sum
        fold = np.triu(fold, 1)
        fold = fold + fold.T
    same, parted = mine[:, None] == theirs[None, :], cut[:, None] | cut_there[None, :]
    gap = np.where(same | parted, np.inf, fold / (here[:, None] * there[None, :]) if linkage == "average" else fold)
    found = []
    for names, others, g in ((mine, theirs, gap), (theirs, mine, gap.T))[:1 if alone else 2]:
        at = g.argmin(axis=1)  # the lowest number among equals, as names are sorted
        least = g[np.arange(len(names)), at]
        ok = np.isfinite(least)
        found.append(pd.DataFrame({"cluster": names[ok], "partner": -1, "other": others[at][ok], "value": least[ok], "pairs": 0.0}))
    i, j = np.nonzero(np.triu(parted & ~same) if alone else parted & ~same)
    a, b = np.minimum(mine[i], theirs[j]), np.maximum(mine[i], theirs[j])
    found.append(pd.DataFrame({"cluster": a, "partner": b, "other": b, "value": fold[i, j], "pairs": here[i] * there[j]}))
    return pd.concat(found)


def _in_blocks(members: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """Adds ``block``, of ``block_rows`` points in the order of their clusters, and ``cut``: the cluster lies in more than one."""
    if rows <= block_rows:
        return members.withColumns({"block": F.lit(0), "cut": F.lit(False)})
    ranked = running(members.withColumns({"value": F.struct("cluster", "point"), "one": F.lit(1)}), [], "value", ["one"])
    placed = settle(ranked.select(*members.columns, F.floor((F.col("one_upto") - 1) / block_rows).cast("int").alias("block")), "placed")
    cut = placed.groupBy("cluster").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo < hi").select("cluster", F.lit(True).alias("cut"))
    return placed.join(F.broadcast(cut), "cluster", "left").fillna(False, ["cut"])  # fewer cut clusters than blocks


def _ward_nearest(members: DataFrame, rows: int, block_rows: int, report: list | None) -> DataFrame:
    """(cluster, other, gap): the nearest cluster of each, from centres in blocks along a curve.

    Close blocks give each cluster a bound; beyond them only pairs of blocks are read whose boxes, with
    the least weights in them, come within the bound of a cluster.
    """
    named = members.select(F.col("cluster").alias("node"), "vec", "weight")
    placed = blocks_on_curve(named, block_rows, ["weight"]).select(F.col("node").alias("cluster"), "vec", "weight", F.lit(False).alias("cut"), "block")
    dims = placed.select(F.size("vec").alias("n")).first().n
    boxes = settle(bounding_boxes(placed, dims, F.min("weight").alias("weight")), "boxes")
    n_blocks = boxes.count()

    def read(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.col("a").alias("lb"), F.col("b").alias("rb"))
        left = pairs.join(placed.withColumnRenamed("block", "lb"), "lb")
        right = pairs.join(placed.withColumnRenamed("block", "rb"), "rb")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own, for both sides of the cogroup
        return left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInPandas(
            lambda x, y: _nearest(x, y, "ward"), "cluster long, partner long, other long, value double, pairs double").select("cluster", "value", "other")

    def folded(found: DataFrame) -> DataFrame:
        return settle(found.groupBy("cluster").agg(F.min(F.struct("value", "other")).alias("n")).select("cluster", "n.*"), "nearest")

    close = close_blocks(n_blocks, boxes)
    best, pairs_read = folded(read(close)), 2 * n_blocks - 1
    for few in passes_for(n_blocks):
        bound = placed.join(best, "cluster").groupBy("block").agg(F.max("value").alias("bound"))
        info = settle(boxes.join(bound, "block").withColumn("label", F.lit(-1)), "info")
        pairs = settle(near_boxes(info, few).join(close, ["a", "b"], "left_anti"), "pairs")
        pairs_read += pairs.count()
        best = folded(best.unionByName(read(pairs)))
    if report is not None:
        report.append({"clusters": rows, "read": pairs_read, "pairs": n_blocks * (n_blocks + 1) // 2})
    return best.select("cluster", "other", F.col("value").alias("gap"))


def _merged(names: np.ndarray, weights: np.ndarray, of: np.ndarray, limit: np.ndarray, linkage: str, farther, done: int) -> pd.DataFrame:
    """(a, b, height, round, into): merges of mutual nearest clusters below the ``limit`` of both, until there are none; ``into`` is where b ended.

    ``names`` ascend. ``of`` holds the centres for 'ward', else the distances of all pairs folded over their
    points (a sum for 'average'). ``limit`` is a lower bound of a cluster's distance to any cluster that is
    not here; ``farther(at, into)`` gives that of a ward cluster after a merge. Nearest ones are kept up to date, so a
    merge costs a row, not all pairs.
    """
    names, weights, of, limit = names.astype(np.int64), weights.astype(float).copy(), of.astype(float).copy(), limit.astype(float).copy()
    n, found = len(names), []

    def row(i: int) -> np.ndarray:
        if linkage == "ward":
            g = 2 * weights[i] * weights / (weights[i] + weights) * ((of - of[i]) ** 2).sum(-1)
        else:
            g = of[i] / (weights[i] * weights) if linkage == "average" else of[i].copy()
        g[i] = np.inf
        return g

    gap = np.vstack([row(i) for i in range(n)])
    gone = np.zeros(n, bool)
    near = gap.argmin(axis=1)  # the lowest name among equals
    least = gap[np.arange(n), near]
    while True:
        a = np.flatnonzero((near[near] == np.arange(n)) & (np.arange(n) < near) & ~gone & np.isfinite(least) & (least < limit) & (least < limit[near]))
        if not len(a):
            into: dict = {}
            for i, j, _, _ in reversed(found):  # the last merges first, so that each finds where its cluster ended
                into[j] = into.get(i, i)
            return pd.DataFrame(found, columns=["a", "b", "height", "round"]).assign(into=[into[f[1]] for f in found])
        b = near[a]
        for i, j in zip(a, b):
            found.append((names[i], names[j], least[i], done))
            w = weights[i] + weights[j]
            if linkage == "ward":
                of[i] = (of[i] * weights[i] + of[j] * weights[j]) / w
            else:
                of[i] = np.maximum(of[i], of[j]) if linkage == "complete" else of[i] + of[j]
                of[:, i] = of[i]
            limit[i] = {"ward": min(limit[i], limit[j]), "complete": max(limit[i], limit[j]),
                        "average": (limit[i] * weights[i] + limit[j] * weights[j]) / w}[linkage]
            weights[i] = w
            if linkage == "ward" and farther is not None:
                limit[i] = max(limit[i], farther(of[i], w))
        done += 1
        gone[b] = True
        gap[b], gap[:, b], least[b] = np.inf, np.inf, np.inf
        for i in a:
            g = row(i)
            g[gone] = np.inf
            gap[i], gap[:, i] = g, g
        stale = np.flatnonzero(~gone & (gone[near] | np.isin(near, a) | np.isin(np.arange(n), a)))
        for i in a:
            closer = ~gone & ((gap[i] < least) | ((gap[i] == least) & (i < near)))
            near[closer], least[closer] = i, gap[i][closer]
        near[stale] = gap[stale].argmin(axis=1)
        least[stale] = gap[stale, near[stale]]


def _to_boxes(x: np.ndarray, boxes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Least distance of each point to the boxes (rows of least weight, low, high); with ``weights`` ward's."""
    out, dims, step = np.full(len(x), np.inf), x.shape[1], max(1, CELLS // max(1, len(boxes)))
    low, high = boxes[:, 1:1 + dims], boxes[:, 1 + dims:]
    for at in range(0, len(x) if len(boxes) else 0, step):
        d = sum(np.maximum(np.maximum(low[None, :, i] - x[at:at + step, i, None], x[at:at + step, i, None] - high[None, :, i]), 0.0) ** 2 for i in range(dims))
        if weights is not None:
            w = weights[at:at + step, None]
            d = 2 * w * boxes[None, :, 0] / (w + boxes[None, :, 0]) * d
        out[at:at + step] = (d if weights is not None else np.sqrt(d)).min(axis=1)
    return out * (1 - 1e-9)


def _inside_block(rows: pd.DataFrame, linkage: str, boxes: np.ndarray, done: int) -> pd.DataFrame:
    """(a, b, height, round, into): the merges of clusters that lie whole in a block and are nearer to each other than anything outside.

    Clusters cut over blocks take no part; their points here are outside too.
    """
    rows = rows.sort_values(["cluster", "point"])
    whole, other = rows[~rows["cut"]], rows[rows["cut"]]
    if not len(whole):
        return pd.DataFrame({"a": [], "b": [], "height": [], "round": [], "into": []})
    beyond = np.delete(boxes, rows["block"].iloc[0], axis=0) if len(boxes) else boxes
    x, w = np.vstack(whole["vec"].to_numpy()), whole["weight"].to_numpy()
    if linkage == "ward":
        farther = (lambda at, into: _to_boxes(at[None, :], beyond, np.array([into]))[0]) if len(beyond) else None
        return _merged(whole["cluster"].to_numpy(), w, x, _to_boxes(x, beyond, w), linkage, farther, done)
    if len(other):
        beyond = np.vstack([beyond, np.hstack([np.zeros((len(other), 1)), *[np.vstack(other["vec"].to_numpy())] * 2])])
    limit, heads = _to_boxes(x, beyond), np.flatnonzero(np.concatenate(([True], np.diff(whole["cluster"].to_numpy()) != 0)))
    weight = np.add.reduceat(w, heads)
    if len(beyond):
        limit = np.maximum.reduceat(limit, heads) if linkage == "complete" else np.add.reduceat(limit * w, heads) / weight
    else:
        limit = np.full(len(heads), np.inf)
    (names, _, _), _, folded = _gaps(whole, whole, linkage)
    folded = np.triu(folded, 1)
    return _merged(names, weight, folded + folded.T, limit, linkage, None, done)


def _merge_inside(members: DataFrame, block_rows: int, linkage: str, done: int) -> DataFrame:
    """(a, b, height, round, into): merges that a block of ``block_rows`` points along the curve can tell by itself.

    Such a merge is one of the final tree whatever happens elsewhere, as no merge brings a third cluster nearer.
    """
    places = curve(members.filter("point = cluster").select(F.col("cluster").alias("node"), "vec")).select(F.col("node").alias("cluster"), "z")
    ordered = settle(members.join(places, "cluster").select(*members.columns, F.struct("z", "cluster", "point").alias("value"), F.lit(1).alias("one")), "curve")
    ranked = running(ordered, [], "value", ["one"])
    placed = settle(ranked.select(*members.columns, F.floor((F.col("one_upto") - 1) / block_rows).cast("int").alias("block")), "blocks")
    dims = placed.select(F.size("vec").alias("n")).first().n
    # one row per block of points
    found = bounding_boxes(placed, dims, F.min("weight").alias("weight")).orderBy("block").collect()
    boxes = np.array([[r.weight, *r.low, *r.high] for r in found])
    parts = placed.groupBy("cluster").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo < hi").select("cluster", F.lit(True).alias("cut"))
    held = placed.join(F.broadcast(parts), "cluster", "left").fillna(False, ["cut"])  # fewer cut clusters than blocks
    return settle(held.groupBy("block").applyInPandas(
        lambda rows: _inside_block(rows, linkage, boxes, done), "a long, b long, height double, round int, into long"), "merges")


def _average_merges(rows: pd.DataFrame, enough: int, done: int) -> pd.DataFrame:
    """(a, b, height, round, into): merges of mutual nearest clusters by 'average' until ``enough`` are left.

    The mean distance of two clusters is no less than that of their centres, and no more than the root of
    its square plus both mean squared distances to the centre. Only pairs that these bounds leave open are
    folded over their points, so memory grows with the points and not with their pairs.
    """
    rows = rows.sort_values(["cluster", "point"])
    label, x, w = rows["cluster"].to_numpy(), np.vstack(rows["vec"].to_numpy()), rows["weight"].to_numpy().astype(float)
    heads = np.flatnonzero(np.concatenate(([True], np.diff(label) != 0)))
    names, weights = label[heads].astype(np.int64), np.add.reduceat(w, heads)
    centres = np.add.reduceat(x * w[:, None], heads) / weights[:, None]
    sizes = np.diff(np.append(heads, len(x)))
    spread = np.add.reduceat(((x - np.repeat(centres, sizes, axis=0)) ** 2).sum(1) * w, heads) / weights
    held = np.split(np.arange(len(x)), heads[1:])
    n = len(names)
    node, known = np.arange(n), {}  # a merged cluster is a new node; one number per pair of nodes, the same from both ends
    alive, near, least, found = np.arange(n), np.full(n, -1), np.full(n, np.inf), []
    leaves, boxes, leaf_of, indexed = [], [], np.zeros(n, np.int64), n
    gone = np.zeros(n, bool)

    def fold(i: int, others: list) -> None:
        at = np.concatenate([held[j] for j in others])
        ends = np.cumsum([0, *[len(held[j]) for j in others[:-1]]])
        total, step = np.zeros(len(at)), max(1, CELLS // len(at))
        for start in range(0, len(held[i]), step):
            mine = held[i][start:start + step]
            square = sum((x[mine, None, c] - x[None, at, c]) ** 2 for c in range(x.shape[1]))
            total += w[mine] @ np.sqrt(square)
        for j, value in zip(others, np.add.reduceat(total * w[at], ends) / (weights[i] * weights[others])):
            known[(node[i], node[j]) if node[i] < node[j] else (node[j], node[i])] = value

    def index() -> None:
        """Cuts the clusters into leaves with boxes around their centres."""
        leaves.clear()
        open_ = [alive]
        while open_:
            part = open_.pop()
            if len(part) <= LEAF_CLUSTERS:
                leaf_of[part] = len(leaves)
                leaves.append(part)
                continue
            at = centres[part]
            axis = (at.max(axis=0) - at.min(axis=0)).argmax()
            order = np.argsort(at[:, axis], kind="stable")
            open_ += [part[order[len(part) // 2:]], part[order[:len(part) // 2]]]
        boxes[:] = [np.array([centres[leaf].min(axis=0) for leaf in leaves]), np.array([centres[leaf].max(axis=0) for leaf in leaves])]

    def apart(i: int, others: np.ndarray) -> np.ndarray:
        square = sum((centres[others, c] - centres[i, c]) ** 2 for c in range(x.shape[1]))
        square[others == i] = np.inf
        return square

    def look(i: int) -> None:
        low, high = boxes
        away = sum(np.maximum(np.maximum(low[:, c] - centres[i, c], centres[i, c] - high[:, c]), 0.0) ** 2 for c in range(x.shape[1]))
        first = np.argpartition(away, 3)[:4] if len(away) > 4 else np.arange(len(away))
        some = np.concatenate([leaves[k] for k in first])
        square = apart(i, some)
        bound = (square + spread[some] + spread[i]).min() if len(some) else np.inf
        others = np.concatenate([alive[:0], *(leaves[k] for k in np.flatnonzero(away <= bound * (1 + 1e-9)))]) if len(leaves) > 4 else some
        others.sort()
        square = apart(i, others)
        bound = np.sqrt((square + spread[others] + spread[i]).min()) * (1 + 1e-9) if len(others) else np.inf
        close = others[np.sqrt(square) <= bound] if np.isfinite(bound) else others[:0]
        keys = [(node[i], node[j]) if node[i] < node[j] else (node[j], node[i]) for j in close]
        new = [j for j, key in zip(close, keys) if key not in known]
        if new:
            fold(i, new)
        gaps = np.array([known[key] for key in keys])
        if len(gaps):
            at = gaps.argmin()  # the lowest name among equals
            near[i], least[i] = close[at], gaps[at]
        else:
            near[i], least[i] = -1, np.inf

    index()
    for i in alive:
        look(i)
    made = n
    while len(alive) > enough:
        a = alive[(near[alive] > alive) & (near[near[alive]] == alive)]
        if not len(a):  # rounded sums: a mean that is lower than both it was made of
            for i in alive:
                look(i)
            a = alive[(near[alive] > alive) & (near[near[alive]] == alive)]
            if not len(a):
                i = alive[least[alive].argmin()]
                if near[i] < 0:
                    break
                a = np.array([min(i, near[i])])
                near[a[0]], least[a[0]] = max(i, near[i]), least[i]
        b = near[a]
        for i, j in zip(a, b):
            found.append((names[i], names[j], least[i], done))
            total = weights[i] + weights[j]
            centre = (centres[i] * weights[i] + centres[j] * weights[j]) / total
            moved = [((centres[k] - centre) ** 2).sum() + spread[k] for k in (i, j)]
            spread[i] = (moved[0] * weights[i] + moved[1] * weights[j]) / total
            centres[i], weights[i], held[i], held[j] = centre, total, np.concatenate([held[i], held[j]]), None
            node[i], made = made, made + 1
            leaves[leaf_of[j]] = leaves[leaf_of[j]][leaves[leaf_of[j]] != j]
            for side, widen in zip(boxes, (np.minimum, np.maximum)):
                side[leaf_of[i]] = widen(side[leaf_of[i]], centre)
        done += 1
        gone[b] = True
        alive = alive[~gone[alive]]
        if 2 * len(alive) < indexed:
            index()
            indexed = len(alive)
        # no merge comes nearer to a cluster than what it was made of
        for i in alive[np.isin(near[alive], np.concatenate([a, b])) | np.isin(alive, a)]:
            look(i)
        if len(known) > 20 * n:  # pairs of clusters that are gone
            live = set(node[alive].tolist())
            known = {key: value for key, value in known.items() if key[0] in live and key[1] in live}
    into: dict = {}
    for i, j, _, _ in reversed(found):
        into[j] = into.get(i, i)
    return pd.DataFrame(found, columns=["a", "b", "height", "round"]).assign(into=[into[f[1]] for f in found])


def _finish_folded(members: DataFrame, rows: int, block_rows: int, linkage: str, done: int) -> DataFrame:
    """(a, b, height, round, into): all further merges of at most ``block_rows`` clusters, from the distances of all pairs of points, folded once."""
    last = max(1, math.ceil(rows / block_rows)) - 1
    placed = _in_blocks(members, rows, block_rows)
    asked = placed.withColumnRenamed("block", "lb").withColumn("rb", F.explode(F.sequence("lb", F.lit(last))))
    again = placed.select(*[F.col(c).alias(c) for c in placed.columns])  # columns of their own, for both sides of the cogroup
    held = again.withColumnRenamed("block", "rb").withColumn("lb", F.explode(F.sequence(F.lit(0), "rb")))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "value": []})
        alone = x["lb"].iloc[0] == x["rb"].iloc[0]
        (mine, _, _), (theirs, _, _), fold = _gaps(x.sort_values("cluster", kind="stable"), y.sort_values("cluster", kind="stable"), linkage)
        i, j = np.nonzero((mine[:, None] < theirs[None, :]) if alone else (mine[:, None] != theirs[None, :]))
        return pd.DataFrame({"a": np.minimum(mine[i], theirs[j]), "b": np.maximum(mine[i], theirs[j]), "value": fold[i, j]})

    met = asked.groupBy("lb", "rb").cogroup(held.groupBy("lb", "rb")).applyInPandas(meet, "a long, b long, value double")
    pairs = met.groupBy("a", "b").agg((F.max if linkage == "complete" else F.sum)("value").alias("value"))
    sizes = members.groupBy("cluster").agg(F.sum("weight").alias("value")).select(F.col("cluster").alias("a"), F.col("cluster").alias("b"), "value")

    def end(cells: pd.DataFrame) -> pd.DataFrame:  # at most block_rows squared cells
        own = cells[cells["a"] == cells["b"]].sort_values("a")
        names = own["a"].to_numpy()
        cells = cells[cells["a"] != cells["b"]]
        i, j = np.searchsorted(names, cells["a"].to_numpy()), np.searchsorted(names, cells["b"].to_numpy())
        folded = np.zeros((len(names), len(names)))
        folded[i, j] = folded[j, i] = cells["value"].to_numpy()
        return _merged(names, own["value"].to_numpy(), folded, np.full(len(names), np.inf), linkage, None, done)

    return settle(pairs.unionByName(sizes).withColumn("block", F.lit(0)).groupBy("block").applyInPandas(
        lambda cells: end(cells), "a long, b long, height double, round int, into long"), "merges")


def merge_tree(points: DataFrame, linkage: str = "ward", block_rows: int = 2_000, report: list | None = None) -> tuple[DataFrame, DataFrame]:
    """((vec, cluster), (a, b, height, round)): distinct points numbered, and every merge up to one cluster.

    'single' takes the edges of the minimum spanning tree. For the others, in each round all
    pairs of clusters that are each other's nearest are merged. Such a merge is one of the
    final tree wherever it comes in the order, as a merge never brings a third cluster nearer. Blocks hold ``block_rows`` points in every round,
    so a large cluster is cut over blocks: each pair of blocks gives one row per whole cluster, its
    nearest there, and for pairs with a cut cluster a partial maximum or sum, folded
    afterwards. The cost is every pair of points, in blocks. Ward's clusters are one row each,
    centre and weight, and only blocks whose boxes come near enough are read: ``report`` receives
    their number per round beside that of all pairs. Once all rows fit into one block, the same
    rounds go on in one task. Ties go to the lower number.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage: {linkage}")
    folded = points.groupBy("vec").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("id").alias("first"))
    numbered = running(folded.select("vec", "weight", F.struct("first").alias("value"), F.lit(1).alias("one")), [], "value", ["one"])
    named = settle(numbered.select("vec", "weight", (F.col("one_upto") - 1).cast("long").alias("cluster")), "named")
    if linkage == "single":
        tree = minimum_spanning_tree(named.select(F.col("cluster").alias("node"), "vec"), block_rows, report)
        return named.select("vec", "cluster"), tree
    members, merges, left = named.withColumn("point", F.col("cluster")), [], named.count()
    rows, done, inside, once = left, 0, left, 0  # merges of the last step inside blocks, and of the last round
    fold = {"single": F.min, "complete": F.max}.get(linkage, F.sum)
    dims = named.select(F.size("vec").alias("n")).first().n if left else 0

    def renamed_by(found: DataFrame) -> tuple[DataFrame, int, int]:
        """Members, clusters left and rounds done after these merges, which may follow each other."""
        made, last = found.agg(F.count(F.lit(1)), F.max("round")).first()
        groups = broadcast_if_small(found.select(F.col("b").alias("cluster"), "into"))
        joined = members.join(groups, "cluster", "left").select("vec", "weight", F.coalesce("into", "cluster").alias("cluster"), "point")
        return settle(_all_centres(joined) if linkage == "ward" else joined, "members"), left - made, last + 1

    while left > 1:
        if rows <= block_rows:
            start, none = done, np.empty((0, 0))
            parts = members.withColumns({"block": F.lit(0), "cut": F.lit(False)}).groupBy("block").applyInPandas(
                lambda block: _inside_block(block, linkage, none, start), "a long, b long, height double, round int, into long")
            merges.append(settle(parts, "merges"))
        elif linkage != "ward" and left <= block_rows:
            merges.append(_finish_folded(members, rows, block_rows, linkage, done))
        if left <= block_rows and merges and (rows <= block_rows or linkage != "ward"):
            if merges[-1].count() < left - 1:
                raise ValueError("points need finite distances")
            break
        if inside >= once or once < left // 10:  # what merges more; a chain of equal gaps goes from block to block
            found, before = _merge_inside(members, block_rows, linkage, done), left
            if not found.isEmpty():
                merges.append(found)
                members, left, done = renamed_by(found)
                rows = left if linkage == "ward" else rows
            inside = before - left
            if left <= block_rows:
                continue
        if linkage == "average" and rows <= ONE_TASK_POINTS and (left <= ONE_TASK_CLUSTERS or dims <= BOX_DIMS):
            start = done
            found = settle(members.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(
                lambda all_: _average_merges(all_, block_rows, start), "a long, b long, height double, round int, into long"), "merges")
            if not found.isEmpty():
                merges.append(found)
                members, left, done = renamed_by(found)
            if left <= block_rows:
                continue
        if linkage == "ward" and rows > ALL_PAIRS_BLOCKS * block_rows:
            best = _ward_nearest(members, rows, block_rows, report)
        else:
            last = max(1, math.ceil(rows / block_rows)) - 1
            placed = _in_blocks(members, rows, block_rows)
            asked = placed.withColumnRenamed("block", "lb").withColumn("rb", F.explode(F.sequence("lb", F.lit(last))))
            again = placed.select(*[F.col(c).alias(c) for c in placed.columns])  # columns of their own, for both sides of the cogroup
            held = again.withColumnRenamed("block", "rb").withColumn("lb", F.explode(F.sequence(F.lit(0), "rb")))
            near = asked.groupBy("lb", "rb").cogroup(held.groupBy("lb", "rb")).applyInPandas(
                lambda x, y: _nearest(x, y, linkage), "cluster long, partner long, other long, value double, pairs double")
            known = settle(near.groupBy("cluster", "partner").agg(F.min(F.struct("value", "other")).alias("n"), fold("value").alias("value"),
                                                                  F.sum("pairs").alias("pairs")), "known")
            parted = known.filter("partner >= 0").select("cluster", "partner", (F.col("value") / F.col("pairs") if linkage == "average" else F.col("value")).alias("gap"))
            seen = (known.filter("partner < 0").select("cluster", F.col("n.value").alias("gap"), F.col("n.other").alias("other"))
                    .unionByName(parted.select("cluster", "gap", F.col("partner").alias("other")))
                    .unionByName(parted.select(F.col("partner").alias("cluster"), "gap", F.col("cluster").alias("other"))))
            best = seen.groupBy("cluster").agg(F.min(F.struct("gap", "other")).alias("n")).select("cluster", F.col("n.other").alias("other"), F.col("n.gap").alias("gap"))
            best = settle(best, "nearest")
        back = best.select(F.col("cluster").alias("other"), F.col("other").alias("cluster"))
        pairs = settle(best.filter("cluster < other").join(back, ["cluster", "other"])
                       .select(F.col("cluster").alias("a"), F.col("other").alias("b"), F.col("gap").alias("height"), F.lit(done).alias("round")), "merges")
        merges.append(pairs)
        done += 1
        renamed = broadcast_if_small(pairs.select(F.col("b").alias("cluster"), F.col("a").alias("into")))
        joined = members.join(renamed, "cluster", "left").select("vec", "weight", F.coalesce("into", "cluster").alias("cluster"), "point")
        once = pairs.count()
        left -= once
        if linkage == "ward":
            joined, rows = _centres(joined), left
        members = settle(joined, "members")
    tree = points.sparkSession.createDataFrame([], "a long, b long, height double, round int")
    for part in merges:
        tree = tree.unionByName(part.select(*tree.columns))
    return named.select("vec", "cluster"), settle(tree, "tree")


def _centres(members: DataFrame) -> DataFrame:
    """One row per cluster, its centre and weight, from the one or two clusters that it was."""
    both = members.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("point", "weight", "vec"))).alias("of"))
    a, b = F.get("of", 0), F.get("of", 1)
    centre = F.zip_with(a["vec"], b["vec"], lambda p, q: (p * a["weight"] + q * b["weight"]) / (a["weight"] + b["weight"]))
    return both.select(F.when(b.isNull(), a["vec"]).otherwise(centre).alias("vec"), (a["weight"] + F.coalesce(b["weight"], F.lit(0.0))).alias("weight"),
                       "cluster", F.col("cluster").alias("point"))


def _all_centres(members: DataFrame) -> DataFrame:
    """One row per cluster, its centre and weight, from the clusters that it was."""
    dims = members.select(F.size("vec").alias("n")).first().n
    # at most as many clusters as a block holds, always in the same order
    of = members.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("point", "weight", "vec"))).alias("of"))
    total = lambda part: F.aggregate("of", F.lit(0.0), lambda acc, x: acc + part(x))
    weight = total(lambda x: x["weight"])
    return of.select(F.array(*[total(lambda x, i=i: x["vec"][i] * x["weight"]) / weight for i in range(dims)]).alias("vec"), weight.alias("weight"),
                     "cluster", F.col("cluster").alias("point"))


def hierarchical(points: DataFrame, k: int = 3, linkage: str = "ward", seed: int = 42, block_rows: int = 2_000) -> DataFrame:
    """(id, vec, cluster) for 'ward', 'complete', 'average', 'single' or 'bisecting'.

    The first four build the whole merge tree and undo its k - 1 highest merges, so there
    are always k clusters (or as many as there are distinct points); of equal heights the
    later merge is undone first.
    """
    if linkage == "bisecting":
        rows = with_vector(points)
        model = BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(rows)
        return model.transform(rows).select("id", "vec", F.col("cluster").cast("long").alias("cluster"))
    named, tree = merge_tree(points.select("id", "vec"), linkage, block_rows)
    undone = tree.orderBy(F.desc("height"), F.desc("round"), F.desc("a")).limit(k - 1)
    kept = tree.join(undone, ["a", "b", "round"], "left_anti")
    groups = connected_components(shortened(kept, "a", "b"))
    firsts = named.join(groups, F.col("cluster") == F.col("node"), "left").select("vec", F.coalesce("component", "cluster").alias("first"))
    order = firsts.select("first").distinct().select(F.col("first").alias("value"), F.lit(1).alias("one"))  # k rows
    labels = running(order, [], "value", ["one"]).select(F.col("value").alias("first"), (F.col("one_upto") - 1).cast("long").alias("cluster"))
    return points.join(firsts.join(F.broadcast(labels), "first"), "vec").select("id", "vec", "cluster")
