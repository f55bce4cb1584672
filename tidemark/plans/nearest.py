"""Exact k nearest neighbours without a full pairing, by a pivot tree (pivot partitions: Lu et al. 2012).

Upper level: the corpus is partitioned by its nearest pivot; there are more pivots the
larger the corpus. From each partition's size and radius a query knows an upper bound for
its k-th distance, and visits only the partitions that can hold something closer.
Partitions and their query lists are cut into blocks of bounded size, so a dense spot that
attracts a third of the points is spread over many tasks. A query meets its nearest
block first; the k-th distance there bounds what the other blocks return.
Lower level: a block splits its rows by pivots of its own into leaves with centre and
radius. A query takes the leaves in the order of their lower bounds and stops where the
bound passes its k-th distance so far, which starts at the bound of the upper level. In many
dimensions leaves rule out little; there one matrix product reads the block for all queries of a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import settle

#: Least and most pivots of the upper level, and the rows that each is meant to attract.
PIVOTS = 64
MOST_PIVOTS = 4_096
PIVOT_ROWS = 10_000
BLOCK_ROWS = 20_000
#: Distances to pivots computed at once, and visits of queries to blocks handed on at once.
CELLS, VISIT_ROWS = 1 << 18, 20_000
#: Queries that walk the leaves of a block together.
ASKED_ROWS = 256
#: Every so many rows of a block give the first bound of the k-th distance.
PART_STEP = 8
#: Least rows of that part for each wanted neighbour.
PART_ROWS = 20
#: Share of a block's rows in reach of a query from which on the whole block is read at once.
SCAN_SHARE = 0.02


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype("float64") if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(corpus: DataFrame, count: int) -> np.ndarray:
    """The ``count`` corpus vectors with the smallest id hash: at most count small rows."""
    rows = corpus.orderBy(F.xxhash64("id"), "id").limit(count).select("vec").collect()
    return np.array([r.vec for r in rows], dtype="float64")


def _leaves(corpus: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(centres, radii, rows of each) of a block split by about as many of its rows as a leaf then holds."""
    count = max(1, math.isqrt(len(corpus)))
    centres = corpus[np.linspace(0, len(corpus) - 1, count).astype(int)]
    d = _distances(corpus, centres)
    home = d.argmin(1)
    order = np.argsort(home, kind="stable")
    used, first = np.unique(home[order], return_index=True)
    rows = np.split(order, first[1:])
    return centres[used], np.array([d[r, h].max() for r, h in zip(rows, used)]), rows


def _walk(queries: np.ndarray, bounds: np.ndarray, corpus: np.ndarray, leaves, take: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(query row, corpus row) pairs that hold the ``take`` nearest of each query, and the distances computed.

    Pairs as near as the last one are kept, up to rounding.
    """
    centres, radii, members = leaves
    least = np.maximum(_distances(queries, centres) - radii[None, :], 0.0)
    order = least.argsort(1)
    best = np.full((len(queries), take), np.inf)
    cut, found, read = bounds.copy(), [], 0
    # what the product form of a distance can be off by
    off = 1e-7 * math.sqrt(max((queries * queries).sum(1).max(initial=0.0), (corpus * corpus).sum(1).max(initial=0.0)))
    for step in range(len(members)):
        leaf = order[:, step]
        slack = cut + 1e-6 * (1.0 + np.where(np.isfinite(cut), cut, 0.0)) + off
        live = np.flatnonzero(least[np.arange(len(queries)), leaf] <= slack)
        if not len(live):
            break
        for one in np.unique(leaf[live]):
            asked, rows = live[leaf[live] == one], members[one]
            d = _distances(queries[asked], corpus[rows])
            read += d.size
            i, j = np.nonzero(d <= slack[asked][:, None])
            found.append(np.stack([asked[i], rows[j]]))
            merged = np.hstack([best[asked], np.sort(d, axis=1)[:, :take]])
            best[asked] = np.partition(merged, take - 1, axis=1)[:, :take]
        cut = np.minimum(bounds, best.max(axis=1))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), read
    row, col = np.hstack(found)
    return row, col, read


def _scan(queries: np.ndarray, bounds: np.ndarray, corpus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, corpus row) pairs within the bounds, up to rounding, by one matrix product."""
    qq, cc = (queries * queries).sum(1), (corpus * corpus).sum(1)
    off = 1e-7 * math.sqrt(max(qq.max(initial=0.0), cc.max(initial=0.0)))
    slack = bounds + 1e-6 * (1.0 + np.where(np.isfinite(bounds), bounds, 0.0)) + off
    square = (-2.0 * queries) @ corpus.T
    square += cc[None, :]
    return np.nonzero(square <= (slack * slack - qq)[:, None])


def _reach(queries: np.ndarray, bounds: np.ndarray, corpus: np.ndarray, leaves, take: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, corpus row) pairs that hold the ``take`` nearest of each query.

    The distances to a part of the corpus bound the k-th one. Where the leaves within that
    bound hold few rows, as in few dimensions, they are walked; else one product reads the block.
    """
    centres, radii, members = leaves
    part = corpus[::max(1, min(PART_STEP, len(corpus) // (PART_ROWS * take)))]
    if len(part) >= take:
        known = np.partition(_distances(queries, part), take - 1, axis=1)[:, take - 1]
        bounds = np.minimum(bounds, known)
    near = _distances(queries, centres) - radii[None, :] <= bounds[:, None]
    if (near @ np.array([len(rows) for rows in members])).sum() > SCAN_SHARE * len(queries) * len(corpus):
        return _scan(queries, bounds, corpus)
    return _walk(queries, bounds, corpus, leaves, take)[:2]


def _slices(batches: Iterator[pd.DataFrame], pivots: int) -> Iterator[pd.DataFrame]:
    """Rows so many at a time that their distances to all pivots are few."""
    step = max(1, CELLS // max(1, pivots))
    for pdf in batches:
        for start in range(0, len(pdf), step):
            yield pdf.iloc[start:start + step]


def _visits(batches: Iterator[pd.DataFrame], centres: np.ndarray, ids: np.ndarray, sizes: np.ndarray, radii: np.ndarray,
            slices: np.ndarray, k: int, largest: float) -> Iterator[pd.DataFrame]:
    """With a null limit the nearest block only, which gives the limit; else every block that can hold something as near.

    In many dimensions a query visits nearly every block, so visits leave VISIT_ROWS at a time and not a batch of queries at a time.
    """
    for pdf in _slices(batches, len(ids)):
        q = _matrix(pdf["vec"])
        # what the product form of a distance can be off by
        off = 1e-7 * (largest + np.sqrt((q * q).sum(1)))
        d = _distances(q, centres)
        reach = d + radii
        order = reach.argsort(1)
        filled = sizes[order].cumsum(1) >= k
        first = np.where(filled.any(1), filled.argmax(1), len(ids) - 1)
        bound = np.take_along_axis(reach, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]
        bound = np.where(filled.any(1), bound, np.inf)
        limit = pdf["limit"].to_numpy(dtype="float64", na_value=np.nan)
        home = np.isnan(limit)
        bound = np.where(home, bound, np.minimum(bound, limit))
        row, col = np.nonzero((d - radii <= (bound * (1 + 1e-6) + 1e-9 + off)[:, None]) & ~home[:, None])
        reps = slices[col]
        part = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        at = np.flatnonzero(home)
        row, col = np.concatenate([np.repeat(row, reps), at]), np.concatenate([np.repeat(col, reps), d[at].argmin(1)])
        # any slice bounds the k-th distance
        part = np.concatenate([part, at % slices[col[len(part):]]])
        kept = pdf.drop(columns="limit")
        for start in range(0, len(row), VISIT_ROWS):
            now = slice(start, start + VISIT_ROWS)
            out = kept.iloc[row[now]].reset_index(drop=True)
            yield out.assign(pivot=ids[col[now]].astype("int32"), slice=part[now].astype("int32"), bound=bound[row[now]])


def nearest(queries: DataFrame, corpus: DataFrame, k: int, skip_same_id: bool = False,
            pivots: int | None = None, block_rows: int = BLOCK_ROWS, report: list | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest corpus rows, ties by id.

    ``queries``: query_id, vec. ``corpus``: id, vec. Vectors are arrays of one length.
    ``report`` receives a dict with the pivots, the queries, and the visits of queries to blocks.

    Equal vectors tie everywhere: of corpus rows with one vector only those with the smallest
    ids can be among the nearest, and equal queries are searched once and get their ids back.
    """
    vec = lambda df: df.withColumn("vec", F.col("vec").cast("array<double>"))
    queries, corpus = vec(queries.select("query_id", "vec")), vec(corpus.select("id", "vec"))
    take = k + 1 if skip_same_id else k
    # a limit per vector, applied before the shuffle too
    ties = Window.partitionBy("vec").orderBy("id")
    corpus = corpus.withColumn("_tie", F.row_number().over(ties)).filter(F.col("_tie") <= take).drop("_tie")
    queries = settle(queries, "queries")
    # numbered once and written, so the numbers stay
    heads = settle(queries.select("vec").distinct().withColumn("head", F.monotonically_increasing_id()), "heads")
    hits = _nearest_rows(heads.select(F.col("head").alias("query_id"), "vec"), settle(corpus, "corpus"), take, pivots, block_rows, report)
    members = queries.join(heads, "vec").select("query_id", F.col("head"))
    out = members.join(hits.withColumnRenamed("query_id", "head"), "head").drop("head")
    if not skip_same_id:
        return out.select("query_id", "rank", "id", "distance")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (out.filter("query_id <> id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", "distance"))


def _nearest_rows(queries: DataFrame, corpus: DataFrame, k: int, pivots: int | None, block_rows: int, report: list | None) -> DataFrame:
    """``nearest`` of distinct query vectors."""
    q_type, c_type = queries.schema["query_id"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, corpus.count() // PIVOT_ROWS))
    centres = choose_pivots(corpus, pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches, len(centres)):
            if len(pdf):
                d = _distances(_matrix(pdf["vec"]), centres)
                best = d.argmin(1)
                yield pdf.assign(pivot=best.astype("int32"), away=d[np.arange(len(pdf)), best])

    # read for the sizes and for the search
    placed = settle(corpus.mapInPandas(assign, f"id {c_type}, vec array<double>, pivot int, away double"), "placed")
    # one row per pivot comes to the driver
    stats = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()
    if not stats:
        return queries.sparkSession.createDataFrame([], f"query_id {q_type}, rank int, id {c_type}, distance double")
    ids = np.array([s.pivot for s in stats])
    sizes = np.array([s.n for s in stats])
    radii = np.array([s.radius for s in stats])
    slices = np.maximum(1, np.ceil(sizes / block_rows)).astype(int)

    largest = float(np.sqrt((centres * centres).sum(1)).max() + radii.max())

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _visits(batches, centres[ids], ids, sizes, radii, slices, k, largest)

    def visited(asked: DataFrame, label: str) -> DataFrame:
        return settle(asked.select("query_id", "vec", "limit").mapInPandas(
            visits, f"query_id {q_type}, vec array<double>, pivot int, slice int, bound double"), label)

    def met(seen: DataFrame) -> DataFrame:
        """(query_id, id, distance): at most the k nearest of each block that a query visits."""
        # query lists per pivot are cut as well; the corpus slice is repeated for each piece
        asked = seen.groupBy("pivot", "slice").agg(F.count(F.lit(1)).alias("asks")).groupBy("pivot").agg(
            F.max("asks").alias("asks"))
        pieces = {r.pivot: max(1, math.ceil(r.asks / block_rows)) for r in asked.collect()}
        load = queries.sparkSession.createDataFrame(
            [(int(p), int(s), int(pieces.get(int(p), 0))) for p, s in zip(ids, slices)], "pivot int, slices int, pieces int")
        load = F.broadcast(load)  # one row per pivot
        cut = seen.join(load, "pivot").withColumn("piece", F.pmod(F.xxhash64("query_id"), F.col("pieces")).cast("int"))
        held = (placed.join(load, "pivot").filter("pieces > 0")
                .withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
                .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))))
        blocks = ["pivot", "slice", "piece"]
        return (cut.groupBy(*blocks).cogroup(held.select(*blocks, "id", "vec").groupBy(*blocks))
                .applyInPandas(search, f"query_id {q_type}, id {c_type}, distance double"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "distance": []})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values("id")
        corpus_m, ids_ = _matrix(right["vec"]), right["id"].to_numpy()
        leaves, found = _leaves(corpus_m), []
        for start in range(0, len(left), ASKED_ROWS):
            part = left.iloc[start:start + ASKED_ROWS]
            q = _matrix(part["vec"])
            row, col = _reach(q, part["bound"].to_numpy(), corpus_m, leaves, k)
            # recompute the survivors directly: equal pairs then get equal distances in every block
            exact = np.sqrt(((q[row] - corpus_m[col]) ** 2).sum(1))
            hit = pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "id": ids_[col], "distance": exact})
            # only the k nearest of each query outlive its batch
            found.append(hit.sort_values(["query_id", "distance", "id"]).groupby("query_id", sort=False).head(k))
        return pd.concat(found)

    # the nearest block first: its k-th distance keeps the other blocks from returning k rows each
    first = met(visited(queries.withColumn("limit", F.lit(None).cast("double")), "homes")).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("limit"))
    limits = settle(queries.join(first, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf))), "limits")
    seen = visited(limits, "visits")
    if report is not None:
        report.append({"pivots": len(ids), "queries": queries.count(), "visits": seen.count()})
    hits = met(seen)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", "distance"))
