"""Sums and cross products of all numeric columns in one scan.

Each task multiplies its batches as matrices: with X the values and M the presence masks,
the products of M, X and X squared with M and of X with X hold everything that
pairwise-complete moments need. A task subtracts the first present value of each column,
so large offsets cost no digits, and gives one row per pair of columns. The rows of all
tasks are added up around their common least mean.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.kinds import number
from tidemark.session import settle

#: Values of a batch that are multiplied at once.
BATCH_VALUES = 1 << 20
PARTIAL = "i int, j int, n double, mx double, my double, xx double, yy double, xy double, odd double"


def _products(count: int, pairs: np.ndarray):
    """Map from rows of ``count`` numbers to one row per pair: rows where both are present, means, centred sums."""

    def run(batches):
        shift, known = np.zeros(count), np.zeros(count, bool)
        n, s, q, p, odd = (np.zeros((count, count)) for _ in range(5))
        for batch in batches:
            step = max(1, BATCH_VALUES // max(1, count))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(count)], axis=1).astype(np.float64)
                mask = ~np.isnan(x)
                infinite = np.isinf(x)
                fine = mask & ~infinite
                new = np.flatnonzero(~known & fine.any(axis=0))
                shift[new] = x[fine[:, new].argmax(axis=0), new]
                known[new] = True
                x = np.where(fine, x - shift, 0.0)
                m = mask.astype(np.float64)
                n += m.T @ m
                s += x.T @ m
                q += (x * x).T @ m
                p += x.T @ x
                if infinite.any():
                    odd += infinite.T.astype(np.float64) @ m
        i, j = pairs[:, 0], pairs[:, 1]
        rows = n[i, j] > 0
        i, j = i[rows], j[rows]
        both, sx, sy = n[i, j], s[i, j], s[j, i]
        columns = [i.astype(np.int32), j.astype(np.int32), both, shift[i] + sx / both, shift[j] + sy / both, q[i, j] - sx * sx / both,
                   q[j, i] - sy * sy / both, p[i, j] - sx * sy / both, odd[i, j] + odd[j, i]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "n", "mx", "my", "xx", "yy", "xy", "odd"])

    return run


def pair_moments(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(i, j, n, xx, yy, xy, odd) per pair of positions in ``cols`` with common rows: rows, centred sums, infinite values.

    ``df`` is read once, for any number of columns.
    """
    shaped = df.select(*[number(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    partial = settle(shaped.mapInArrow(_products(len(cols), np.array(pairs, np.int64).reshape(-1, 2)), PARTIAL), "products")
    pair = Window.partitionBy("i", "j")  # one row per task
    near = partial.withColumn("dx", F.col("mx") - F.min("mx").over(pair)).withColumn("dy", F.col("my") - F.min("my").over(pair))
    n, dx, dy = F.col("n"), F.col("dx"), F.col("dy")

    def whole(own, a, b):
        return F.sum(own) + F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / F.sum(n)

    return near.groupBy("i", "j").agg(whole("xx", dx, dx).alias("xx"), whole("yy", dy, dy).alias("yy"), whole("xy", dx, dy).alias("xy"),
                                      F.sum(n).cast("bigint").alias("n"), F.sum("odd").alias("odd"))
