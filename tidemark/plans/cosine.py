"""Best matches by a TF-IDF cosine whose weights depend on the query, in blocks with norm bounds.

Records are sparse vectors, their terms ordered from rare to frequent. A block of queries
meets a block of choices in one task, where products are taken over a run of terms at a
time. Each side knows the norm of its terms still to come. A pair is given up as soon as
its product so far plus the product of the two remaining norms cannot reach the query's
k-th best score in this block (or the threshold); rows and columns without a live pair
leave the matrices. What is left after the last term is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import settle

BLOCK_ROWS = 1024
#: Choices that are scored together, after which the k-th best scores rise.
CHOICES = 128
TERMS = 1024


def _own(total: float, df: np.ndarray) -> np.ndarray:
    """Weight of a term that the query holds as well."""
    return np.log((1 + total) / (2 + df)) + 1


def _base(total: float, df: np.ndarray) -> np.ndarray:
    return np.log((1 + total) / (1 + df)) + 1


class _Rows:
    """Sparse rows over positions of one term list, with the norm that is left from each run of terms on."""

    def __init__(self, at: list[np.ndarray], weights: list[np.ndarray], terms: int):
        self.at, self.weights = at, weights
        self.runs = max(1, math.ceil(terms / TERMS))
        self.edges = [np.searchsorted(a, np.arange(self.runs + 1) * TERMS) for a in at]
        squares = np.array([np.add.reduceat(np.append(w * w, 0.0), np.minimum(e[:-1], len(w))) * (np.diff(e) > 0)
                            for w, e in zip(weights, self.edges)]).reshape(len(at), self.runs)
        self.left = np.sqrt(np.maximum(squares[:, ::-1].cumsum(axis=1)[:, ::-1], 0.0))
        self.left = np.hstack([self.left, np.zeros((len(at), 1))])

    def dense(self, rows: np.ndarray, run: int, values: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), TERMS))
        for i, r in enumerate(rows.tolist()):
            a, b = self.edges[r][run], self.edges[r][run + 1]
            out[i, self.at[r][a:b] - run * TERMS] = values[r][a:b]
        return out


def best_in_block(queries: pd.DataFrame, choices: pd.DataFrame, total: float, threshold: float, k: int) -> pd.DataFrame:
    """(q, c, score): the k best choices of each query in the block that reach the threshold; ties by c."""
    q_terms = [np.array(x, np.int64) for x in queries["terms"]]
    c_terms = [np.array(x, np.int64) for x in choices["terms"]]
    q_df, c_df = ([np.array(x, np.float64) for x in side["dfs"]] for side in (queries, choices))
    q_w = [np.array(tf) * _own(total, d) for tf, d in zip(queries["tfs"], q_df)]
    c_w = [np.array(tf) * _own(total, d) for tf, d in zip(choices["tfs"], c_df)]
    c_high = [np.array(tf) * _base(total, d) for tf, d in zip(choices["tfs"], c_df)]
    # Terms of both sides, rare ones first; others only count in the norms.
    terms, first = np.unique(np.concatenate(c_terms), return_index=True)
    shared = np.isin(terms, np.concatenate(q_terms), assume_unique=False)
    order = np.lexsort((terms[shared], np.concatenate(c_df)[first][shared]))
    listed = terms[shared][order]
    place = np.argsort(listed)
    ranked = listed[place]

    def located(rows, *values):
        out = []
        for i, t in enumerate(rows):
            at = np.searchsorted(ranked, t)
            here = np.flatnonzero(at < len(ranked))
            here = here[ranked[at[here]] == t[here]]
            spots = place[at[here]]
            by = np.argsort(spots)
            out.append((spots[by], *(v[i][here][by] for v in values)))
        return [list(x) for x in zip(*out)]

    q_at, q_in = located(q_terms, q_w)
    c_at, c_in, c_up = located(c_terms, c_w, c_high)
    qs, cs = _Rows(q_at, q_in, len(listed)), _Rows(c_at, c_in, len(listed))
    ones = [np.ones(len(x)) for x in q_at]
    squares = [w * w - h * h for w, h in zip(c_in, c_up)]
    qq = np.array([(w * w).sum() for w in q_w])
    cc = np.array([(h * h).sum() for h in c_high])
    least_cc = np.maximum(cc + np.array([x.sum() for x in squares]), 1e-300)
    floor = np.full(len(queries), threshold)
    best: list[list[tuple]] = [[] for _ in range(len(queries))]
    names = choices["c"].tolist()
    for start in range(0, len(choices), CHOICES):
        cols, rows = np.arange(start, min(start + CHOICES, len(choices))), np.arange(len(queries))
        dot, fix = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)))
        for run in range(qs.runs):
            most = (dot + qs.left[rows, run][:, None] * cs.left[cols, run][None, :]) / np.sqrt(qq[rows][:, None] * least_cc[cols][None, :])
            live = most >= floor[rows][:, None] - 1e-9
            keep_r, keep_c = live.any(axis=1), live.any(axis=0)
            rows, cols, dot, fix = rows[keep_r], cols[keep_c], dot[np.ix_(keep_r, keep_c)], fix[np.ix_(keep_r, keep_c)]
            if not len(rows):
                break
            dot += qs.dense(rows, run, q_in) @ cs.dense(cols, run, c_in).T
            fix += qs.dense(rows, run, ones) @ cs.dense(cols, run, squares).T
        if not len(rows):
            continue
        norm = np.sqrt(qq[rows][:, None] * np.maximum(cc[cols][None, :] + fix, 0.0))
        score = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
        for i, r in enumerate(rows.tolist()):
            good = np.flatnonzero(score[i] >= floor[r] - 1e-9)
            if len(good):
                found = best[r] + [(-round(float(score[i, j]), 9), names[cols[j]], float(score[i, j])) for j in good if score[i, j] >= threshold]
                best[r] = sorted(found)[:k]
                if len(best[r]) == k:
                    floor[r] = max(threshold, -best[r][-1][0])
    rows = [(q, c, s) for q, found in zip(queries["q"], best) for _, c, s in found]
    return pd.DataFrame(rows, columns=["q", "c", "score"])


def vectors(counts: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """(key, terms, dfs, tfs): one sparse row per record from (key, term, tf); a term without a frequency has 0."""
    rows = counts.join(df, "term", "left").select(key, F.struct(F.xxhash64("term").alias("t"), F.coalesce("df", F.lit(0)).cast("double").alias("d"), "tf").alias("x"))
    # The distinct terms of one record.
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("x")).select(
        key, F.col("x.t").alias("terms"), F.col("x.d").alias("dfs"), F.col("x.tf").alias("tfs"))


def best_cosine(queries: DataFrame, choices: DataFrame, df: DataFrame, total: int, threshold: float, k: int = 1,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(q, c, score): the k choices of highest cosine per query, those that reach the threshold; ties by c.

    ``queries``: q, term, tf. ``choices``: c, term, tf. ``df``: term, df, counted over the
    ``total`` choices; a query counts as one more record that holds its own terms.
    """
    qv, cv = settle(vectors(queries, df, "q"), "queries"), settle(vectors(choices, df, "c"), "choices")
    parts = {side: max(1, math.ceil(v.count() / block_rows)) for side, v in (("q", qv), ("c", cv))}

    def dealt(v, own, other):
        part = F.pmod(F.xxhash64(own), F.lit(parts[own])).cast("int").alias(f"{own}_part")
        every = F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1))).alias(f"{other}_part")
        return v.select(own, "terms", "dfs", "tfs", part, every)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "c": [], "score": []})
        return best_in_block(left.sort_values("q"), right.sort_values("c"), float(total + 1), threshold, k)

    types = {side: v.schema[side].dataType.simpleString() for side, v in (("q", qv), ("c", cv))}
    blocks = ["q_part", "c_part"]
    found = dealt(qv, "q", "c").groupBy(*blocks).cogroup(dealt(cv, "c", "q").groupBy(*blocks)).applyInPandas(
        search, f"q {types['q']}, c {types['c']}, score double")
    order = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "c")  # at most k rows per block of choices
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
