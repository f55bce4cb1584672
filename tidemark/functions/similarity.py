"""Edit similarities of candidate pairs, as Arrow functions over string columns; a batch of pairs is compared at once in NumPy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


#: Numbers in the largest array of character comparisons of a batch.
CELLS = 1 << 22


def _codes(texts: Sequence[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with ``filler``, lengths) of the texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.full((len(texts), int(sizes.max(initial=0))), filler, np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out, sizes


def _batches(a: Sequence[str], b: Sequence[str]):
    """Positions of pairs of like lengths, so many at a time that their comparisons fit."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    start = 0
    while start < len(order):
        stop, most = start, np.zeros(2, np.int64)
        while stop < len(order):
            grown = np.maximum(most, sizes[order[stop]])
            if stop > start and (stop + 1 - start) * max(1, int(grown.prod())) > CELLS:
                break
            most, stop = grown, stop + 1
        yield order[start:stop]
        start = stop


def common_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences, bit-parallel (Hyyro 2004) over all pairs at once, 63 characters of ``a`` to a word."""
    out = np.zeros(len(a), np.int64)
    for at in _batches(a, b):
        (x, nx), (y, ny) = _codes([a[i] for i in at], -1), _codes([b[i] for i in at], -2)
        if not x.shape[1] or not y.shape[1]:
            continue
        words = -(-x.shape[1] // 63)
        x = np.pad(x, ((0, 0), (0, words * 63 - x.shape[1])), constant_values=-1).reshape(len(at), words, 63)
        full = np.uint64((1 << 63) - 1)
        powers = np.uint64(1) << np.arange(63, dtype=np.uint64)
        rows = np.full((len(at), words), full)
        for j in range(y.shape[1]):
            match = ((x == y[:, j, None, None]) * powers).sum(axis=2, dtype=np.uint64)
            hit = rows & match
            rest = rows - hit  # a subset of the bits: no borrow
            carry = np.zeros(len(at), np.uint64)
            for w in range(words):
                total = rows[:, w] + hit[:, w] + carry
                rows[:, w], carry = (total & full) | rest[:, w], total >> np.uint64(63)
        # Places beyond the text never match and stay set.
        out[at] = words * 63 - np.bitwise_count(rows).sum(axis=1).astype(np.int64)
    return out


def whole_percents(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """2 * LCS / (len a + len b), rounded to whole percent, as fractions; 1 for two empty texts."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.float64)
    share = np.divide(200.0 * common_lengths(a, b), total, out=np.full(len(total), 100.0), where=total > 0)
    return np.rint(share) / 100.0


def transposing_distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Edits counting a swap of neighbours as one (Damerau 1964), unrestricted, for all pairs at once."""
    out = np.zeros(len(a), np.int64)
    for at in _batches(a, b):
        (x, nx), (y, ny) = _codes([a[i] for i in at], -1), _codes([b[i] for i in at], -2)
        n, every = len(at), np.arange(len(at))
        far = nx + ny
        grid = np.zeros((n, x.shape[1] + 2, y.shape[1] + 2), np.int64)
        grid[:, 0, :], grid[:, :, 0] = far[:, None], far[:, None]
        grid[:, 1:, 1], grid[:, 1, 1:] = np.arange(x.shape[1] + 1), np.arange(y.shape[1] + 1)
        seen = np.zeros((n, y.shape[1]), np.int64)  # the last row before this one that holds b's character
        for i in range(1, x.shape[1] + 1):
            same = x[:, i - 1, None] == y
            column = np.zeros(n, np.int64)
            for j in range(1, y.shape[1] + 1):
                k, hit = seen[:, j - 1], same[:, j - 1]
                swap = grid[every, k, column] + (i - k - 1) + 1 + (j - column - 1)
                grid[:, i + 1, j + 1] = np.minimum(np.minimum(grid[:, i, j] + ~hit, np.minimum(grid[:, i + 1, j], grid[:, i, j + 1]) + 1), swap)
                column = np.where(hit, j, column)
            seen[same] = i
        out[at] = grid[every, nx + 1, ny + 1]
    return out


@F.pandas_udf(T.DoubleType())
def ratio_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(whole_percents(a.to_list(), b.to_list()), dtype="float64")


@F.pandas_udf(T.LongType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(transposing_distances(a.to_list(), b.to_list()), dtype="int64")


def levenshtein_score(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return 1.0 - F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), longest.cast("double")), F.lit(0.0))


def words(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\pL\pN_]{2,}"), F.lit(0))


def char_grams(text: Column, n: int) -> Column:
    """Runs of ``n`` code points. The characters are cut once; a substring per position would read the text from its start each time."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    runs = F.greatest(F.size(chars) - (n - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(chars, F.lit(i + 1), runs) for i in range(n)])
    grams = F.transform(zipped, lambda x: F.concat(*[x[str(i)] for i in range(n)]))
    return F.coalesce(grams, F.array().cast("array<string>"))
