"""Best partners of words by the length of their longest common subsequence, searched block against block in memory.

Words up to two characters apart are found by the words that are left when one or two
characters go, other pairs by what their characters allow: each block codes the occurrences
of its commonest characters as bits, so that one AND and one bit count bound what two words
share. Both are complete: what is found is compared itself, and a pair that is passed over
cannot reach the threshold or the best partner seen so far. No key and no pair is shuffled;
words are copied once per block of the other side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.similarity import common_lengths
from tidemark.plans.sizing import keep_parallel

#: Words of a block on the asking and on the answering side.
ASKED_ROWS, HELD_ROWS = 32_768, 131_072
#: Pairs bounded at once, and pairs compared at once.
CELLS, PAIRS = 1 << 18, 1 << 18
#: Characters up to which the words left after one or two deletions are listed, and words are compared by columns.
SHORT = 40
#: Multipliers of the hashes.
ODD, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words:
    """The words of one length: their places in the block, code points, and the bits of their characters."""

    def __init__(self, at: np.ndarray, texts: list[str], size: int):
        self.at, self.size = at, size
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), size)

    def items(self) -> np.ndarray:
        """A number per character and its how-manieth occurrence in the word."""
        nth = np.zeros(self.codes.shape, np.int64)
        for i in range(1, self.size):
            nth[:, i] = (self.codes[:, :i] == self.codes[:, i, None]).sum(axis=1)
        return self.codes.astype(np.int64) << 32 | nth

    def mark(self, common: np.ndarray) -> None:
        """``mask`` of the occurrences in ``common`` (sorted, 64 at most), ``lost`` the number of others."""
        items = self.items()
        place = np.minimum(np.searchsorted(common, items), len(common) - 1)
        known = common[place] == items
        self.mask = np.bitwise_or.reduce(np.where(known, np.uint64(1) << place.astype(np.uint64), np.uint64(0)), axis=1)
        self.lost = (~known).sum(axis=1)
        pairs = (self.codes[:, :-1].astype(np.uint64) * ODD + self.codes[:, 1:].astype(np.uint64) * BASE) * ODD >> np.uint64(57)
        self.pairs = [np.bitwise_or.reduce(np.where(pairs >> np.uint64(6) == np.uint64(half), np.uint64(1) << (pairs & np.uint64(63)), np.uint64(0)), axis=1)
                      for half in (0, 1)]
        self.pairs_lost = max(0, self.size - 1) - sum(np.bitwise_count(p).astype(np.int64) for p in self.pairs)

    def keys(self, gone: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every word that is left after ``gone`` characters, 0, 1 or 2, are taken out."""
        codes = (self.codes.astype(np.uint64) + np.uint64(1)) * ODD
        codes ^= codes >> np.uint64(29)
        powers = np.full(self.size, BASE, np.uint64).cumprod(dtype=np.uint64)
        zero = np.zeros((len(codes), 1), np.uint64)
        sums = [np.hstack([zero, (codes[:, step:] * powers[:self.size - step]).cumsum(axis=1, dtype=np.uint64)]) for step in range(gone + 1)]
        if gone == 0:
            out = sums[0][:, -1:]
        elif gone == 1:  # what stands before the place, and after it one place further down
            out = np.stack([sums[0][:, i] + sums[1][:, -1] - sums[1][:, i] for i in range(self.size)], axis=1) if self.size else zero[:, :0]
        else:
            out = np.stack([sums[0][:, i] + sums[1][:, j - 1] - sums[1][:, i] + sums[2][:, -1] - sums[2][:, j - 1]
                            for i in range(self.size) for j in range(i + 1, self.size)], axis=1) if self.size > 1 else zero[:, :0]
        return out.ravel(), np.repeat(np.arange(len(codes)), out.shape[1])


def _by_length(texts: list[str]) -> dict[int, _Words]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return {int(n): _Words(at, [texts[i] for i in at], int(n)) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]}


def percent_of(common: np.ndarray, total: int) -> np.ndarray:
    """Whole percent that ``common`` characters are of two words of ``total`` characters, as a fraction."""
    return np.rint(200.0 * common / total) / 100.0 if total else np.ones(np.shape(common))


def _lengths(a: _Words, b: _Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common subsequences of rows i of a and j of b."""
    if max(a.size, b.size) > SHORT:
        read = lambda w, rows: [c.tobytes().decode("utf-32-le", "surrogatepass") for c in w.codes[rows]]
        return common_lengths(read(a, i), read(b, j))
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS >> 4):
        x, y = np.ascontiguousarray(a.codes[i[at:at + (PAIRS >> 4)]].T), np.ascontiguousarray(b.codes[j[at:at + (PAIRS >> 4)]].T)
        row = np.zeros((b.size + 1, x.shape[1]), np.uint8)
        for c in x:
            before, left = row[0].copy(), row[0]
            for k in range(b.size):
                reached = before + (c == y[k])
                before = row[k + 1].copy()
                np.maximum(row[k + 1], reached, out=row[k + 1])
                np.maximum(row[k + 1], left, out=row[k + 1])
                left = row[k + 1]
        out[at:at + (PAIRS >> 4)] = row[-1]
    return out


class _Best:
    """Best score and, among equals, least value per asked word."""

    def __init__(self, rows: int, least: float, values: np.ndarray):
        self.score, self.held, self.values = np.full(rows, least), np.full(rows, -1, np.int64), values

    def take(self, asked: np.ndarray, held: np.ndarray, score: np.ndarray) -> None:
        ok = score >= self.score[asked]
        asked, held, score = asked[ok], held[ok], score[ok]
        order = np.lexsort((self.values[held], -score, asked))
        asked, held, score = asked[order], held[order], score[order]
        first = np.concatenate(([True], asked[1:] != asked[:-1])) if len(asked) else np.zeros(0, bool)
        asked, held, score = asked[first], held[first], score[first]
        was = self.held[asked]
        wins = (score > self.score[asked]) | (was < 0) | (self.values[held] < self.values[was])
        self.score[asked[wins]], self.held[asked[wins]] = score[wins], held[wins]


def _needed(score: np.ndarray, n: int, m: int) -> np.ndarray:
    """Least common characters with which words of n and m characters reach a score; more than both have if none does."""
    reach = percent_of(np.arange(min(n, m) + 1), n + m)
    return np.searchsorted(reach, score, side="left")


def _by_keys(asked: dict[int, _Words], held: dict[int, _Words], best: _Best, pairs: dict[tuple[int, int], int]) -> None:
    """Compares the words that share what is left after deletions, for pairs of lengths with the least common length."""
    known: dict = {}
    for (n, m), need in pairs.items():
        for common in range(need, min(n, m) + 1):
            if ("a", n, common) not in known:
                keys, rows = asked[n].keys(n - common)
                order = np.argsort(keys, kind="stable")
                known["a", n, common] = keys[order], rows[order]
            if ("h", m, common) not in known:
                known["h", m, common] = held[m].keys(m - common)
            (keys, rows), (wanted, of) = known["a", n, common], known["h", m, common]
            low = np.searchsorted(keys, wanted, side="left")
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == wanted) if len(keys) else np.zeros(0, np.int64)
            low, many = low[hit], np.searchsorted(keys, wanted[hit], side="right") - low[hit]
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            met = np.unique(rows[at] * np.int64(len(held[m].at)) + np.repeat(of[hit], many))
            i, j = met // len(held[m].at), met % len(held[m].at)
            # equal hashes of different words are told apart here
            best.take(asked[n].at[i], held[m].at[j], percent_of(_lengths(asked[n], held[m], i, j), n + m))


def _by_bits(a: _Words, h: _Words, best: _Best, most: int) -> None:
    """Compares the words of two lengths whose characters allow the best score so far; pairs with more than ``most`` common characters at least are done."""
    n, m = a.size, h.size
    step = max(1, CELLS // max(1, len(h.at)))
    wide = max(1, CELLS // step)
    found: list = []

    def compare() -> None:
        i, j = (np.concatenate(x) for x in zip(*found))
        found.clear()
        need = _needed(best.score[a.at[i]], n, m)
        shared = sum(np.bitwise_count(p[i] & q[j]).astype(np.int64) for p, q in zip(a.pairs, h.pairs)) + np.minimum(a.pairs_lost[i], h.pairs_lost[j])
        # of the n - 1 pairs of neighbours a character that goes breaks two, one that comes one
        ok = shared >= 3 * need - n - m - 1
        i, j = i[ok], j[ok]
        best.take(a.at[i], h.at[j], percent_of(_lengths(a, h, i, j), n + m))

    for at in range(0, len(a.at), step):
        rows = slice(at, at + step)
        need = _needed(best.score[a.at[rows]], n, m)
        open_ = np.flatnonzero(need <= min(n, m, most)) + at
        if not len(open_):
            continue
        need = np.maximum(_needed(best.score[a.at[open_]], n, m) - a.lost[open_], 0).astype(np.uint8)
        for to in range(0, len(h.at), wide):
            i, j = np.nonzero(np.bitwise_count(a.mask[open_, None] & h.mask[None, to:to + wide]) >= need[:, None])
            if len(i):
                found.append((open_[i], j + to))
        if sum(len(f[0]) for f in found) > PAIRS:
            compare()
    if found:
        compare()


def best_of_block(asked: list[str], held: list[str], values: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of asked words, places of their best partners, scores) in a block of words and one of partners with a score of ``least``."""
    # order of the values, to compare numbers
    order = np.empty(len(values), np.int64)
    order[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
    best, a, h = _Best(len(asked), least, order), _by_length(asked), _by_length(held)
    near, wide = {}, []
    for n in a:
        for m in h:
            need = int(_needed(np.array([least]), n, m)[0])
            if need > min(n, m):
                continue
            if not n + m:
                near[n, m] = 0
                continue
            # two characters apart at most: by what is left; that is also the quickest way to a high bound for the rest
            keys = max(need, -(-(n + m - 2) // 2))
            if keys <= min(n, m) and max(n, m) <= SHORT:
                near[n, m] = keys
            else:
                keys = min(n, m) + 1
            if need < keys:
                wide.append((abs(n - m), n, m, keys - 1))
    _by_keys(a, h, best, near)
    if wide:
        items, many = np.unique(np.concatenate([a[n].items().ravel() for n in {w[1] for w in wide}]), return_counts=True)
        common = np.sort(items[np.argsort(-many, kind="stable")[:64]])
        for words in [*(a[n] for n in {w[1] for w in wide}), *(h[m] for m in {w[2] for w in wide})]:
            words.mark(common)
        for _, n, m, most in sorted(wide):
            _by_bits(a[n], h[m], best, most)
    places = np.flatnonzero(best.held >= 0)
    return places, best.held[places], best.score[places]


def best_common(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(id, value, score): for each text of ``left``, the best partner of ``right`` in each of its blocks that reaches the threshold.

    ``left``: id, text. ``right``: value, text. Both settled, texts distinct. The score is
    2 * LCS / (sum of lengths) in whole percent; ties go to the lower value.
    """
    cut = {"left": max(1, math.ceil(left.count() / ASKED_ROWS)), "right": max(1, math.ceil(right.count() / HELD_ROWS))}
    a = left.select("id", "text", F.pmod(F.xxhash64("text"), F.lit(cut["left"])).cast("int").alias("lb"), F.explode(F.sequence(F.lit(0), F.lit(cut["right"] - 1))).alias("rb"))
    h = right.select("value", F.col("text").alias("held"), F.pmod(F.xxhash64("text"), F.lit(cut["right"])).cast("int").alias("rb2"),
                     F.explode(F.sequence(F.lit(0), F.lit(cut["left"] - 1))).alias("lb2"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "value": [], "score": []})
        i, j, score = best_of_block(x["text"].tolist(), y["held"].tolist(), y["value"].tolist(), threshold)
        return pd.DataFrame({"id": x["id"].to_numpy()[i], "value": y["value"].to_numpy()[j], "score": score})

    of = {f.name: f.dataType.simpleString() for f in right.schema}["value"]
    # few bytes and much work
    return (keep_parallel(a, "lb", "rb").groupBy("lb", "rb").cogroup(keep_parallel(h, "lb2", "rb2").groupBy("lb2", "rb2"))
            .applyInPandas(best, f"id string, value {of}, score double"))
