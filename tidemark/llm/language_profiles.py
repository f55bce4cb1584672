"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams of 1 to 3 letters, words being
padded with one mark on each side. A document's own list is compared with each profile:
the distance sums, over its n-grams, how far apart the ranks are; an n-gram that the
profile lacks costs the full profile length. The nearest language wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import map_texts, slices, worker_store

PROFILE = 400
MARK = ord("_")
#: An n-gram's code holds its code points, this many bits each, so it is exact and sorts alike everywhere.
BITS = 21
#: The same for texts whose letters all lie below NARROW: half the bytes to sort.
NARROW_BITS, NARROW = 10, 1 << 10
UNKNOWN = "und"
#: Languages at most; there are fewer codes than this in the widest standard.
LANGUAGES = 10_000
#: Distinct n-grams that a task gathers before it adds them up.
HELD = 2_000_000


def letter_table() -> np.ndarray:
    """Whether each code point is a letter, made once per worker."""
    return worker_store("letters", lambda: {"is": np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)})["is"]


def grams_of(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, int]:
    """(codes of all n-grams of the text's lower-cased words, bits per letter in them). Words are runs of letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letters[codes]
    if not inside.any():
        return np.zeros(0, np.int64), BITS
    # One mark between two words serves both: n-grams with a mark in the middle are left out.
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    marked = np.where(inside, codes, MARK)[keep]
    word = inside[keep]
    wide = int(marked.max()) >= NARROW
    bits = BITS if wide else NARROW_BITS
    edge = np.zeros(1, bool)
    marked = np.concatenate(([MARK], marked, [MARK])).astype(np.int64 if wide else np.int32)
    word = np.concatenate((edge, word, edge))
    two = marked[:-1] << bits | marked[1:]
    three = two[:-1] << bits | marked[2:]
    return np.concatenate([marked[word], two[word[:-1] | word[1:]], three[word[1:-1]]]), bits


def counted(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes with BITS per letter, counts)."""
    ordered = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(first, len(ordered)))
    distinct = ordered[first].astype(np.int64)
    if bits != BITS:
        low = (1 << bits) - 1
        distinct = (distinct >> 2 * bits) << 2 * BITS | (distinct >> bits & low) << BITS | distinct & low
    return distinct, counts


class Profiles:
    """Ranks of the n-grams of all profiles, by code."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages, self.letters = sorted(profiles), letter_table()
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p] + [-1], np.int64))
        self.ranks = np.full((len(self.codes), len(self.languages)), PROFILE, np.int32)
        for j, name in enumerate(self.languages):
            own = np.array(profiles[name], np.int64)
            self.ranks[np.searchsorted(self.codes, own), j] = np.arange(len(own))

    def top(self, text: str | None) -> np.ndarray:
        """Codes of the text's most frequent n-grams, by falling count, then by code."""
        codes, bits = grams_of(text, self.letters)
        if not len(codes):
            return codes
        distinct, counts = counted(codes, bits)
        if len(distinct) > PROFILE:
            keep = counts >= np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
            distinct, counts = distinct[keep], counts[keep]
        return distinct[np.lexsort((distinct, -counts))][:PROFILE]

    def predict(self, text: str | None) -> tuple[str, float]:
        top = self.top(text)
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        ranks = np.where((self.codes[at] == top)[:, None], self.ranks[at], PROFILE)
        own = np.arange(len(top), dtype=np.int32)[:, None]
        distance = np.where(ranks < PROFILE, np.abs(ranks - own), PROFILE).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (PROFILE * len(top))


def learn_profiles(docs: DataFrame, text_col: str, lang_col: str, size: int = PROFILE) -> dict[str, list[int]]:
    """Per language its ``size`` most frequent n-grams (ties by code), from all rows with a language.

    Each task adds up n-grams and sends one row per language and n-gram; the sums run as a
    partial and a final aggregation, and the ranking keeps ``size`` rows per language
    before its shuffle. What the driver gets is bounded by ``LANGUAGES`` times ``size``.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        letters = letter_table()
        held: dict[str, list] = {}
        size = 0

        def summed(parts):
            codes, counts = (np.concatenate(x) for x in zip(*parts))
            distinct, at = np.unique(codes, return_inverse=True)
            return distinct, np.bincount(at, counts).astype(np.int64)

        def flush():
            for lang, parts in held.items():
                distinct, counts = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct, pa.int64()),
                                                  pa.array(counts, pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in slices(batches):
            found: dict[tuple[str, int], list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, bits = grams_of(text, letters)
                found.setdefault((lang, bits), []).append(codes)
            for (lang, bits), parts in found.items():
                codes = np.concatenate(parts)
                if len(codes):
                    held.setdefault(lang, []).append(counted(codes, bits))
            size = sum(len(p[0]) for parts in held.values() for p in parts)
            if size > HELD:
                for lang, parts in held.items():
                    held[lang] = [summed(parts)]
                if sum(len(p[0]) for parts in held.values() for p in parts) > HELD // 2 or len(held) > 512:
                    yield from flush()
        yield from flush()

    summed = rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram")))) \
        .filter(F.col("rank") <= size).select("lang", "gram", "rank")
    found = ranked.limit(LANGUAGES * size + 1).collect()
    if len(found) > LANGUAGES * size:
        raise ValueError(f"more than {LANGUAGES} languages: the language column does not hold languages")
    profiles: dict[str, list] = {}
    for r in found:
        profiles.setdefault(r.lang, []).append((r["rank"], r.gram))
    return {lang: [g for _, g in sorted(grams)] for lang, grams in profiles.items()}


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """The columns ``kept`` of ``docs`` (default: its first), ``lang_pred`` and ``score`` (1: same ranks, 0: nothing in common).

    ``und`` with score 0 for a null text, one without letters, or when there is no profile.
    Ties go to the language that sorts first. Per row, without a shuffle; the whole text counts.
    """

    def start():
        known = Profiles(profiles)
        return lambda texts: map(known.predict, texts)

    return map_texts(docs, [text_col], kept or [docs.columns[0]], {"lang_pred": "string", "score": "double"}, start)


def trained(docs: DataFrame, text_col: str, lang_col: str, learn_from: Column, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the rows that ``learn_from`` picks."""
    return learn_profiles(docs.filter(learn_from), text_col, lang_col, size)
