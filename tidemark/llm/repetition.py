"""Quality rules on repetition: characters inside repeated word n-grams and lines, by rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import SPACES, map_texts, slices, words_of

BASE = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = "#*$%&|<>"
#: Per mille of the word characters that copies of one n-gram may take.
TOP_LIMITS = {2: 300, 3: 280, 4: 260}
#: Per mille of the word characters that may lie inside n-grams found twice or more.
REPEAT_LIMITS = dict.fromkeys(range(5, 11), 300)
#: Per mille of the word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 300
MIN_WORDS = 20
WINDOW = 8

MADE = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
        "base_failed": "boolean", "kept": "boolean", "dup_line_chars": "bigint",
        **{f"top{n}_chars": "bigint" for n in TOP_LIMITS}, **{f"repeat{n}_chars": "bigint" for n in REPEAT_LIMITS}}


def _repeats(ids: np.ndarray, lengths: np.ndarray) -> tuple[dict[int, int], dict[int, int], int]:
    """(most characters in copies of one n-gram by n, characters inside repeated n-grams by n, words in repeated windows).

    The hash of an n-gram rolls on from that of the (n-1)-gram: H_n[i] = H_{n-1}[i] * B + id[i + n - 1].
    A repeated n-gram starts with a repeated (n-1)-gram, so each length sorts only what the one before left.
    """
    top, inside, window = dict.fromkeys(TOP_LIMITS, 0), dict.fromkeys(REPEAT_LIMITS, 0), 0
    n_words = len(ids)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    starts, rolled = np.arange(n_words), ids.copy()
    for n in range(2, max(max(REPEAT_LIMITS), max(TOP_LIMITS), WINDOW) + 1):
        fits = starts <= n_words - n
        starts, rolled = starts[fits], rolled[fits]
        if len(starts) < 2:
            break
        with np.errstate(over="ignore"):
            rolled = rolled * BASE + ids[starts + n - 1]
        order = np.argsort(rolled)
        ordered = rolled[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        group = np.cumsum(first) - 1
        counts = np.bincount(group)
        again = counts[group] > 1
        if n in top and again.any():
            heads = starts[order[first]]
            top[n] = int(((ends[heads + n] - ends[heads]) * counts)[counts > 1].max())
        left = np.sort(order[again])
        starts, rolled = starts[left], rolled[left]
        if n in inside or n == WINDOW:
            edge = np.zeros(n_words + 1, dtype=np.int32)
            edge[starts] += 1
            edge[starts + n] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            if n in inside:
                inside[n] = int(lengths[covered].sum())
            if n == WINDOW:
                window = int(covered.sum())
    return top, inside, window


def measure(text: str | None, hashes: dict | None = None) -> tuple:
    """One row of ``MADE`` for a text; null counts as a text without words."""
    text = text or ""
    words = words_of(text)
    n_words = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
    chars = int(lengths.sum())
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, words_of(line)))
        elif line.strip(SPACES):
            seen.add(line)
    # Python's own 64-bit string hash: used for equality inside one document only.
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=n_words).view(np.uint64)
    ids = ids ^ (ids >> np.uint64(29))
    top, inside, window = _repeats(ids, lengths)
    base_failed = n_words < MIN_WORDS or 100 * window > 30 * n_words
    rejected = (1000 * dup_chars > LINE_LIMIT * chars
                or any(1000 * top[n] > limit * chars for n, limit in TOP_LIMITS.items())
                or any(1000 * inside[n] > limit * chars for n, limit in REPEAT_LIMITS.items()))
    return (n_words, chars, symbols, dup_lines, window, base_failed, not (base_failed or rejected), dup_chars,
            *top.values(), *inside.values())


def repetition_rules(docs: DataFrame, text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """The columns ``kept`` of ``docs`` (default: its first column) and the measures of ``MADE`` for each row.

    Per row, without a shuffle; memory is bounded by one batch and one text. A null or
    empty text has no words and fails the base rule. Repeated rows each get their own
    row. Words are runs without the six ASCII white-space characters, lengths are code
    points. Columns of ``docs`` that bear a measure's name can't be in ``kept``.
    """
    kept = kept or [docs.columns[0]]
    return map_texts(docs, [text_col], kept, MADE, lambda: lambda texts: map(measure, texts))


def keep_passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with all columns as they were."""

    def run(batches):
        for batch in slices(batches):
            verdict = [measure(t)[6] for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield batch.filter(pa.array(verdict, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def failed_share(measured: DataFrame) -> DataFrame:
    """One row: how many documents there are, how many the base rule and all rules reject."""
    return measured.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_base_failed"),
                        F.count_if(~F.col("kept")).alias("n_rejected"))
