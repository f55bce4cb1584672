"""N-gram Jaccard self-join by a MinHash LSH forest reduced to one depth, with exact verification.

1. Each text becomes its set of word n-gram hashes and a signature of TREES rows of
   minimum hashes. Texts with the same set are one class; all later work is on one
   representative per class.
2. Two texts are candidates when they share a prefix in some tree. The prefix has one
   length for all texts, set before the data is read: the longest at which a pair exactly
   at the threshold is found with the target recall, 1 - (1 - s^depth)^trees. Where one
   hash is still too long, trees are added. No trie is built and no prefix is shortened
   per match: the minima of a prefix are hashed to one key, which is banding.
3. A candidate set is a run of equal prefixes in a tree. Runs of one are dropped, and
   runs with the same members as a run of an earlier tree.
4. Each run is verified exactly, long runs in pairs of blocks, so no task holds more
   than two blocks. A pair is counted in the first tree in which it meets. A block gives
   link counts and the edges of a spanning forest, never a row per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import WORD_BYTES, hashed_words, mixed, slices
from tidemark.plans.components import connected_components
from tidemark.plans.sizing import broadcast_if_small, keep_parallel
from tidemark.session import settle

SIZE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
TARGET = 0.9995
BLOCK = 384
COLUMNS = 8192
SEED = 7
BASE = np.uint64(0x9E3779B97F4A7C15)


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of similarity ``threshold`` meets in some tree with probability ``target``."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def forest_shape(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> tuple[int, int]:
    """(trees, prefix length) that meet the target: more trees than asked for when even prefixes of one hash miss it."""
    if not 0 < threshold <= 1 or not 0 <= target < 1:
        raise ValueError("threshold must be above 0 and at most 1, target at least 0 and below 1")
    depth = prefix_depth(threshold, target, trees, depth)
    while 1 - (1 - threshold ** depth) ** trees < target:
        trees += 1
    return trees, depth


def gram_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of a text's word n-grams. A text of fewer words than ``size`` is one n-gram of all its words."""
    ids = hashed_words(text, WORD_BYTES)
    if not len(ids):
        return ids
    n = min(size, len(ids))
    rolled = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        rolled = rolled * BASE + ids[j:len(ids) - n + 1 + j]
    return np.unique(mixed(rolled))


def signer(trees: int, depth: int):
    """A function from a set to its ``trees`` prefix hashes of ``depth`` minima each."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def sign(members: np.ndarray) -> np.ndarray:
        least = np.full(trees * depth, np.iinfo(np.uint64).max)
        for start in range(0, len(members), 2048):
            part = members[start:start + 2048]
            values = factors[:, None] * part[None, :] + shifts[:, None]
            least = np.minimum(least, (values ^ (values >> np.uint64(32))).min(axis=1))
        rows = mixed(least).reshape(trees, depth)
        prefix = np.zeros(trees, np.uint64)
        for j in range(depth):
            prefix = prefix * BASE + rows[:, j]
        return mixed(prefix)

    return sign


def signatures(rows: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """(id, text_hash, class_key, prefixes) per row of (id, text_hash, text): the set's digest and the prefix hashes, as bytes. No words: null key."""
    schema = T.StructType([rows.schema["id"], rows.schema["text_hash"], T.StructField("class_key", T.BinaryType()),
                           T.StructField("prefixes", T.BinaryType())])

    def run(batches):
        sign = signer(trees, depth)
        for batch in slices(batches):
            keys, prefixes = [], []
            for text in batch.column(2).to_pylist():
                members = gram_set(text, size)
                keys.append(xxhash.xxh3_128_digest(members.astype("<u8").tobytes()) if len(members) else None)
                prefixes.append(sign(members).astype("<u8").tobytes() if len(members) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(prefixes, pa.binary())],
                                             names=["id", "text_hash", "class_key", "prefixes"])

    return rows.select("id", "text_hash", "text").mapInArrow(run, schema)


def gram_sets(rows: DataFrame, size: int) -> DataFrame:
    """The rows with their text replaced by its sorted set of n-gram hashes, ``grams``."""
    rest = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for batch in slices(batches):
            grams = [gram_set(t, size).astype("<u8").tobytes() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in rest), pa.array(grams, pa.binary())],
                                             names=[*(f.name for f in rest), "grams"])

    return rows.mapInArrow(run, T.StructType([*rest, T.StructField("grams", T.BinaryType())]))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the n-grams that both sides have."""
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    rows_l = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rows_r = np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(flat_l, flat_r)
    at_l, at_r = np.searchsorted(shared, flat_l), np.searchsorted(shared, flat_r)
    in_l = at_l < len(shared)
    in_l[in_l] = shared[at_l[in_l]] == flat_l[in_l]
    in_r = at_r < len(shared)
    in_r[in_r] = shared[at_r[in_r]] == flat_r[in_r]
    out = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - start)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        here = in_l & (at_l >= start) & (at_l < start + width)
        a[rows_l[here], at_l[here] - start] = 1
        here = in_r & (at_r >= start) & (at_r < start + width)
        b[rows_r[here], at_r[here] - start] = 1
        out += a @ b.T
    return np.rint(out).astype(np.int64)


def links(tree: int, ids: np.ndarray, sizes: np.ndarray, grams: list[np.ndarray], prefixes: np.ndarray, first: np.ndarray | None,
          threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs that are similar and meet first in ``tree``.

    ``first`` marks the rows of the first of two blocks: then only pairs across count.
    """
    n = len(ids)
    rows = np.flatnonzero(first) if first is not None else np.arange(n)
    cols = np.flatnonzero(~first) if first is not None else rows
    wanted = np.ones((len(rows), len(cols)), bool)
    if first is None:
        wanted = (ids[rows][:, None] < ids[cols][None, :]).astype(bool)
    for t in range(tree):
        wanted &= prefixes[rows, t][:, None] != prefixes[cols, t][None, :]
    small, large = np.minimum(sizes[rows][:, None], sizes[cols][None, :]), np.maximum(sizes[rows][:, None], sizes[cols][None, :])
    wanted &= small >= threshold * large - 1e-9
    out = np.zeros((n, n), bool)
    some_r, some_c = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if len(some_r) == 0:
        return out
    common = _common([grams[rows[i]] for i in some_r], [grams[cols[j]] for j in some_c])
    both = sizes[rows[some_r]][:, None] + sizes[cols[some_c]][None, :] - common
    # Exact in integers up to the threshold's own representation.
    similar = wanted[np.ix_(some_r, some_c)] & (common >= threshold * both - 1e-9)
    out[np.ix_(rows[some_r], cols[some_c])] = similar
    return out


def _roots(pairs: np.ndarray) -> np.ndarray:
    """For each position the lowest position it is linked to, directly or through others."""
    either = pairs | pairs.T
    root = np.arange(len(pairs))
    while True:
        lowest = np.where(either, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, lowest)
        new = new[new]
        if (new == root).all():
            return root
        root = new


VERIFIED = "id binary, links bigint, docs bigint, root binary"
KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.binary()]


def _verify(trees: int, threshold: float):
    """Map over rows sorted by (tree, prefix, b0, b1): gathers one run, or one pair of its blocks, at a time."""

    def block(key, rows) -> tuple[list, ...]:
        rows.sort(key=lambda r: r[0])
        ids = np.array([r[0] for r in rows], object)
        weight = np.array([r[1] for r in rows])
        grams = [np.frombuffer(r[2], "<u8") for r in rows]
        prefixes = np.stack([np.frombuffer(r[3], "<u8") for r in rows])
        sizes = np.array([len(g) for g in grams])
        first = None if key[2] == key[3] else np.array([r[4] for r in rows]) == key[2]
        pairs = links(key[0], ids, sizes, grams, prefixes, first, threshold)
        both = pairs | pairs.T
        touched = both.any(axis=1)
        return (ids[touched].tolist(), both.sum(axis=1)[touched].tolist(), (both @ weight)[touched].tolist(),
                ids[_roots(pairs)[touched]].tolist())

    def run(batches):
        at, rows = None, []
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            columns = [batch.column(i).to_pylist() for i in range(4)]
            rest = [batch.column(i) for i in range(4, 9)]
            for i, key in enumerate(zip(*columns)):
                if key != at:
                    if len(rows) > 1:
                        for o, x in zip(out, block(at, rows)):
                            o.extend(x)
                    at, rows = key, []
                rows.append(tuple(c[i].as_py() for c in rest))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, KINDS)], names=["id", "links", "docs", "root"])
        if len(rows) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(block(at, rows), KINDS)], names=["id", "links", "docs", "root"])

    return run


def _classed_rows(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float, target: float, trees: int, depth: int,
                  block: int) -> DataFrame:
    """(id, text_hash, class_key, class_id, first_hash, text_class, n_docs, n_text_links, n_links) per row; the row of class_id and first_hash stands for the class.

    Texts are known by the digest of their set throughout, as ids may repeat.
    """
    trees, depth = forest_shape(threshold, target, trees, depth)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = settle(signatures(rows, size, trees, depth), "forest")
    known = signed.filter("id IS NOT NULL AND class_key IS NOT NULL")
    classes = settle(known.groupBy("class_key").agg(F.min(F.struct("id", "text_hash")).alias("r"), F.count(F.lit(1)).alias("n_docs"),
                                                    F.min("prefixes").alias("prefixes"))
                     .select("class_key", F.col("r.id").alias("rep"), "r.text_hash", "n_docs", "prefixes"), "classes")

    # One row per class and tree, without the sets.
    entries = classes.select("class_key", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("prefixes", t * 8 + 1, F.lit(8)))).alias("tree", "prefix"))
    mark = F.xxhash64("class_key")
    runs = entries.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("members"), F.min(mark).alias("lowest"),
                                                 F.sum(mark.cast("decimal(38,0)")).alias("print")).filter("members > 1")
    # Runs with the same members in several trees: the first tree verifies all their pairs.
    runs = settle(runs.groupBy("members", "lowest", "print").agg(F.min(F.struct("tree", "prefix")).alias("run"))
                  .select("run.tree", "run.prefix", "members"), "runs")
    parts = F.ceil(F.col("members") / block).cast("int")
    member = (entries.join(runs, ["tree", "prefix"])
              .withColumn("block", F.pmod(F.xxhash64("class_key", "prefix"), parts).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
              .select("class_key", "tree", "prefix", "block", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1")))
    # Only texts with a candidate are turned into sets. Their ids are broadcast while counted small; else all texts are shuffled once.
    needed = classes.join(member.select("class_key").distinct(), "class_key", "left_semi").select(
        "class_key", "rep", F.col("text_hash").alias("h"), "n_docs", "prefixes")
    texts = rows.filter("id IS NOT NULL").join(broadcast_if_small(needed), F.expr("id = rep AND text_hash = h")) \
        .select("class_key", "n_docs", "prefixes", "text")
    sets = gram_sets(texts, size).dropDuplicates(["class_key"])  # rows may repeat
    run_keys = ["tree", "prefix", "b0", "b1"]
    loaded = member.join(sets, "class_key").select(*run_keys, F.col("class_key").alias("id"), "n_docs", "grams", "prefixes", "block")
    dealt = keep_parallel(loaded, *run_keys).sortWithinPartitions(*run_keys)
    found = settle(dealt.mapInArrow(_verify(trees, threshold), VERIFIED), "links")

    counts = found.groupBy(F.col("id").alias("class_key")).agg(F.sum("links").alias("n_text_links"), F.sum("docs").alias("linked_docs"))
    groups = settle(connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst"))), "groups")
    named = groups.join(classes.select(F.col("class_key").alias("node"), "rep", "text_hash"), "node")
    heads = named.groupBy("component").agg(F.min(F.struct("rep", "text_hash")).alias("head"))
    linked = groups.join(heads, "component").select(F.col("node").alias("class_key"), "head")
    classed = (classes.select("class_key", "rep", "text_hash", "n_docs").join(counts, "class_key", "left").join(linked, "class_key", "left")
               .select(F.col("class_key").alias("k"), F.coalesce("head.rep", "rep").alias("class_id"),
                       F.coalesce("head.text_hash", "text_hash").alias("first_hash"), F.col("rep").alias("text_class"), "n_docs",
                       F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
                       (F.coalesce("linked_docs", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")))
    return signed.select("id", "text_hash", "class_key").join(classed, F.col("class_key") == F.col("k"), "left").drop("k")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD,
                 target: float = TARGET, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(id_col, class_id, text_class, n_copies, n_text_links, n_links): one row per row of ``docs``.

    ``text_class``: lowest id among the rows with the same n-gram set. ``class_id``: lowest
    id reachable over links (Jaccard similarity of at least ``threshold``). ``n_copies``:
    rows of the text class; ``n_text_links``: other text classes similar to it; ``n_links``:
    other rows similar to it, copies included. Ids are integers; a row with a null id has
    null classes and null counts. A null text or one without words has no n-gram: it links
    to nothing and is a class of its own. Repeated rows (same id and text) are copies of each
    other; rows that share an id but not the text are separate texts, linked by their texts only.
    """
    out = _classed_rows(docs, id_col, text_col, size, threshold, target, trees, depth, block)
    alone = F.col("id").isNotNull() & F.col("class_key").isNull()
    known_id = F.col("id").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).when(known_id, F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).when(known_id, F.col("text_class")).alias("text_class"),
        F.when(alone, F.lit(1)).when(known_id, F.col("n_docs")).cast("bigint").alias("n_copies"),
        F.when(alone, F.lit(0)).when(known_id, F.col("n_text_links")).cast("bigint").alias("n_text_links"),
        F.when(alone, F.lit(0)).when(known_id, F.col("n_links")).cast("bigint").alias("n_links"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD,
               target: float = TARGET, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` per class: the one with the lowest id (of equal ids the lowest text hash); all columns as they were.

    Rows with a null id stay, and so does each row without words that has a text hash of its own. Of
    rows that repeat both id and text, one stays.
    """
    joined = _classed_rows(docs, id_col, text_col, size, threshold, target, trees, depth, block).filter("id IS NOT NULL")
    own, text_hash = F.col(id_col).cast("bigint"), F.xxhash64(text_col)
    # The columns made here are renamed past any name of docs.
    made, hashed = ("kept_" + max(docs.columns, key=len) + x for x in ("", "_"))
    first = settle(joined.filter("class_key IS NULL OR id = class_id AND text_hash = first_hash").groupBy(
        F.col("id").alias(made), F.col("text_hash").alias(hashed)).agg(F.count(F.lit(1)).alias("n")), "first")
    same = (own == F.col(made)) & (text_hash == F.col(hashed))
    once = docs.join(broadcast_if_small(first.filter("n = 1").select(made, hashed)), same, "left_semi")
    repeated = docs.join(broadcast_if_small(first.filter("n > 1").select(made, hashed)), same, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(repeated).unionByName(docs.filter(F.col(id_col).isNull()))
