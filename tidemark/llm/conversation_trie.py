"""Prefix trie of conversations from double arrays per shard of prefixes, merged globally.

1. Turns are ranked inside their conversation by a global range sort, so a conversation of
   any length is spread over tasks. A turn is its 128-bit digest and the bytes of its text.
2. A path (the turns of a conversation) is cut into segments of SEGMENT turns. The key of
   a node is the exclusive or of the chain hashes of its segments, so a segment's nodes
   can be named once the key of the node before it is known. Equal segments after equal
   nodes are one entry with a count; copies of a conversation therefore cost one entry.
3. Entries are dealt by ranges of (node before, turns), so entries that share a prefix lie
   in one shard, and a frequent prefix is cut over many. Each shard numbers its distinct
   turns densely, packs BASE and CHECK arrays of at most TRIE_TURNS turns, and walks all
   paths through them, adding up counts at the nodes. Nodes that several shards hold
   (upper nodes) are merged by key.
4. Subtree totals need no walk up the levels. The smallest member of a node owns it; what
   a conversation owns is the lower end of its path. With T the bytes of a path and W the
   bytes of the nodes that a conversation owns, the distinct bytes below a node are the
   sum of W over its members, less what its owner owns above it. So all totals are sums
   over members of numbers known per conversation, which a second walk adds up.

Work grows with the turns; no list of members or children is ever gathered. The SHA-256
of members that end at a node is chained over blocks of ids, as the hash must see them in
order; such a block is one row of up to ID_BLOCK ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import mixed
from tidemark.plans.sizing import broadcast_if_small
from tidemark.session import settle

SEGMENT = 1024
TRIE_TURNS = 1 << 16
ID_BLOCK = 4096
#: Nodes with more children hand them their owner by broadcast; there are fewer than nodes / HOT_CHILDREN.
HOT_CHILDREN = 1000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ["k1", "k2"]


def _width(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# Turns

def _local_positions(batches):
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        sizes = np.diff(np.append(first, len(ids)))
        at = np.arange(len(ids)) - np.repeat(first, sizes)
        if last is not None and ids[0] == last:
            at[:sizes[0]] += seen
        last, seen = ids[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(at)],
                                         names=["conv_id", "d1", "d2", "size", "part", "at"])


def ranked_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, d1, d2, size) per turn, (conv_id, n_turns) per conversation).

    ``pos`` counts from 0 by turn, nulls first, equal turns by role and text; null roles and
    texts are empty. Rows without a conversation id are left out. (d1, d2) is the digest of
    role and text, ``size`` the UTF-8 bytes of the text.
    """
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Range bounds hold the start of a text only, which agrees with the order of whole texts.
    bounds = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64),
              F.when(F.length("role") <= 64, F.substring("text", 1, 64)).otherwise("")]
    dealt = rows.repartitionByRange(_width(rows), *bounds).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    facts = dealt.select("conv_id", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "role", "text").alias("d2"),
                         F.octet_length("text").cast("bigint").alias("size"))
    turns = settle(facts.mapInArrow(_local_positions, "conv_id bigint, d1 bigint, d2 bigint, size bigint, part int, at bigint"), "turns")
    counts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation per task goes on from an earlier one.
    offsets = counts.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").select("conv_id", "part", "before")
    ranked = turns.join(broadcast_if_small(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "d1", "d2", "size")
    return ranked, settle(counts.groupBy("conv_id").agg(F.sum("n").alias("n_turns")), "conversations")


def with_shared_heads(turns: DataFrame, members: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first of their group of ids; h = crc32(id) mod ``heads``.

    The turns taken over are as many as that conversation has (none if it does not exist);
    own turns follow from the one after the first h. Conversations may become turnless.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    own = members.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads))).withColumn("base", base)
    sizes = members.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    plan = settle(own.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
                  .withColumn("n_new", F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))), "heads")
    # One row per SEGMENT turns, so that a very long conversation is no hot key.
    blocks = plan.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0), F.expr(f"(n_turns - 1) div {SEGMENT}"))).alias("block"))
    rest = turns.withColumn("block", F.expr(f"pos div {SEGMENT}")).join(blocks, ["conv_id", "block"]).filter("pos >= h") \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d1", "d2", "size")
    first = turns.filter((F.col("pos") < heads - 1) & (F.pmod("conv_id", F.lit(group)) == 0)) \
        .select(F.explode(F.sequence("conv_id", F.col("conv_id") + (group - 1))).alias("conv_id"), "pos", "d1", "d2", "size")
    head = first.join(plan.select("conv_id", "taken"), "conv_id").filter("pos < taken").select("conv_id", "pos", "d1", "d2", "size")
    return head.unionByName(rest), plan.select("conv_id", F.col("n_new").alias("n_turns"))


# Segments and their keys

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def chain_start(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = segment.astype(np.uint64)
    return mixed(s * _A + _B), mixed(s * _B + _A)


def chain_step(h1: np.ndarray, h2: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit chain after one more turn each."""
    a = mixed((h1 ^ d1) * _A + h2)
    return a, mixed((h2 ^ d2) * _B + a)


def _segments(batches):
    """(conv_id, seg, turns sorted by position) to (conv_id, seg, chain, bytes, turns as bytes)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        d1, d2, sizes = (flat.field(i).to_numpy() for i in (1, 2, 3))
        first = np.cumsum(lengths) - lengths
        h1, h2 = chain_start(batch.column(1).to_numpy())
        for r in range(int(lengths.max())):
            on = np.flatnonzero(lengths > r)
            h1[on], h2[on] = chain_step(h1[on], h2[on], d1[first[on] + r].view(np.uint64), d2[first[on] + r].view(np.uint64))
        turns = np.stack([d1, d2, sizes], axis=1).astype("<i8")
        blobs = [turns[a:a + n].tobytes() for a, n in zip(first.tolist(), lengths.tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
             pa.array(np.add.reduceat(sizes, first)), pa.array(blobs, pa.binary())], names=["conv_id", "seg", "h1", "h2", "size", "turns"])


def segments(turns: DataFrame) -> DataFrame:
    listed = turns.groupBy("conv_id", F.expr(f"pos div {SEGMENT}").alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "d1", "d2", "size"))).alias("turns"))
    return listed.mapInArrow(_segments, "conv_id bigint, seg bigint, h1 bigint, h2 bigint, size bigint, turns binary")


def placed(cut: DataFrame) -> DataFrame:
    """(conv_id, seg, h1, h2, s1, s2, before): the key of the node before each segment and the bytes up to it."""
    light = cut.drop("turns")
    later = cut.filter("seg > 0")
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    several = light.join(broadcast_if_small(later.select("conv_id").distinct()), "conv_id", "left_semi")
    after = several.select("conv_id", "seg", "h1", "h2", *(F.expr(f"bit_xor({h})").over(earlier).alias(s) for h, s in (("h1", "s1"), ("h2", "s2"))),
                           F.sum("size").over(earlier).alias("before")).filter("seg > 0")
    zero = F.lit(0).cast("bigint")
    return light.filter("seg = 0").select("conv_id", "seg", "h1", "h2", zero.alias("s1"), zero.alias("s2"), zero.alias("before")).unionByName(after)


# Double arrays

class DoubleArray:
    """BASE and CHECK over dense ids: the child of ``state`` by ``id`` is ``base[state] + id`` where CHECK there is ``state``.

    Slots below ``roots`` are roots. BASE may be negative.
    """

    FREE, ROOT = -1, -2

    def __init__(self, roots: int):
        self.check = np.full(max(64, 2 * roots), self.FREE, np.int64)
        self.check[:roots] = self.ROOT
        self.base = np.zeros(len(self.check), np.int64)

    def reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.check = np.concatenate([self.check, np.full(more, self.FREE, np.int64)])
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])

    def free(self, n: int) -> np.ndarray:
        """The first ``n`` free slots."""
        open_ = np.flatnonzero(self.check == self.FREE)
        if len(open_) < n:
            self.reserve(len(self.check) + n)
            open_ = np.flatnonzero(self.check == self.FREE)
        return open_[:n]

    def place(self, ids: np.ndarray) -> int:
        """The first BASE at which all ``ids`` (ascending) find free slots; past the end if there is none."""
        shape = ids - ids[0]
        open_ = np.flatnonzero(self.check[:max(0, len(self.check) - int(shape[-1]))] == self.FREE)
        for start in range(0, len(open_), 1024):
            some = open_[start:start + 1024]
            fits = (self.check[some[:, None] + shape[None, :]] == self.FREE).all(axis=1) if len(shape) <= 64 else \
                np.array([(self.check[s + shape] == self.FREE).all() for s in some.tolist()])
            if fits.any():
                return int(some[fits.argmax()] - ids[0])
        end = len(self.check)
        self.reserve(end + int(shape[-1]) + 1)
        return int(end - ids[0])

    def add(self, states: np.ndarray, ids: np.ndarray) -> None:
        """Children of states that have none yet, as distinct pairs sorted by state and id."""
        first = np.flatnonzero(np.concatenate(([True], states[1:] != states[:-1])))
        sizes = np.diff(np.append(first, len(states)))
        for a, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            base = self.place(ids[a:a + n])
            self.base[states[a]] = base
            self.check[base + ids[a:a + n]] = states[a]
        lone = first[sizes == 1]
        slots = self.free(len(lone))
        self.base[states[lone]] = slots - ids[lone]
        self.check[slots] = states[lone]

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Children of the states by the ids; -1 where there is none."""
        at = self.base[states] + ids
        inside = (at >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == states), at, -1)


def packed(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, roots: np.ndarray) -> DoubleArray:
    """The double array of paths of dense ids, packed level by level from each path's root."""
    array = DoubleArray(int(roots.max()) + 1)
    state = roots.astype(np.int64)
    for r in range(int(lengths.max())):
        on = np.flatnonzero(lengths > r)
        at, by = state[on], ids[first[on] + r]
        pairs = np.unique(np.stack([at, by], axis=1), axis=0)
        array.add(pairs[:, 0], pairs[:, 1])
        state[on] = array.step(at, by)
    return array


NODES = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, size bigint, above bigint, n bigint, owner bigint, total bigint, own bigint, leaves bigint"
ENTRY = ["seg", "s1", "s2", "before", "n", "owner", "total", "own", "leaves"]


def nodes_of(rows: list[tuple], columns: list[np.ndarray]) -> list[np.ndarray]:
    """All nodes of one trie, as the columns of NODES, from the turns of its entries and their other columns."""
    seg, s1, s2, before, n, owner, total, own, leaves = columns
    turns = [np.frombuffer(x, "<i8").reshape(-1, 3) for x in rows]
    lengths = np.array([len(t) for t in turns])
    first = np.cumsum(lengths) - lengths
    flat = np.concatenate(turns)
    # Dense ids in order of first appearance by level, so that siblings are close.
    level = np.arange(len(flat)) - np.repeat(first, lengths)
    order = np.argsort(level, kind="stable")
    digests = np.ascontiguousarray(flat[order, :2]).view("V16").ravel()
    _, seen, which = np.unique(digests, return_index=True, return_inverse=True)
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(seen)] = np.arange(len(seen))
    ids = np.empty(len(flat), np.int64)
    ids[order] = rank[which]
    _, roots = np.unique(np.stack([seg, s1, s2], axis=1), axis=0, return_inverse=True)
    roots = roots.ravel()
    array = packed(ids, first, lengths, roots)

    slots = len(array.check)
    made = {c: np.zeros(slots, np.int64) for c in ("k1", "k2", "depth", "size", "above", "n", "total", "own", "leaves")}
    least = np.full(slots, np.iinfo(np.int64).max)
    made["k1"][roots], made["k2"][roots] = s1, s2
    state, above = roots.astype(np.int64), before.copy()
    h1, h2 = chain_start(seg)
    for r in range(int(lengths.max())):
        on = np.flatnonzero(lengths > r)
        turn = flat[first[on] + r]
        state[on] = at = array.step(state[on], ids[first[on] + r])
        h1[on], h2[on] = chain_step(h1[on], h2[on], turn[:, 0].view(np.uint64), turn[:, 1].view(np.uint64))
        made["k1"][at], made["k2"][at] = s1[on] ^ h1[on].view(np.int64), s2[on] ^ h2[on].view(np.int64)
        made["depth"][at], made["size"][at], made["above"][at] = seg[on] * SEGMENT + r + 1, turn[:, 2], above[on]
        above[on] += turn[:, 2]
        for name, values in (("n", n), ("total", total), ("own", own), ("leaves", leaves)):
            np.add.at(made[name], at, values[on])
        np.minimum.at(least, at, owner[on])
    real = np.flatnonzero(array.check >= 0)
    parent = array.check[real]
    out = {**{c: x[real] for c, x in made.items()}, "p1": made["k1"][parent], "p2": made["k2"][parent], "owner": least[real]}
    return [out[f.split()[0]] for f in NODES.split(", ")]


def _tries(limit: int):
    names = [f.split()[0] for f in NODES.split(", ")]

    def run(batches):
        held, size = [], 0

        def flush():
            columns = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(len(ENTRY))]
            rows = [x for b in held for x in b.column(len(ENTRY)).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in nodes_of(rows, columns)], names=names)

        for batch in batches:
            # A turn takes 24 bytes.
            ends = np.cumsum(pc.binary_length(batch.column(len(ENTRY))).to_numpy()) // 24
            start = 0
            while start < batch.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = min(batch.num_rows, int(np.searchsorted(ends, done + limit - size)) + 1)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - done
                start = stop
                if size >= limit:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def walked(entries: DataFrame, limit: int) -> DataFrame:
    """Nodes of the tries of all shards; upper nodes once per shard that holds them."""
    start = F.substring("turns", 1, 24 * 128)
    dealt = entries.repartitionByRange(_width(entries), "seg", "s1", "s2", start).sortWithinPartitions("seg", "s1", "s2", "turns")
    return dealt.select(*ENTRY, "turns").mapInArrow(_tries(limit), NODES)


# Members that end at a node

def _id_blocks(batches):
    at, ids, first = None, [], None

    def row():
        return [at[0]], [at[1]], [first], [",".join(map(str, ids))]

    for batch in batches:
        out = ([], [], [], [])
        for k1, k2, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (k1, k2) != at or len(ids) == ID_BLOCK:
                if ids:
                    for o, x in zip(out, row()):
                        o += x
                at, ids, first = (k1, k2), [], conv
            ids.append(conv)
        yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], names=["k1", "k2", "first", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in row()[:3]), pa.array(row()[3], pa.string())],
                                         names=["k1", "k2", "first", "ids"])


def _chained(batches):
    at, state = None, None
    for batch in batches:
        out = ([], [], [])
        for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (k1, k2) != at:
                if at is not None:
                    for o, x in zip(out, (*at, state.hexdigest())):
                        o.append(x)
                at, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                         names=["k1", "k2", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])],
                                         names=["k1", "k2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from (k1, k2, conv_id): the digest of the ids in ascending order, joined by commas."""
    ordered = ends.select("k1", "k2", "conv_id").repartitionByRange(_width(ends), "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    blocks = ordered.mapInArrow(_id_blocks, "k1 bigint, k2 bigint, first bigint, ids string")
    return blocks.repartition(_width(ends), "k1", "k2").sortWithinPartitions("k1", "k2", "first") \
        .mapInArrow(_chained, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, trie_turns: int = TRIE_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    ``turns`` (conv_id, pos, d1, d2, size) holds positions from 0 without gaps, ``members``
    (conv_id) all conversations once, turnless ones included; both from ``ranked_turns``.
    ``conv_id`` is a node's smallest member, and (conv_id, depth) is unique. The root has
    depth 0 and no parent. No conversation: no rows, the root included.
    """
    cut = settle(segments(turns), "segments")
    paths = cut.groupBy("conv_id").agg(F.expr("bit_xor(h1)").alias("k1"), F.expr("bit_xor(h2)").alias("k2"), F.sum("size").alias("total"))
    zero = F.lit(0)
    ends = settle(members.select("conv_id").join(paths, "conv_id", "left").select(
        "conv_id", *(F.coalesce(c, zero).cast("bigint").alias(c) for c in ("k1", "k2", "total"))), "ends")
    steps = settle(placed(cut).join(ends.select("conv_id", "total"), "conv_id"), "steps")
    keys = ["seg", "s1", "s2", "h1", "h2"]
    entries = steps.join(cut.select("conv_id", "seg", "turns"), ["conv_id", "seg"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"), F.sum("total").alias("total"), F.min("before").alias("before"),
        F.first("turns").alias("turns"))
    entries = settle(entries, "entries")

    # First walk: members and owner of every node.
    found = walked(entries.withColumn("own", F.lit(0).cast("bigint")).withColumn("leaves", F.lit(0).cast("bigint")), trie_turns)
    merged = settle(found.groupBy(*NODE).agg(*(F.min(c).alias(c) for c in ("p1", "p2", "depth", "size", "above", "owner")),
                                             *(F.sum(c).alias(c) for c in ("n", "total"))), "nodes")
    children = merged.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(merged.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero).cast("bigint")), "children")

    # What each conversation owns; second walk: sums over members.
    owned = settle(nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("size").alias("own"), F.count_if(F.col("n_children") == 0).alias("leaves")), "owned")
    weights = steps.join(owned, "conv_id")
    sums = weights.groupBy(*keys).agg(F.sum("own").alias("own"), F.sum("leaves").alias("leaves"))
    weighed = settle(entries.join(sums, keys, "left").fillna(0, ["own", "leaves"]), "weighed")
    below = walked(weighed, trie_turns).groupBy(*NODE).agg(F.sum("own").alias("own"), F.sum("leaves").alias("n_leaves"))

    # Per owner and segment, so that an owner of a very long path is no hot key.
    starts = weights.select(F.col("conv_id").alias("owner"), "seg", (F.col("total") - F.col("own")).alias("start"))
    known = nodes.withColumn("seg", F.expr(f"(depth - 1) div {SEGMENT}")).join(below, NODE).join(starts, ["owner", "seg"])
    shas = settle(end_digests(ends), "digests")
    facts = known.join(shas, NODE, "left").select(
        *NODE, "p1", "p2", "depth", F.col("owner").alias("conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves",
        # Bytes with members counted, less distinct bytes: those of all members' own parts, but for what the owner owns above.
        (F.col("total") - F.col("n") * F.col("above") - (F.col("own") - F.greatest(F.col("above") - F.col("start"), zero))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))

    # The parent's owner: frequent parents by broadcast, the others by shuffle.
    parents = nodes.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_conv_id"), "n_children")
    hot = broadcast_if_small(parents.filter(F.col("n_children") > HOT_CHILDREN).drop("n_children"))
    deep = facts.filter("depth > 1").join(hot, ["p1", "p2"], "left")
    rest = deep.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(
        parents.filter(F.col("n_children") <= HOT_CHILDREN).drop("n_children"), ["p1", "p2"])
    top = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.sum("total").alias("total")).first()
    depth_one = facts.filter("depth = 1").withColumn("parent_conv_id", F.lit(top.conv_id).cast("bigint"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = deep.filter("parent_conv_id IS NOT NULL").unionByName(rest).unionByName(depth_one).select(*columns)
    if top.n == 0:
        return every
    whole = owned.agg(F.sum("own").alias("own"), F.sum("leaves").alias("leaves")).first()
    n_top = nodes.filter("depth = 1").count()
    sha = shas.filter("k1 = 0 AND k2 = 0").select("ends_sha256").first()
    root = [F.lit(top.conv_id), F.lit(0), F.lit(None), F.lit(top.n), F.lit(n_top), F.lit(whole.leaves or 1), F.lit(top.total - (whole.own or 0))]
    one = turns.sparkSession.range(1).select(*(c.cast("bigint").alias(n) for c, n in zip(root, columns)),
                                             F.lit(sha[0] if sha else EMPTY_SHA).alias("ends_sha256"))
    return every.unionByName(one)
