"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

1. A text becomes its set of hashed word shingles. Equal sets are one class, and the rest
   works on one text per class. The 64-bit hashes stand for the shingles.
2. The signature needs two permutations of the 64-bit numbers. The first, sigma, breaks up
   the structure of the set; the second, pi, is used again and again, each time shifted
   circularly by one: coordinate k is the least pi(sigma(x) + k) over the set. Bands of
   ROWS coordinates are hashed to one key each. At the threshold of 0.85 a pair shares no
   band with probability (1 - 0.85^6)^30, less than one in a million.
3. Texts with a band in common are a bucket; buckets with the same members count once.
   First every member is compared with one leader per bucket, a different one in each, then
   with the member that has most links so far. Large groups of copies are joined so, by a
   number of comparisons that grows with the group. Then only members of one bucket that
   are still in different components are compared, in pairs of blocks: all of them,
   unless their set sizes rule a link out.
4. Links are confirmed on the full sets, and components are closed over them. A pair that
   shares a bucket is therefore either compared or already connected.

Blocks have about BLOCK texts, a task holds two at a time, and no row is made per pair.
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
THRESHOLD = 85  # percent
BANDS = 30
ROWS = 6
BLOCK = 256
#: Classes of more copies hand them their component by broadcast.
HOT_COPIES = 1000
#: Shared shingles that are compared at once.
COLUMNS = 4096
BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles, A-Z in lower case. Fewer words than ``size`` are one shingle, no words none."""
    # bytes.lower() changes A-Z only.
    words = hashed_words((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), WORD_BYTES)
    if not len(words):
        return words
    n = min(size, len(words))
    rolled = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        rolled = rolled * BASE + words[j:len(words) - n + 1 + j]
    return np.unique(mixed(rolled))


def sigma(x: np.ndarray) -> np.ndarray:
    return mixed(x * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))


def pi(x: np.ndarray) -> np.ndarray:
    """A permutation: odd factors and shifted sums can be undone."""
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def signature(members: np.ndarray, coordinates: int) -> np.ndarray:
    """The least pi(sigma(x) + k) over the set, for k from 0."""
    least = np.full(coordinates, np.iinfo(np.uint64).max)
    shifts = np.arange(coordinates, dtype=np.uint64)[:, None]
    start = sigma(members)
    for at in range(0, len(start), 512):
        least = np.minimum(least, pi(start[None, at:at + 512] + shifts).min(axis=1))
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        keys = mixed(keys * BASE + least.reshape(bands, rows)[:, j])
    return keys


def _signed(rows: DataFrame, size: int, bands: int, per: int) -> DataFrame:
    schema = T.StructType([rows.schema["id"], rows.schema["text_hash"], T.StructField("class_key", T.BinaryType()),
                           T.StructField("n_shingles", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in slices(batches):
            keys, sizes, bands_of = [], [], []
            for text in batch.column(2).to_pylist():
                members = shingles(text, size)
                sizes.append(len(members))
                keys.append(xxhash.xxh3_128_digest(members.astype("<u8").tobytes()) if len(members) else None)
                bands_of.append(band_keys(signature(members, bands * per), bands, per).view(np.int64) if len(members) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands_of, pa.list_(pa.int64()))],
                names=["id", "text_hash", "class_key", "n_shingles", "keys"])

    return rows.select("id", "text_hash", "text").mapInArrow(run, schema)


def _sets(rows: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            sets = [shingles(t, size).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["class_key", "members"])

    return rows.select("class_key", "text").mapInArrow(run, "class_key binary, members binary")


# Verification

def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a left with a right set, by products of 0/1 matrices over shingles that both sides have."""
    flat, both = [np.concatenate(x) for x in (left, right)], []
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    common = np.intersect1d(*flat)
    for x, of in zip(flat, owner):
        at = np.searchsorted(common, x)
        here = np.flatnonzero(at < len(common))
        here = here[common[at[here]] == x[here]]
        order = np.argsort(at[here], kind="stable")
        both.append((at[here][order], of[here][order]))
    out = np.zeros((len(left), len(right)))
    for start in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - start)
        tables = []
        for (at, of), n in zip(both, (len(left), len(right))):
            a, b = np.searchsorted(at, [start, start + width])
            table = np.zeros((n, width), np.float32)
            table[of[a:b], at[a:b] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return np.rint(out).astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray, percent: int) -> np.ndarray:
    """The wanted pairs with 100 * intersection >= percent * union, decided in integers."""
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    wanted = wanted & (100 * np.minimum(a[:, None], b[None, :]) >= percent * np.maximum(a[:, None], b[None, :]))
    rows, cols = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    out = np.zeros_like(wanted)
    if len(rows):
        shared = _shared([left[i] for i in rows], [right[j] for j in cols])
        union = a[rows][:, None] + b[cols][None, :] - shared
        out[np.ix_(rows, cols)] = wanted[np.ix_(rows, cols)] & (100 * shared >= percent * union)
    return out


def _grouped(batches, keys: int):
    """(key, rows) for each run of equal values in the first ``keys`` columns; rows hold the other columns."""
    at, rows = None, []
    for batch in batches:
        key_lists = [batch.column(i).to_pylist() for i in range(keys)]
        rest = [batch.column(i) for i in range(keys, batch.num_columns)]
        for i, key in enumerate(zip(*key_lists)):
            if key != at:
                if rows:
                    yield at, rows
                at, rows = key, []
            rows.append(tuple(c[i].as_py() for c in rest))
    if rows:
        yield at, rows


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["src", "dst"])


EDGES = "src binary, dst binary"


def _stars(percent: int):
    """Rows (leader, parts, part, is_leader, class_key, members), a group's leader first: members linked to the leader, one at a time."""

    def run(batches):
        at, lead = None, None
        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for i, (key, first) in enumerate(zip(keys, batch.column(3).to_pylist())):
                if first:
                    at, lead = key, np.frombuffer(batch.column(5)[i].as_py(), "<u8")
                elif key == at:
                    members = np.frombuffer(batch.column(5)[i].as_py(), "<u8")
                    if 100 * min(len(lead), len(members)) >= percent * max(len(lead), len(members)):
                        small, large = sorted((lead, members), key=len)
                        where = np.searchsorted(large, small)
                        where[where == len(large)] = 0
                        shared = int((large[where] == small).sum())
                        if 100 * shared >= percent * (len(lead) + len(members) - shared):
                            found.append((key[0], batch.column(4)[i].as_py()))
            yield _edges(found)

    return run


def _spanning(pairs: np.ndarray) -> list[tuple[int, int]]:
    """One edge per row and per column that has links, enough to connect what the links connect."""
    out = []
    seen_r, seen_c = np.zeros(pairs.shape[0], bool), np.zeros(pairs.shape[1], bool)
    for start in range(pairs.shape[0]):
        if seen_r[start] or not pairs[start].any():
            continue
        seen_r[start], todo = True, [(0, start)]
        while todo:
            side, at = todo.pop()
            new = np.flatnonzero(pairs[at] & ~seen_c) if side == 0 else np.flatnonzero(pairs[:, at] & ~seen_r)
            (seen_c if side == 0 else seen_r)[new] = True
            out += [(at, j) if side == 0 else (j, at) for j in new.tolist()]
            todo += [(1 - side, j) for j in new.tolist()]
    return out


def _blocks(percent: int):
    """Rows (bucket, pair, side, class_key, group, members): links between the two blocks of a pair, across groups."""

    def run(batches):
        for _, rows in _grouped(batches, 2):
            left, right = ([r for r in rows if r[0] == side] for side in (0, 1))
            if left and right:
                groups = np.array([r[2] for r in left], object)[:, None] != np.array([r[2] for r in right], object)[None, :]
                yes = linked(*([np.frombuffer(r[3], "<u8") for r in x] for x in (left, right)), groups.astype(bool), percent)
                yield _edges([(left[i][1], right[j][1]) for i, j in _spanning(yes)])

    return run


# Candidates

def _starred(led: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between leaders and members; ``led`` has (leader, class_key, n), n the members of their bucket. A large bucket is dealt in parts."""
    pairs = led.filter("leader <> class_key").groupBy("leader", "class_key").agg(F.max("n").alias("n")).select(
        "leader", F.ceil(F.col("n") / block).cast("int").alias("parts"), "class_key")
    pairs = settle(pairs.withColumn("part", F.pmod(F.xxhash64("class_key"), F.col("parts")).cast("int")), "stars")
    group = ["leader", "parts", "part"]
    heads = pairs.select(*group).distinct().select(*group, F.lit(True).alias("is_leader"), F.col("leader").alias("class_key"))
    both = pairs.select(*group, F.lit(False).alias("is_leader"), "class_key").unionByName(heads)
    loaded = both.join(sets, "class_key").select(*group, "is_leader", "class_key", "members")
    dealt = keep_parallel(loaded, *group).sortWithinPartitions(*group, F.col("is_leader").desc())
    return settle(dealt.mapInArrow(_stars(percent), EDGES), "links")


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with their component, ``group``, for buckets whose members are in several."""
    groups = connected_components(links)
    grouped = settle(members.join(groups, F.col("class_key") == F.col("node"), "left").select(
        *members.columns, F.coalesce("component", "class_key").alias("group")), "grouped")
    several = grouped.groupBy("band_key").agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a <> b").select("band_key")
    return settle(grouped.join(broadcast_if_small(several), "band_key", "left_semi"), "apart")


def _across(apart: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between members of a bucket in different groups.

    Members are dealt into layers of set sizes; linked texts are in one layer or in
    neighbours. A group that fills a block in its layer has units of its own, which are
    not compared with each other; the other members share a unit.
    """
    layer = F.floor(F.log("n_shingles") / float(1.0001 * np.log(100 / percent))).cast("int") if percent < 100 else F.col("n_shingles")
    rows = apart.select("band_key", "class_key", "group", layer.alias("layer"))
    large = rows.groupBy("band_key", "layer", "group").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block).drop("m")
    rows = rows.join(broadcast_if_small(large.withColumn("large", F.lit(True))), ["band_key", "layer", "group"], "left")
    rows = settle(rows.withColumn("unit", F.when(F.col("large"), F.col("group")).otherwise(F.lit(b""))).drop("large"), "units")
    units = rows.groupBy("band_key", "layer", "unit").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    units = settle(units, "units")
    dealt = rows.join(broadcast_if_small(units), ["band_key", "layer", "unit"]).select(
        "band_key", "layer", "unit", F.pmod(F.xxhash64("class_key"), F.col("parts")).cast("int").alias("part"), "class_key", "group")
    a, b = (units.select("band_key", *(F.col(c).alias(f"{c}_{side}") for c in ("layer", "unit", "parts"))) for side in "ab")
    pairs = a.join(b, "band_key").filter("(layer_b = layer_a AND unit_a <= unit_b OR layer_b = layer_a + 1) AND NOT (unit_a = unit_b AND length(unit_a) > 0)")
    pairs = pairs.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn(
        "part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    pairs = settle(pairs.filter("layer_a <> layer_b OR unit_a <> unit_b OR part_a <= part_b").withColumn(
        "pair", F.xxhash64("layer_a", "unit_a", "part_a", "layer_b", "unit_b", "part_b")), "pairs")
    sides = []
    for i, side in enumerate("ab"):
        at = pairs.select("band_key", "pair", F.lit(i).alias("side"), *(F.col(f"{c}_{side}").alias(c) for c in ("layer", "unit", "part")))
        sides.append(dealt.join(at, ["band_key", "layer", "unit", "part"]).select("band_key", "pair", "side", "class_key", "group"))
    loaded = sides[0].unionByName(sides[1]).join(sets, "class_key").select("band_key", "pair", "side", "class_key", "group", "members")
    spread = keep_parallel(loaded, "band_key", "pair").sortWithinPartitions("band_key", "pair")
    return settle(spread.mapInArrow(_blocks(percent), EDGES), "links")


def _classed(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(class_key, component_id, n_docs): the lowest id of the component of each class."""
    closed = settle(connected_components(links), "closed")
    lowest = closed.join(classes.select(F.col("class_key").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    moved = closed.join(lowest, "component").select(F.col("node").alias("class_key"), "component_id")
    return settle(classes.select("class_key", "rep", "n_docs").join(moved, "class_key", "left").select(
        "class_key", F.coalesce("component_id", "rep").alias("component_id"), "n_docs"), "classed")


def component_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = THRESHOLD,
                   bands: int = BANDS, per_band: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id, text_hash, class_key, n_shingles, component_id) per row, as ``near_duplicates`` describes."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = settle(_signed(rows, size, bands, per_band), "signed")
    classes = settle(signed.filter("id IS NOT NULL AND class_key IS NOT NULL").groupBy("class_key").agg(
        F.min(F.struct("id", "text_hash")).alias("r"), F.count(F.lit(1)).alias("n_docs"), F.min("n_shingles").alias("n_shingles"),
        F.min("keys").alias("keys"))
        .select("class_key", F.col("r.id").alias("rep"), "r.text_hash", "n_docs", "n_shingles", "keys"), "classes")

    entries = classes.select("class_key", "n_shingles", F.explode("keys").alias("band_key"))
    mark = F.xxhash64("class_key", "band_key")
    buckets = entries.groupBy("band_key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("class_key")).alias("print"), F.bit_xor(F.xxhash64(F.lit(1), "class_key")).alias("second"),
        F.min(mark).alias("lowest")).filter("n > 1")
    # Of buckets with the same members one stays.
    buckets = buckets.groupBy("n", "print", "second").agg(F.min(F.struct("band_key", "lowest")).alias("b")).select("b.band_key", "b.lowest", "n")
    members = settle(entries.join(broadcast_if_small(buckets), "band_key").select(
        "band_key", "class_key", "n_shingles", "n", (mark == F.col("lowest")).alias("leads")), "members")
    wanted = classes.join(members.select("class_key").distinct(), "class_key", "left_semi").select("class_key", "rep", F.col("text_hash").alias("h"))
    texts = rows.filter("id IS NOT NULL").join(broadcast_if_small(wanted), F.expr("id = rep AND text_hash = h")).select("class_key", "text")
    sets = settle(_sets(texts.dropDuplicates(["class_key"]), size), "sets")

    leaders = members.filter("leads").select("band_key", F.col("class_key").alias("leader"))
    links = _starred(members.join(broadcast_if_small(leaders), "band_key"), sets, percent, block)
    members = _apart(members, links)

    degrees = links.select(F.col("src").alias("class_key")).unionByName(links.select(F.col("dst").alias("class_key"))).groupBy("class_key").agg(
        F.count(F.lit(1)).alias("degree"))
    ranked = members.join(degrees, "class_key", "left")
    best = ranked.groupBy("band_key").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "class_key", "group")).alias("m")).select(
        "band_key", F.col("m.class_key").alias("leader"), F.col("m.group").alias("home"))
    led = members.join(broadcast_if_small(best), "band_key").filter(F.col("group") != F.col("home"))
    links = links.unionByName(_starred(led, sets, percent, block))
    members = _apart(members.drop("group"), links)
    links = settle(links.unionByName(_across(members, sets, percent, block)), "links")

    classed = _classed(classes, links)
    # Large classes by broadcast, there are fewer than rows / HOT_COPIES; the others by shuffle.
    columns = ["id", "text_hash", "class_key", "n_shingles"]
    hot = broadcast_if_small(classed.filter(F.col("n_docs") > HOT_COPIES).drop("n_docs"))
    tried = signed.filter("id IS NOT NULL").select(*columns).join(hot, "class_key", "left").select(*columns, "component_id")
    known = tried.filter("component_id IS NOT NULL")
    rest = tried.filter("component_id IS NULL").drop("component_id").join(
        classed.filter(F.col("n_docs") <= HOT_COPIES).drop("n_docs"), "class_key", "left").select(*columns, F.coalesce("component_id", "id").alias("component_id"))
    lost = signed.filter("id IS NULL").select(*columns, F.lit(None).cast("bigint").alias("component_id"))
    return known.unionByName(rest).unionByName(lost)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = THRESHOLD,
                    bands: int = BANDS, per_band: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row per row of ``docs``.

    ``n_shingles`` is the size of the text's set, ``component_id`` the lowest id reachable
    over links (Jaccard similarity of at least ``percent`` hundredths), its own included,
    and ``kept`` says that it is the row's own id. A null text, or one without words, has
    no shingles and is linked with nothing. Texts are linked whatever their ids: rows that
    share an id but not the text are separate texts. A null id has a null component and
    null ``kept``, and its text links nothing. Repeated rows are all returned.
    """
    found = component_rows(docs, id_col, text_col, size, percent, bands, per_band, block)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_lowest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns; null ids stay, rows that repeat a kept id and text too."""
    found = component_rows(docs, id_col, text_col, **options).filter("id = component_id").select("id", "text_hash").distinct()
    made = "kept_" + max(docs.columns, key=len)  # past any name of docs
    found = found.select(F.col("id").alias(made), F.col("text_hash").alias(made + "_"))
    kept = docs.join(broadcast_if_small(found), (F.col(id_col).cast("bigint") == F.col(made)) & (F.xxhash64(text_col) == F.col(made + "_")), "left_semi")
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
