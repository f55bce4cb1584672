"""Token-id files with canonical length-limited Huffman codes.

A store is a folder of two Parquet tables. ``codebook`` has one row per used id: its code
length. ``blocks`` has one row per block of whole documents, files and rows in ascending
document order: the ids before it in its file, the packed codes, the bit lengths of every STRIDE ids (checkpoints), and
the documents' ids and token counts. A block needs nothing but the codebook to be
decoded. Codes come from the counts of all ids; canonical codes follow from the lengths,
so only those are stored. Decoding looks up MAX_BITS bits at a time in one table and runs
all stretches between checkpoints side by side.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.llm.common import IdEncoder, load_tokenizer, slices
from tidemark.session import scratch_path, settle

MAX_BITS = 20
BLOCK_TOKENS = 1 << 16
STRIDE = 64
END_ID = 2


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Best code length of each id under the limit (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    if n == 1:
        lengths[order] = 1
        return lengths
    weights = counts[order].astype(np.int64)
    leaves, level = [], weights
    leaf = np.ones(n, bool)
    leaves.append(leaf)
    for _ in range(max_bits - 1):
        even = len(level) // 2 * 2
        packages = level[0:even:2] + level[1:even:2]
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        level, leaf = both[at], at < n
        leaves.append(leaf)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(leaves):
        chosen = int(leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id): each is the one before plus one, shifted to its own length."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code = 0
    previous = int(lengths[order[0]]) if len(order) else 0
    of_length = np.bincount(lengths[order], minlength=1)
    done = 0
    for bits in range(previous, len(of_length)):
        code <<= bits - previous
        previous = bits
        count = int(of_length[bits])
        codes[order[done:done + count]] = np.arange(code, code + count, dtype=np.uint64)
        code += count
        done += count
    return codes


class Encoder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical_codes(lengths)

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(codes, most significant bit first; bit length of every STRIDE ids as little-endian 16 bits)."""
        if len(ids) == 0:
            return b"", b""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        word, room = starts >> 6, 64 - (starts & 63)
        codes, spill = self.codes[ids], bits - room
        inside = spill <= 0
        head = np.where(inside, codes << np.where(inside, -spill, 0).astype(np.uint64), codes >> np.where(inside, 0, spill).astype(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words = np.zeros((int(ends[-1]) + 63) // 64 + 1, np.uint64)
        words[word[first]] = np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(spill > 0)  # at most one code runs over each word's end
        words[word[over] + 1] |= codes[over] << (64 - spill[over]).astype(np.uint64)
        raw = words.astype(">u8").tobytes()[:(int(ends[-1]) + 7) // 8]
        marks = np.diff(np.concatenate(([0], ends[STRIDE - 1::STRIDE], ends[-1:] if len(ids) % STRIDE else [])))
        return raw, marks.astype("<u2").tobytes()


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.max_bits = max(1, int(lengths.max())) if len(lengths) else 1
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        width = 1 << (self.max_bits - lengths[order].astype(np.int64))
        self.ids, self.bits = np.zeros(1 << self.max_bits, np.uint32), np.ones(1 << self.max_bits, np.uint8)
        total = int(width.sum())
        self.ids[:total], self.bits[:total] = np.repeat(order, width), np.repeat(lengths[order], width)

    def unpack(self, raw: bytes, marks: bytes, n: int) -> np.ndarray:
        """The ids of a block: one step decodes one id of every stretch."""
        if n == 0:
            return np.zeros(0, np.uint32)
        data = np.frombuffer(raw + b"\0" * 8, np.uint8).astype(np.uint32)
        window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
        sizes = np.frombuffer(marks, "<u2").astype(np.int64)
        at = np.cumsum(sizes) - sizes
        out = np.zeros((len(at), STRIDE), np.uint32)
        last = n - (len(at) - 1) * STRIDE
        drop = np.uint32(32 - self.max_bits)
        for step in range(STRIDE):
            if step == last:
                at = at[:-1]
            peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> drop
            out[:len(at), step] = self.ids[peek]
            at = at + self.bits[peek]
        return out.ravel()[:n]


def token_rows(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> tuple[DataFrame, int]:
    """(id, text_hash, ids) per row, ids with the end id, as bytes of 2 or 4 per id."""
    vocabulary, width = load_tokenizer(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    end = int(end_id).to_bytes(width, "little")

    def run(batches):
        encoder = IdEncoder(vocabulary, width)
        for batch in slices(batches):
            ids = [raw + end for raw in encoder.encode(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["id", "text_hash", "ids"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], rows.schema["text_hash"], T.StructField("ids", T.BinaryType())])), width


def count_ids(tokens: DataFrame, width: int) -> dict[int, int]:
    """How often each id occurs; summed in each task first. One entry per id of the vocabulary at most."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts = np.bincount(np.frombuffer(raw, f"<u{width}"))
                if len(counts) > len(total):
                    total = np.concatenate([total, np.zeros(len(counts) - len(total), np.int64)])
                total[:len(counts)] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])

    # Small documents would each cost a full-width count: ids of a batch are joined by the caller's batches of rows.
    partial = tokens.select("ids").mapInArrow(_joined(run), "token bigint, n bigint")
    return {r.token: r.n for r in partial.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def _joined(run):
    """Feed ``run`` one value per few megabytes instead of one per row."""

    def batches_of(batches):
        for batch in batches:
            held, size = [], 0
            for raw in batch.column(0).to_pylist():
                held.append(raw)
                size += len(raw)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["ids"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["ids"])

    return lambda batches: run(batches_of(batches))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                max_bits: int = MAX_BITS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every row and write the store to ``path``, a folder that all executors reach.

    Rows go in ascending (id, hash of the text); null ids come first and a null text is
    the end id alone. A block closes with the document that fills it, so its size is
    bounded by ``block_tokens`` plus one document. Repeated rows are stored as often as
    they occur. An empty table gives an empty codebook and no block.
    """
    spark = docs.sparkSession
    tokens, width = token_rows(docs, id_col, text_col, tokenizer_path, end_id)
    tokens = settle(tokens, "tokens")
    counted = count_ids(tokens, width)
    counts = np.zeros(max(counted, default=-1) + 1, np.int64)
    counts[list(counted)] = list(counted.values())
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "token bigint, bits int") \
        .coalesce(1).write.parquet(f"{path}/codebook")
    ordered = tokens.repartitionByRange("id", "text_hash").sortWithinPartitions("id", "text_hash").withColumn("shard", F.spark_partition_id())
    id_type = tokens.schema["id"]
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("before", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("marks", T.BinaryType()),
                           T.StructField("ids", T.ArrayType(id_type.dataType)), T.StructField("lengths", T.ArrayType(T.LongType()))])

    def run(batches):
        encoder, number, shard, before = Encoder(lengths), 0, None, 0
        names, sizes, raws, held = [], [], [], 0

        def close():
            packed = encoder.pack(np.frombuffer(b"".join(raws), f"<u{width}").astype(np.int64))
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "before": pa.array([before], pa.int64()), "n_tokens": pa.array([held], pa.int64()),
                "codes": pa.array([packed[0]], pa.binary()), "marks": pa.array([packed[1]], pa.binary()),
                "ids": pa.array([names], pa.list_(id_arrow)), "lengths": pa.array([sizes], pa.list_(pa.int64()))})

        for batch in slices(batches):
            id_arrow = batch.column(0).type
            for name, raw, shard in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                names.append(name)
                sizes.append(len(raw) // width)
                raws.append(raw)
                held += sizes[-1]
                if held >= block_tokens:
                    yield close()
                    number, before, names, sizes, raws, held = number + 1, before + held, [], [], [], 0
        if names:
            yield close()

    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) per stored document, decoded from the files; ``ids`` are little-endian 32-bit.

    With ``digest``, ``ids_crc32`` stands in place of ``ids``.

    ``start`` counts the ids of all documents before it: a block knows the ids before it in
    its shard, and the shards' totals are summed up in order.
    """
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row per id of the vocabulary
    lengths = np.zeros(max((r.token for r in book), default=-1) + 1, np.uint8)
    for r in book:
        lengths[r.token] = r.bits
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per shard, that is per file.
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    heads, head = [], 0
    for r in totals:
        heads.append((r.shard, head))
        head += r.n
    heads = F.broadcast(spark.createDataFrame(heads, "shard int, head bigint"))
    placed = blocks.join(heads, "shard").select((F.col("head") + F.col("before")).alias("at"), "n_tokens", "codes", "marks", "ids", "lengths")
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.BinaryType())])

    def run(batches):
        decoder = Decoder(lengths)
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                n = columns[1][i].as_py()
                raw = decoder.unpack(columns[2][i].as_py(), columns[3][i].as_py(), n).astype("<u4").tobytes()
                sizes = columns[5][i].values.to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                at = columns[0][i].as_py()
                own = [raw[4 * s:4 * (s + k)] for s, k in zip(starts.tolist(), sizes.tolist())]
                last = pa.array(map(zlib.crc32, own), pa.int64()) if digest else pa.array(own, pa.binary())
                yield pa.RecordBatch.from_arrays([columns[4][i].values, pa.array(at + starts, pa.int64()), pa.array(sizes, pa.int64()), last],
                                                 names=schema.names)

    return placed.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write a store to the shared folder and read it back, with ``ids_crc32`` in place of the ids."""
    path = scratch_path(docs.sparkSession, "store")
    write_store(docs, path, tokenizer_path, **options)
    return read_store(docs.sparkSession, path, digest=True)
