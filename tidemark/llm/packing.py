"""Packing of token ids into fixed sequences, mixing sources by deficit round robin.

Each source is a queue of documents. A window gives every queue a quantum of tokens, its
share of the window. A queue serves whole grains of GRAIN tokens; what its quanta leave
below a grain is its deficit, carried to the next window. Documents may be cut, so after j
windows a queue has been served exactly min(its tokens, GRAIN * floor(j * quantum / GRAIN))
tokens. That closed form lets every task place its own documents: the deficits carry over
windows and partitions without a task having to wait for another. A queue that has run dry
gives up its turn and the window gets shorter, so the stream has no gaps, and cutting it
every ``length`` tokens leaves only the last sequence short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm.common import IdEncoder, load_tokenizer, slices
from tidemark.plans.sizing import broadcast_if_small
from tidemark.session import settle

LENGTH = 1024
#: Tokens of a window when all queues are full.
WINDOW_TOKENS = 64 * LENGTH
END_ID = 0
#: Queues at most; beyond it the sources without a target that have the fewest tokens share the last one. A task holds a few numbers per queue.
QUEUES = 4096
#: Tokens that a queue serves at once; larger than a sequence's share of most documents, so few are cut for the mixture.
GRAIN = LENGTH
#: Quanta are kept in 1/65536 of a token.
FRACTION = 16


def encoded(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """(part, source, id, before, n_tokens, ids): ``before`` counts the tokens of the source's earlier rows in this part."""
    vocabulary, width = load_tokenizer(tokenizer_path)
    source = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                         F.spark_partition_id().alias("part"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("source", T.StringType()), source.schema["id"],
                           T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = int(end_id).to_bytes(width, "little")

    def run(batches):
        encoder, served = IdEncoder(vocabulary, width), {}
        for batch in slices(batches):
            sources, before, lengths, ids = batch.column(0).to_pylist(), [], [], []
            for name, raw in zip(sources, encoder.encode(batch.column(2).to_pylist())):
                ids.append(raw + end)
                lengths.append(len(ids[-1]) // width)
                before.append(served.get(name, 0))
                served[name] = before[-1] + lengths[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(0), batch.column(1), pa.array(before, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(ids, pa.binary())], names=["part", "source", "id", "before", "n_tokens", "ids"])

    return source.mapInArrow(run, schema), width


class Schedule:
    """Where token t of a queue stands in the stream. ``totals`` and ``quanta`` are per queue, quanta in 1/65536 of a token."""

    def __init__(self, totals: list[int], quanta: list[int], grain: int = GRAIN):
        self.grain, self.unit = grain, grain << FRACTION
        self.totals, self.quanta = np.array(totals, np.int64), np.array(quanta, np.int64)
        # The windows after which each queue is dry; more windows serve it no more.
        self.dry = np.array([-(-(-(-t // grain) * self.unit) // q) for t, q in zip(totals, quanta)], np.int64)

    def served(self, windows: int) -> np.ndarray:
        """Tokens that each queue has given after so many windows."""
        return np.minimum(self.totals, np.minimum(windows, self.dry) * self.quanta // self.unit * self.grain)

    def window_of(self, queue: int, token: int) -> int:
        """The window that serves a token: the least j with served(j + 1) > token."""
        return -(-(token // self.grain + 1) * self.unit // int(self.quanta[queue])) - 1

    def spans(self, queue: int, token: int, count: int):
        """(position in the stream, first token, tokens) of a run of a queue's tokens, window by window."""
        last = token + count
        while token < last:
            window = self.window_of(queue, token)
            before, after = self.served(window), self.served(window + 1)
            take = min(last, int(after[queue])) - token
            yield int(before.sum()) + int((after - before)[:queue].sum()) + token - int(before[queue]), token, take
            token += take


def quanta(totals: dict, weights: dict | None, window_tokens: int) -> dict:
    """Each queue's tokens per window in 1/65536, at least one unit. Without weights: in proportion to the totals."""
    wanted = totals if weights is None else {k: float(weights.get(k, 0.0)) for k in totals}
    total = sum(wanted.values()) or 1
    return {k: max(1, round(v / total * window_tokens * (1 << FRACTION))) for k, v in wanted.items()}


PIECES = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()),
          ("offset", T.LongType()), ("source", T.StringType())]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         length: int = LENGTH, window_tokens: int = WINDOW_TOKENS, weights: dict[str, float] | None = None, end_id: int = END_ID,
         max_queues: int = QUEUES, digest: bool = False) -> DataFrame:
    """Pieces (id_col, start, length, doc_tokens, sequence_id, offset, source, ids); ``ids`` are little-endian, 2 or 4 bytes wide.

    With ``digest``, ``ids_crc32`` stands in place of ``ids``: the crc32 of the ids as
    little-endian unsigned 32-bit integers.

    Documents are queued in the order in which they are read. A null text is an empty
    document of the end id alone; a null source is a queue; repeated rows are packed as
    often as they occur. With ``weights``, named sources have queues of their own (more of them than queues are an
    error) and sources not named are served at the least
    rate, so mostly last, never dropped. ``length`` is the sequence length; only the last sequence is shorter.
    """
    tokens, width = encoded(docs, id_col, text_col, source_col, tokenizer_path, end_id)
    tokens = settle(tokens, "tokens")
    # One row per part and source; a source's rows are as many as there are parts.
    sums = settle(tokens.groupBy("source", "part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n")), "sums")
    order_by = [F.desc("n"), F.col("source")]
    if weights is not None:  # a source with a target never shares a queue
        if len(weights) >= max_queues:
            raise ValueError(f"weights name {len(weights)} sources; there are {max_queues} queues, one of them for sources not named")
        target = F.coalesce(F.col("source").isin([s for s in weights if s is not None]), F.lit(None in weights))
        order_by.insert(0, target.desc())
    ranked = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(*order_by).limit(max_queues - 1).collect()
    named = {r.source: r.n for r in ranked}
    rest = sums.agg(F.sum("n")).first()[0] or 0
    rest -= sum(named.values())
    order = sorted(named, key=lambda s: (s is None, s or ""))
    totals = [named[s] for s in order] + [rest]
    rates = quanta(dict(zip([*order, ("rest",)], totals)), None if weights is None else weights, window_tokens)
    plan = (totals, list(rates.values()))
    queue_of = {s: i for i, s in enumerate(order)}

    # Tokens of a queue before each part, and in the shared queue those of the part's earlier sources.
    spark = docs.sparkSession
    numbers = spark.createDataFrame([(s, i) for s, i in queue_of.items()] or [(None, 0)], "name string, number int")
    placed = sums.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name")), "left") \
        .select("source", "part", "n", F.coalesce("number", F.lit(len(order))).alias("queue"))
    inner = placed.withColumn("inner", F.sum("n").over(
        Window.partitionBy("queue", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)))
    outer = placed.groupBy("queue", "part").agg(F.sum("n").alias("n")).withColumn("outer", F.sum("n").over(
        Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    zero = F.lit(0).cast("bigint")
    heads = (inner.join(outer, ["queue", "part"]).select(
        F.col("source").alias("s"), F.col("part").alias("p"), "queue",
        (F.coalesce("inner", zero) + F.coalesce("outer", zero)).alias("ahead")))
    found = tokens.join(broadcast_if_small(heads), F.expr("part = p AND source <=> s")) \
        .select("id", "source", "queue", (F.col("ahead") + F.col("before")).alias("token"), "n_tokens", "ids")
    schema = T.StructType([T.StructField(id_col, tokens.schema["id"].dataType), *(T.StructField(n, t) for n, t in PIECES),
                           T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.BinaryType())])

    def finished(raw: bytes):
        return zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()) if digest else raw

    def run(batches):
        schedule = Schedule(*plan)
        for batch in slices(batches):
            take, rows = [], []
            for i, (queue, token, n, raw) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))):
                for at, first, count in schedule.spans(queue, token, n):
                    done = 0
                    while done < count:
                        size = min(count - done, length - (at + done) % length)
                        start = first + done - token
                        take.append(i)
                        rows.append((start, size, n, (at + done) // length, (at + done) % length, finished(raw[start * width:(start + size) * width])))
                        done += size
            columns = list(zip(*rows)) if rows else [[]] * 6
            made = [pa.array(c, pa.int64()) for c in columns[:5]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *made,
                                              batch.column(1).take(pa.array(take, pa.int64())), pa.array(columns[5], pa.int64() if digest else pa.binary())],
                                             names=schema.names)

    return found.mapInArrow(run, schema)
