"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A document of a source with repetition rate r is kept n times, n drawn from a Poisson
distribution with mean r. The draw inverts the distribution at a uniform number made
from a hash of the seed, the id and the text, so a task that runs again draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.plans.sizing import broadcast_if_small

SEED = 11
TEMPERATURE = 0.5
#: One inversion covers means up to this; a larger mean is a sum of equal parts drawn one by one.
PART = 16.0
#: Terms of an inversion: past a mean of 16 the chance of more than 96 is below 1e-40.
TERMS = 96


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def cumulative(mean: Column) -> Column:
    """Array of P(N <= k) for k = 0 .. TERMS."""
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def add(state, k):
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(steps, start, add)["c"]


def rates(docs: DataFrame, source_col: str, size: Column, weights: dict[str, float] | None, epochs: float,
          temperature: float) -> DataFrame:
    """(source, rate, parts, table): mean repetitions per source, and the table of one part.

    Sizes are summed per source after a partial sum in each task, so a source with most
    rows is one row per task. With ``weights``, sources not named get weight 0. Without,
    a source's weight is its size to the power ``temperature``. Rates scale so that the
    expected total is ``epochs`` times the present one.
    """
    sums = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("size")).filter("size > 0")
    if weights is None:
        wanted = sums.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        named = F.lit(None).cast("double")
        for name, weight in weights.items():
            named = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(named)
        wanted = sums.withColumn("w", F.coalesce(named, F.lit(0.0)))
    total = wanted.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    rate = F.when(F.col("all_w") > 0, F.lit(float(epochs)) * F.col("all_size") * F.col("w") / (F.col("all_w") * F.col("size"))) \
        .otherwise(F.lit(0.0))
    # The total is one row by construction.
    return (wanted.join(F.broadcast(total)).withColumn("rate", rate)
            .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
            .withColumn("table", cumulative(F.col("rate") / F.col("parts")))
            .select("source", "rate", "parts", "table"))


def replicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED,
              count_as: str = "copy", key_as: str = "order_key") -> DataFrame:
    """The columns of ``docs`` with each row repeated by its draw, in a global random order, and the columns ``count_as``
    (number of the repetition, from 0) and ``key_as`` (the number that the order goes by).

    Sizes count a row as its characters plus one, so empty and null texts count too. Null
    sources are one source. Repeated rows (same id and text) draw alike. A source of weight
    0 gives no rows. The order is a range partitioning by the hash of each repetition, so
    any number of copies of one document is spread over all partitions. A column of ``docs``
    called ``count_as`` or ``key_as`` is replaced.
    """
    size = (F.coalesce(F.length(text_col), F.lit(0)) + 1).cast("bigint")
    by_source = rates(docs, source_col, size, weights, epochs, temperature)
    named = by_source.select(F.col("source").alias("for_source"), "parts", "table")
    # The document's columns travel in one struct, so none can clash with the columns made here.
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    id_of, text_of = F.col("doc").getField(id_col), F.col("doc").getField(text_col)
    joined = packed.join(broadcast_if_small(named), F.col("doc").getField(source_col).eqNullSafe(F.col("for_source")))
    text_key = F.concat_ws("|", F.coalesce(id_of.cast("string"), F.lit("")), F.md5(F.coalesce(text_of, F.lit(""))))
    # The hashes are made once per part, outside the comparison with the table.
    chances = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: uniform(F.lit(str(seed)), F.lit("n"), F.col("ident"), part.cast("string")))
    drawn = F.aggregate("chances", F.lit(0), lambda n, u: n + F.size(F.filter("table", lambda c: c <= u)))
    named_rows = joined.withColumn("ident", text_key).withColumn("chances", chances)
    counted = named_rows.select("doc", "ident", drawn.alias("n"))
    # No filter on n: it would be pushed into the join and make every draw twice.
    copies = counted.select("doc", "ident", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("copy"))
    keyed = copies.withColumn("key", uniform(F.lit(str(seed)), F.lit("o"), F.col("ident"), F.col("copy").cast("string"))).drop("ident")
    ordered = keyed.repartitionByRange("key").sortWithinPartitions(F.col("key"), id_of, F.col("copy"))
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in (count_as, key_as)]
    return ordered.select(*own, F.col("copy").alias(count_as), F.col("key").alias(key_as))


def mix(docs: DataFrame, **options) -> DataFrame:
    """As ``replicate``, with the columns of ``docs`` alone."""
    made = [f"{name}-{max(map(len, docs.columns)) * 'x'}" for name in ("copy", "key")]  # longer than any column's name
    return replicate(docs, count_as=made[0], key_as=made[1], **options).drop(*made)
