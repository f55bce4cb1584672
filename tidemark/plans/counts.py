"""Long value counts: the shared first step of most column operators.

Columns are unpivoted to ``(column_name, value)`` and counted in one shuffle.
The partial aggregation runs before the exchange, so a value that fills a third
of the table costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.kinds import kind_of, present, ref

LONG_TEXT = 64


def as_text(df: DataFrame, name: str, digest: bool = False) -> Column:
    """Value as a string that is equal exactly when the values are equal."""
    data_type = df.schema[name].dataType
    value = present(df, name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        value = value + F.lit(0.0).cast(data_type)  # -0.0 and 0.0 are one value
    if kind_of(data_type) == "other" and not isinstance(data_type, T.BinaryType):
        text = F.to_json(F.struct(value.alias("v")))
        text = F.when(value.isNotNull(), text)
    else:
        text = value.cast("string")
    if digest and isinstance(data_type, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        long_form = F.concat(F.lit("\u0001sha256:"), F.sha2(text, 256))
        text = F.when(F.length(text) > LONG_TEXT, long_form).otherwise(text)
    return text


def long_values(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
                digest: bool = False) -> DataFrame:
    cols = list(cols if cols is not None else [c for c in df.columns if c not in by])
    shaped = df.select(*[ref(b) for b in by], *[as_text(df, c, digest).alias(c) for c in cols])
    return shaped.unpivot([ref(b) for b in by], [ref(c) for c in cols], "column_name", "value")


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
                 digest: bool = False, keep_missing: bool = False) -> DataFrame:
    """(by..., column_name, value, n). ``digest`` shuffles a hash instead of long text."""
    rows = long_values(df, cols, by, digest)
    if not keep_missing:
        rows = rows.filter(F.col("value").isNotNull())
    return rows.groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def column_summary(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per column: rows, missing, distinct, largest and smallest class."""
    n, known = F.col("n"), F.col("value").isNotNull()
    return (value_counts(df, cols, by, digest=True, keep_missing=True)
            .groupBy(*by, "column_name")
            .agg(F.sum(n).alias("row_count"),
                 F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("missing"),
                 F.count(F.when(known, n)).alias("distinct_count"),
                 F.max(F.when(known, n)).alias("largest_class"),
                 F.min(F.when(known, n)).alias("smallest_class")))


def top_values(counted: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``position`` 1..k by count descending, value ascending.

    ``position <= k`` directly over ``row_number`` lets Spark cut every map
    partition to k rows per column before the exchange.
    """
    order = Window.partitionBy(*by, "column_name").orderBy(F.col("n").desc(), F.col("value"))
    return counted.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def modes(counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most and least frequent value per column with bounded state (no value map)."""
    rank = F.struct((-F.col("n")).alias("neg"), F.col("value"))
    return (counted.groupBy(*by, "column_name")
            .agg(F.min_by("value", rank).alias("most_frequent"),
                 F.max("n").alias("most_frequent_count"),
                 F.max_by("value", rank).alias("least_frequent"),
                 F.min("n").alias("least_frequent_count"),
                 F.count(F.lit(1)).alias("distinct_count")))


def duplicate_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., row_count, duplicate_rows): rows minus distinct rows, null equal to null."""
    shaped = df.select(*[ref(b) for b in by],
                       *[as_text(df, c, digest=True).alias(c) if kind_of(df.schema[c].dataType) in ("text", "other")
                         else present(df, c).alias(c) for c in df.columns if c not in by])
    groups = shaped.groupBy(*[ref(c) for c in shaped.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
                                   F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
