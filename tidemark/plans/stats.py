"""One-pass statistics: a single aggregation, then one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.kinds import is_missing, number, numeric_columns, ref

WIDE_BATCH = 40


def per_column(df: DataFrame, cols: Sequence[str], measures: dict, by: Sequence[str] = ()) -> DataFrame:
    """Aggregate ``measures`` (name -> function of a column name) and turn the row into rows.

    Wide tables go through in batches, which keeps generated code below the JVM
    method limit.
    """
    batches = [list(cols[i:i + WIDE_BATCH]) for i in range(0, len(cols), WIDE_BATCH)]
    parts = []
    for batch in batches:
        aggs = [F.count(F.lit(1)).alias("row_count")]
        aggs += [make(c).alias(f"{m}#{i}") for i, c in enumerate(batch) for m, make in measures.items()]
        wide = df.groupBy(*[ref(b) for b in by]).agg(*aggs)
        rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{m}#{i}`").alias(m) for m in measures])
                for i, c in enumerate(batch)]
        parts.append(wide.select(*[ref(b) for b in by], "row_count", F.inline(F.array(*rows))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    cols = list(cols if cols is not None else [c for c in df.columns if c not in by])
    return per_column(df, cols, {"missing": lambda c: F.count_if(is_missing(df, c))}, by)


def moments(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Count, range, mean, spread and shape of every numeric column in one scan.

    The rows are unpivoted and combined per column before the exchange. One short
    aggregation over more rows beats one very wide aggregation, whose generated
    method is too large for the JVM to compile.
    """
    cols = list(cols if cols is not None else [c for c in numeric_columns(df) if c not in by])
    shaped = df.select(*[ref(b) for b in by], *[number(df, c).alias(c) for c in cols])
    rows = shaped.unpivot([ref(b) for b in by], [ref(c) for c in cols], "column_name", "v")
    v = F.col("v")
    return rows.groupBy(*by, "column_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.count(v).alias("valid"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"),
        F.skewness(v).alias("skew_pop"), F.kurtosis(v).alias("kurtosis_pop"),
        F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"))


def beside(*one_row: DataFrame) -> DataFrame:
    """Put one-row results next to each other without a join."""
    stacked = one_row[0]
    for other in one_row[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(ref(c)).alias(c) for c in stacked.columns])
