"""Relations between columns: correlation, dependency, column graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.arithmetic import ratio
from tidemark.functions.kinds import number, numeric_columns, ref, text_columns
from tidemark.operators.profiling import column_roles
from tidemark.plans.counts import as_text
from tidemark.plans.products import pair_moments


def correlations(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over rows where both are present."""
    cols = list(cols if cols is not None else numeric_columns(df))
    return _pair_correlations(df, cols, [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))])


def _pair_correlations(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """All pairs from one scan. Null without common rows or spread, NaN with infinite values."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, j, cols[i], cols[j]) for i, j in pairs], "i int, j int, left_column string, right_column string")
    out = ["left_column", "right_column", F.col("i").cast("long").alias("left_index"), F.col("j").cast("long").alias("right_index"), "correlation"]
    if not pairs:
        return names.withColumn("correlation", F.lit(0.0)).select(*out)
    r = F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))
    r = F.when(F.col("odd") > 0, F.lit(float("nan"))).when((F.col("xx") > 0) & (F.col("yy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return names.join(pair_moments(df, cols, pairs), ["i", "j"], "left").withColumn("correlation", r).select(*out)


def high_correlations(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs beyond the threshold; ``redundant`` above 0.9."""
    return (correlations(df).filter(F.abs("correlation") > threshold)
            .select("left_column", "right_column", "correlation", (F.abs("correlation") > 0.9).alias("redundant")))


def adjacent_correlations(df: DataFrame, n: int | None = None) -> DataFrame:
    """Whole-percent absolute correlation of column i with i+1; with ``n``, for the first n columns."""
    cols = numeric_columns(df)
    pairs = [(i, i + 1) for i in range(len(cols) - 1)][:n]
    return (_pair_correlations(df, cols, pairs).filter(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
            .select(F.concat(F.lit("n"), F.col("left_index").cast("string")).alias("label"),
                    F.floor(F.abs("correlation") * 100).cast("long").alias("value")))


def cramers_v(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Dependency of every text column pair from its contingency counts.

    One pass explodes each row to its column pairs and counts (pair, a, b); the
    margins are sums of those counts. Chi-square needs only the observed cells:
    sum(o^2/e) - n equals the full sum, as empty cells contribute e and the
    expectations add up to n. Yates' correction applies to 2x2 tables, where the
    four cells are written out.
    """
    cols = list(cols if cols is not None else text_columns(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    cells = (df.select(*[as_text(df, c, digest=True).alias(c) for c in cols])
             .select(F.explode(F.array(*[
                 F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"),
                          ref(a).alias("a"), ref(b).alias("b")) for a, b in pairs])).alias("p")).select("p.*")
             .filter("a is not null and b is not null"))
    pair = ["left_column", "right_column"]
    observed = cells.groupBy(*pair, "a", "b").agg(F.count(F.lit(1)).alias("o"))
    rows = observed.groupBy(*pair, "a").agg(F.sum("o").alias("row_sum"))
    cols_ = observed.groupBy(*pair, "b").agg(F.sum("o").alias("col_sum"))
    sizes = (rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("r"), F.sum("row_sum").alias("n"))
             .join(F.broadcast(cols_.groupBy(*pair).agg(F.count(F.lit(1)).alias("k"))), pair))
    sizes = F.broadcast(sizes)  # one row per column pair
    cell = observed.join(rows, pair + ["a"]).join(cols_, pair + ["b"]).join(sizes, pair)
    o, n = F.col("o").cast("double"), F.col("n").cast("double")
    e = F.col("row_sum") * F.col("col_sum") / n
    plain = F.sum(o * o / e) - F.max(n)
    # in a 2x2 table every cell deviates by the same |o - e|
    off = F.max(F.abs(o - e))
    inverse = F.max(n * n * n / F.nullif(F.col("row_sum") * (n - F.col("row_sum")) * F.col("col_sum")
                                         * (n - F.col("col_sum")), F.lit(0.0)))
    corrected = F.pow(off - F.least(F.lit(0.5), off), 2) * inverse
    table = cell.groupBy(*pair, "r", "k").agg(plain.alias("plain"), corrected.alias("yates"), F.max(n).alias("n"))
    chi = F.when((F.col("r") == 2) & (F.col("k") == 2), F.col("yates")).otherwise(F.greatest(F.col("plain"), F.lit(0.0)))
    side = F.least("r", "k") - 1
    return (table.filter((F.col("r") > 1) & (F.col("k") > 1))
            .withColumn("chi_square", chi)
            .withColumn("cramers_v", F.sqrt(ratio(F.col("chi_square"), F.col("n") * side)))
            .filter(F.col("cramers_v") > threshold)
            .select(*pair, "cramers_v", F.when(F.col("cramers_v") > 0.6, "strong").otherwise("moderate").alias("strength")))


def column_graph(df: DataFrame) -> DataFrame:
    """Nodes (with their role) and edges (strongly correlated pairs) as one frame."""
    nodes = column_roles(df).select(F.lit("node").alias("item"), F.col("column_name").alias("source"),
                                    F.lit(None).cast("string").alias("target"), "role")
    edges = high_correlations(df).select(F.lit("edge").alias("item"), F.col("left_column").alias("source"),
                                         F.col("right_column").alias("target"), F.lit(None).cast("string").alias("role"))
    return nodes.unionByName(edges)
