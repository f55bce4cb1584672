"""Table catalog, table cards and comparison of tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.kinds import kind_of, numeric_columns, ref
from tidemark.operators.governance import pii_columns
from tidemark.operators.profiling import describe
from tidemark.operators.quality import completeness
from tidemark.plans.counts import column_summary
from tidemark.session import settle


def table_catalog(tables: Mapping[str, DataFrame], sample_rows: int = 2) -> DataFrame:
    """Rows, columns, column names and a few sample rows (JSON, smallest first) per table."""
    out = None
    for name, df in tables.items():
        rows = df.agg(F.count(F.lit(1)).alias("row_count"))
        sample = (df.select(F.to_json(F.struct("*")).alias("j")).orderBy("j").limit(sample_rows)
                  .agg(F.array_sort(F.collect_list("j")).alias("sample_rows")))
        part = (rows.unionByName(sample, allowMissingColumns=True)
                .agg(F.max("row_count").alias("row_count"), F.max("sample_rows").alias("sample_rows"))
                .select(F.lit(name).alias("table_name"), "row_count",
                        F.lit(len(df.columns)).cast("long").alias("column_count"),
                        F.lit(",".join(df.columns)).alias("column_names"), "sample_rows"))
        out = part if out is None else out.unionByName(part)
    return out


def registry_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of tables, mean completeness and all personal-data findings."""
    out = None
    for name, df in tables.items():
        score = completeness(df).filter("column_name = '*'").select(F.col("completeness_pct").alias("score"))
        found = pii_columns(df).agg(F.count(F.lit(1)).alias("findings"))
        part = score.unionByName(found, allowMissingColumns=True).agg(F.max("score").alias("score"),
                                                                       F.max("findings").alias("findings"))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.count(F.lit(1)).alias("tables"), F.avg("score").alias("mean_completeness"),
                   F.sum("findings").alias("governance_findings"))


def table_card(df: DataFrame, name: str, order: list[str], rows: int = 10) -> DataFrame:
    """One text describing a table: shape, columns, statistics, first rows."""
    head = df.agg(F.concat(F.lit(f"Table: {name}\n\nShape: "), F.count(F.lit(1)).cast("string"),
                           F.lit(f" rows, {len(df.columns)} columns\nColumns: {', '.join(df.columns)}\n")).alias("line"))
    parts = [head.select(F.lit(0).alias("part"), F.lit("").alias("place"), "line")]
    if numeric_columns(df):
        stats = describe(df)
        parts.append(stats.select(F.lit(1).alias("part"), F.col("column_name").alias("place"),
                                  F.to_json(F.struct("*")).alias("line")))
    first = df.orderBy(*[ref(c) for c in order]).limit(rows)
    numbered = first.select(F.lit(2).alias("part"), F.to_json(F.struct(*[ref(c) for c in order])).alias("place"),
                            F.to_json(F.struct("*")).alias("line"))
    parts.append(numbered)
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    ordered = F.array_sort(F.collect_list(F.struct("part", "place", "line")))  # rows + columns + 1 entries
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text")).select(
        F.lit(name).alias("doc_id"), "text")


def compare_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns shared by name between each pair of tables, whether their kinds agree, and on each side the table's rows and the column's distinct values."""
    out = None
    for t, df in tables.items():
        found = column_summary(df).select(F.lit(t).alias("table_name"), "column_name", "row_count", "distinct_count")
        out = found if out is None else out.unionByName(found)
    rows = [(t, f.name, kind_of(f.dataType)) for t, df in tables.items() for f in df.schema.fields]
    kinds = out.sparkSession.createDataFrame(rows, "table_name string, column_name string, kind string")
    cols = settle(out.join(F.broadcast(kinds), ["table_name", "column_name"]), "columns")  # one row per table and column
    side = lambda name: cols.select(F.lower("column_name").alias("column_name"), F.col("table_name").alias(f"{name}_table"), F.col("kind").alias(f"{name}_kind"),
                                    F.col("row_count").alias(f"{name}_rows"), F.col("distinct_count").alias(f"{name}_distinct"))
    return (side("left").join(side("right"), "column_name").filter("left_table < right_table")
            .select("left_table", "right_table", "column_name", (F.col("left_kind") == F.col("right_kind")).alias("same_kind"),
                    "left_rows", "right_rows", "left_distinct", "right_distinct"))
