"""Exports and the report sink."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Records as CSV with a header, or as JSON lines."""
    if fmt == "csv":
        df.write.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def report_rows(sections: Mapping[str, DataFrame]) -> DataFrame:
    """(section, body): every result row as JSON under its section name."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


def write_report(sections: Mapping[str, DataFrame], path: str) -> None:
    report_rows(sections).write.partitionBy("section").text(path)
