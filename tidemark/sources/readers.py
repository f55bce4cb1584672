"""Readers: tables with their origin, CSV, JSON, one text document per file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_tables(spark: SparkSession, tables: Mapping[str, str], limit: int | None = None) -> DataFrame:
    """Union by column name with ``_source_table``; columns a table lacks are null.

    A value is a Parquet path, or a catalog table name. ``limit`` is per table and
    off by default.
    """
    out = None
    for name, place in tables.items():
        df = spark.read.parquet(place) if "/" in place else spark.table(place)
        df = (df.limit(limit) if limit else df).withColumn("_source_table", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large inputs; inference reads the file twice."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", schema is None)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON record per line, or files holding one array of records (``schema`` is None)."""
    reader = spark.read
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and whole content."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))
