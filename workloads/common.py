"""Loading, derived inputs and helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.arithmetic import tidy

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
}
TEXT = {
    "lineitem": ["l_returnflag", "l_linestatus"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "customer": ["c_name", "c_mktsegment"],
    "part": ["p_name", "p_brand", "p_type"],
    "documents": ["text", "lang", "source"],
}
ALL = {
    "lineitem": NUMERIC["lineitem"] + TEXT["lineitem"] + ["l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns, fold negative zero."""
    return df.withColumns({c: tidy(F.col(c), d) for c, d in digits.items()})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0::double)"


def union(parts: Iterable[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def each(cols: Iterable[str], template: str) -> str:
    """One SELECT per column; ``{c}`` is the column name."""
    return union(template.replace("{c}", c) for c in cols)


# ---- derived inputs (the generated tables hold no nulls, casing mixes or outliers) ----

def labelled(spark, sf):
    """documents with labels attached: about 60% of quality and toxic are null."""
    docs = table(spark, sf, "documents")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


LABELLED = "labelled AS (SELECT d.doc_id, text, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
LABELLED_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def sparse_lines(spark, sf):
    """lineitem with zero discount and tax turned into nulls."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))


SPARSE = """sparse AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_quantity, l_extendedprice,
  nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem)"""


def messy(spark, sf):
    """orders with mixed casing, dates as text, numbers as text and a heavy tail."""
    o = table(spark, sf, "orders")
    return o.select(
        F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderdate").cast("date").cast("string").alias("day_text"),
        F.format_number("o_totalprice", 2).alias("price_text"),
        F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice")).alias("price"),
        F.col("o_orderstatus").alias("status"))


MESSY = """messy AS (SELECT
  CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day_text,
  format('{:,.2f}', o_totalprice) AS price_text,
  CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS price,
  o_orderstatus AS status FROM orders)"""


def lang_source(spark, sf):
    return table(spark, sf, "documents").select("lang", "source")
