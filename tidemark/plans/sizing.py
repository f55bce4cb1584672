"""Size checks that decide between two exact ways of doing the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import settle

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own estimate; costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when a settled or scanned ``df`` holds at most so many rows and bytes; reads file statistics only."""
    return estimated_bytes(df) <= max_bytes and df.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Settle the side of a join, then hint a broadcast if its true size is small; otherwise leave the join to AQE.

    Settling first means that the side is computed once and that its size is known, not
    estimated from the tables it comes from.
    """
    settled = settle(df, "side")
    return F.broadcast(settled) if fits(settled, max_rows) else settled


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for an iterative fit on a small file scan; larger scans are left as they are.

    Only for plain scans: asking a plan with shuffles for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def keep_parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Full shuffle parallelism for few bytes that cause much work (key expansion, edit distances).

    AQE merges partitions by size and would put such rows into one task; an
    explicit partition number is left alone.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(width, *keys)
