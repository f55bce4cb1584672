"""Drift and quality monitors as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.arithmetic import percent, ratio, severity
from tidemark.functions.kinds import is_missing, kind_of, number, ref
from tidemark.operators.drift import ABSENT, bin_edges, right_closed_bin
from tidemark.operators.quality import outlier_table
from tidemark.plans.counts import as_text
from tidemark.session import settle


def fit_baseline(df: DataFrame, cols: Sequence[str], bins: int = 10) -> dict:
    """Bin edges and bin shares of the baseline.

    Small by construction: ``bins`` + 1 numbers for a numeric column; for other
    columns the shares stay a DataFrame keyed by category.
    """
    nums = [c for c in cols if kind_of(df.schema[c].dataType) == "numeric"]
    texts = [c for c in cols if c not in nums]
    shaped = df.select(*[number(df, c).alias(c) for c in nums]) if nums else None
    edges, shares = {}, None
    if nums:
        rows = shaped.unpivot([], [ref(c) for c in nums], "column_name", "value")
        edges = {r.column_name: (r.low, r.high) for r in bin_edges(rows).collect()}
        placed = rows.withColumn("bin", _bin_case(F.col("column_name"), F.col("value"), edges, bins))
        shares = placed.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("n"))
    if texts:
        rows = (df.select(*[as_text(df, c, digest=True).alias(c) for c in texts])
                .unpivot([], [ref(c) for c in texts], "column_name", "bin"))
        counted = rows.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("n"))
        shares = counted if shares is None else shares.unionByName(counted)
    totals = shares.groupBy("column_name").agg(F.sum("n").alias("t"))
    # read by every micro-batch: settled once
    shares = settle(shares.join(F.broadcast(totals), "column_name").select(
        "column_name", "bin", ratio(F.col("n"), F.col("t")).alias("ref_share")), "baseline")
    return {"edges": edges, "shares": shares, "bins": bins, "numeric": nums, "text": texts}


def _bin_case(column: Column, value: Column, edges: dict, bins: int) -> Column:
    case = F.lit(None).cast("int")
    for name, (low, high) in edges.items():
        case = F.when(column == name, right_closed_bin(value, F.lit(low), F.lit(high), bins)).otherwise(case)
    return case.cast("string")


def _binned(stream: DataFrame, baseline: dict, keep: Sequence[Column]) -> DataFrame:
    """(keep..., column_name, bin): each row once per monitored column."""
    cells = [F.struct(F.lit(c).alias("column_name"),
                      right_closed_bin(number(stream, c), F.lit(lo), F.lit(hi), baseline["bins"]).cast("string").alias("bin"))
             for c, (lo, hi) in baseline["edges"].items()]
    cells += [F.struct(F.lit(c).alias("column_name"), as_text(stream, c, digest=True).alias("bin")) for c in baseline["text"]]
    return stream.select(*keep, F.inline(F.array(*cells)))


def _score(counted: DataFrame, baseline: dict, keys: Sequence) -> DataFrame:
    """PSI from live bin counts (keys..., column_name, bin, n) against the baseline shares.

    Sums over bins that both sides have, plus the 1e-6 rule for a bin or category
    that one side lacks, are folded into plain sums, so one aggregation is enough:
    with c live counts, N their total and r baseline shares,
    PSI = (Σ c·ln(c/r) − ln N·Σ c)/N − Σ r·ln(c/r) + ln N·Σ r.
    """
    shares = baseline["shares"].select(F.col("column_name").alias("_c0"), F.col("bin").alias("_b0"), "ref_share")
    if not baseline["text"]:
        shares = F.broadcast(shares)  # bins + 1 rows per numeric column
    same = (F.col("column_name") == F.col("_c0")) & F.col("bin").eqNullSafe(F.col("_b0"))
    joined = counted.join(shares, same, "left").drop("_c0", "_b0")
    numeric = F.col("column_name").isin(baseline["numeric"]) if baseline["numeric"] else F.lit(False)
    takes_floor = ~numeric | (F.col("bin") == "0")
    share = F.coalesce("ref_share", F.when(takes_floor, F.lit(ABSENT)))
    c = F.col("n").cast("double")
    has = share.isNotNull()
    return joined.groupBy(*keys, "column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(has, c * F.log(c / share))).alias("_cl"), F.sum(F.when(has, c)).alias("_c"),
        F.sum(F.when(has, share * F.log(c / share))).alias("_rl"), F.sum(F.when(has, share)).alias("_r"),
        # floor-rule terms of baseline bins that did show up live, to be taken back
        F.coalesce(F.sum(F.when(takes_floor & F.col("ref_share").isNotNull(),
                                (ABSENT - F.col("ref_share")) * F.log(ABSENT / F.col("ref_share")))), F.lit(0.0)).alias("_seen_floor"))


def _floor_constants(baseline: dict) -> dict[str, float]:
    """Per column: the whole floor-rule term if no such bin showed up live."""
    numeric = F.col("column_name").isin(baseline["numeric"]) if baseline["numeric"] else F.lit(False)
    rows = baseline["shares"].filter(~numeric | (F.col("bin") == "0")).groupBy("column_name").agg(
        F.sum((ABSENT - F.col("ref_share")) * F.log(ABSENT / F.col("ref_share"))).alias("whole"))
    return {r.column_name: r.whole for r in rows.collect()}


def _finish(scored: DataFrame, baseline: dict, threshold: float) -> DataFrame:
    constants = _floor_constants(baseline)
    whole = F.lit(0.0)
    for name, value in constants.items():
        whole = F.when(F.col("column_name") == name, F.lit(value)).otherwise(whole)
    n = F.col("rows").cast("double")
    seen = (F.col("_cl") - F.log(n) * F.col("_c")) / n - F.col("_rl") + F.log(n) * F.col("_r")
    psi = F.coalesce(seen, F.lit(0.0)) + whole - F.col("_seen_floor")
    return (scored.withColumn("psi", psi).withColumn("severity", severity(F.col("psi")))
            .withColumn("alert", F.col("psi") > threshold)
            .drop("_cl", "_c", "_rl", "_r", "_seen_floor"))


def monitor_drift(stream: DataFrame, baseline: dict, time_col: str, window: str = "1 day", delay: str = "1 hour",
                  threshold: float = 0.1) -> DataFrame:
    """PSI per event-time window and column against the baseline.

    Bin counts are aggregated per window, then per window and column, both in
    append mode; rows later than ``delay`` are dropped by the watermark.
    """
    live = stream.withColumn("_at", ref(time_col).cast("timestamp")).withWatermark("_at", delay)
    cells = _binned(live, baseline, [F.col("_at")])
    counted = cells.groupBy(F.window("_at", window).alias("w"), "column_name", "bin").agg(F.count(F.lit(1)).alias("n"))
    timed = counted.select(F.window_time("w").alias("_at"), "column_name", "bin", "n")
    scored = _score(timed, baseline, [F.window("_at", window).alias("w")])
    return _finish(scored, baseline, threshold).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "column_name", "rows", "psi",
        "severity", "alert")


def drift_alerts(results: DataFrame) -> DataFrame:
    return results.filter("alert").select("window_start", "column_name", "psi", "severity")


def monitor_quality(stream: DataFrame, time_col: str, cols: Sequence[str], bounds: dict[str, tuple[float, float]],
                    window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows, missing percent, duplicates and out-of-bounds values per window.

    Rows are grouped by fingerprint inside the window first, so duplicates need no
    state beyond the open windows.
    """
    live = stream.withColumn("_at", ref(time_col).cast("timestamp")).withWatermark("_at", delay)
    gaps = sum([is_missing(stream, c).cast("long") for c in cols], F.lit(0).cast("long"))
    outside = sum([F.coalesce(~number(stream, c).between(lo, hi), F.lit(False)).cast("long") for c, (lo, hi) in bounds.items()],
                  F.lit(0).cast("long"))
    print_ = F.sha2(F.to_json(F.struct(*[as_text(stream, c).alias(c) for c in cols]), {"ignoreNullFields": "false"}), 256)
    rows = live.select("_at", print_.alias("fingerprint"), gaps.alias("gaps"), outside.alias("outside"))
    per_print = rows.groupBy(F.window("_at", window).alias("w"), "fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gaps").alias("gaps"), F.sum("outside").alias("outside"))
    timed = per_print.select(F.window_time("w").alias("_at"), "n", "gaps", "outside")
    out = timed.groupBy(F.window("_at", window).alias("w")).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("gaps").alias("gaps"),
        F.sum("outside").alias("outliers"))
    return out.select(F.col("w.start").alias("window_start"), "rows", "duplicates",
                      percent(F.col("gaps"), F.col("rows") * len(cols)).alias("missing_pct"), "outliers")


def fit_bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    return {r.column_name: (r.lower_bound, r.upper_bound) for r in outlier_table(df, cols).collect()}


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the monitor's own state, in any file system Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def monitor_drift_batches(stream: DataFrame, baseline: dict, order: Sequence[str], path: str, window_size: int = 1000,
                          threshold: float = 0.1, interval: str | None = None):
    """PSI of the newest ``window_size`` rows after every micro-batch.

    The newest rows are kept as one small folder per batch under ``path`` (shared
    storage). Batch n takes the newest rows of each task (a bounded heap, no sort of the
    batch) and of the folder of batch n-1, overwrites its own, so that a repeated batch gives
    the same result, and removes that of batch n-2, which no repetition reads.
    """
    cols = list(dict.fromkeys([*order, *baseline["numeric"], *baseline["text"]]))

    def on_batch(batch: DataFrame, number_: int) -> None:
        rows = batch.select(*[ref(c) for c in cols])
        if number_ > 0:
            rows = rows.unionByName(batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/newest/{number_ - 1}"))
        newest = rows.orderBy(*[ref(o).desc() for o in order]).limit(window_size)
        newest.write.mode("overwrite").parquet(f"{path}/newest/{number_}")
        kept = batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/newest/{number_}")
        counted = _binned(kept, baseline, [F.lit(number_).alias("batch")]).groupBy("batch", "column_name", "bin").agg(
            F.count(F.lit(1)).alias("n"))
        result = _finish(_score(counted, baseline, ["batch"]), baseline, threshold)
        result.write.mode("overwrite").parquet(f"{path}/scores/batch_id={number_}")
        if number_ > 1:
            _remove(batch.sparkSession, f"{path}/newest/{number_ - 2}")

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process what is there, append to Parquet under ``path``, and read the result."""
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
