"""Two-sample drift. Input rows carry ``period``: 'ref' or 'cur'.

All tests start from one grouped frame per kind, (column_name, value, n_ref,
n_cur), so the base table is scanned once for all columns and a frequent value
costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.arithmetic import (chi_square_p, corrected_kurtosis, corrected_skew, kolmogorov_p, percent,
                                           ratio, severity)
from tidemark.functions.kinds import columns_of, kind_of, number, numeric_columns, ref
from tidemark.operators.cleaning import fit_scaler, key_hash, scale
from tidemark.operators.profiling import histogram
from tidemark.plans.counts import (column_summary, duplicate_count, long_values, top_values, value_counts)
from tidemark.plans.ranks import at_ranks, quantiles, running
from tidemark.plans.stats import missing_counts, moments
from tidemark.session import settle

ABSENT = 1e-6
RESULT_COLUMNS = ["column_name", "test_method", "statistic", "p_value", "drift_score", "drift_detected", "severity"]


# ---- periods ----

def temporal_cut(df: DataFrame, order: Sequence[str], share: float = 0.7):
    """The order key of row number floor(n * share), found by ranks; one small row to the driver."""
    at = F.struct(*[ref(o) for o in order])
    counted = df.select(at.alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    found = at_ranks(counted, [], "at", {"cut": lambda total: F.floor(total * share) - 1}).first()
    return found["cut"]


def split_temporal(df: DataFrame, order: Sequence[str], share: float = 0.7) -> DataFrame:
    """Adds ``period``: the first floor(n * share) rows by ``order`` are the reference.

    ``order`` must be unique (end it with a key). The cut is a literal, so the
    result is a plain projection whose filters push down to the scan.
    """
    cut = temporal_cut(df, order, share)
    if cut is None:
        return df.withColumn("period", F.lit("cur"))
    edge = F.struct(*[F.lit(cut[o]).cast(df.schema[o].dataType).alias(o) for o in order])
    at = F.struct(*[ref(o).alias(o) for o in order])
    return df.withColumn("period", F.when(at <= edge, "ref").otherwise("cur"))


def split_random(df: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """Adds ``period``: the floor(n * share) rows with the lowest key hash are the reference.

    Repeatable; the cut is a literal, as in ``split_temporal``. ``key`` must be unique.
    """
    at = F.struct(key_hash(ref(key)).alias("h"), ref(key).alias("k"))
    counted = df.select(at.alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    cut = at_ranks(counted, [], "at", {"cut": lambda total: F.floor(total * share) - 1}).first()["cut"]
    if cut is None:
        return df.withColumn("period", F.lit("cur"))
    edge = F.struct(F.lit(cut.h).cast("long").alias("h"), F.lit(cut.k).cast(df.schema[key].dataType).alias("k"))
    return df.withColumn("period", F.when(at <= edge, "ref").otherwise("cur"))


def _in(period: str, what: Column | None = None) -> Column:
    return F.sum(F.when(F.col("period") == period, F.lit(1) if what is None else what).otherwise(0))


def _numeric_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    shaped = df.select("period", *[(number(df, c) + F.lit(0.0)).alias(c) for c in cols])
    return shaped.unpivot(["period"], [ref(c) for c in cols], "column_name", "value")


def _paired_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = _numeric_rows(df, cols)
    return rows.groupBy("column_name", "value").agg(_in("ref").alias("n_ref"), _in("cur").alias("n_cur"))


def _paired_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = long_values(df, cols, ["period"], digest=True)
    return rows.groupBy("column_name", "value").agg(_in("ref").alias("n_ref"), _in("cur").alias("n_cur"))


# ---- tests ----

def ks_2samp(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Largest distance between the two empirical distributions, per numeric column."""
    cols = list(cols if cols is not None else numeric_columns(df))
    counted = _paired_numeric(df, cols).filter("value is not null")
    ranked = running(counted, ["column_name"], "value", ["n_ref", "n_cur"])
    gap = F.abs(ratio(F.col("n_ref_upto"), F.col("n_ref_total")) - ratio(F.col("n_cur_upto"), F.col("n_cur_total")))
    return (ranked.groupBy("column_name")
            .agg(F.max(gap).alias("statistic"), F.max("n_ref_total").alias("ref_size"), F.max("n_cur_total").alias("cur_size"))
            .withColumn("p_value", kolmogorov_p(F.col("statistic"), F.col("ref_size"), F.col("cur_size"))))


def chi_square(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Chi-square of category counts; with one degree of freedom Yates' correction applies.

    The score divides by all rows, missing ones included.
    """
    cols = list(cols if cols is not None else [c for c in columns_of(df, "text") if c != "period"])
    counted = _paired_text(df, cols)
    known = F.col("value").isNotNull()
    totals = counted.groupBy("column_name").agg(
        F.sum(F.when(known, F.col("n_ref"))).cast("double").alias("r"),
        F.sum(F.when(known, F.col("n_cur"))).cast("double").alias("c"),
        F.sum(F.col("n_ref") + F.col("n_cur")).alias("all_rows"), F.count("value").alias("categories"))
    cell = counted.filter(known).join(F.broadcast(totals), "column_name")  # one row per column
    both = F.col("n_ref") + F.col("n_cur")

    def term(observed, side):
        e = ratio(both * F.col(side), F.col("r") + F.col("c"))
        off = F.abs(observed - e)
        off = F.when(F.col("categories") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
        return F.try_divide(off * off, e)

    out = cell.groupBy("column_name", "r", "c", "all_rows", "categories").agg(
        F.sum(term(F.col("n_ref"), "r") + term(F.col("n_cur"), "c")).alias("statistic"))
    usable = (F.col("categories") > 1) & (F.col("r") > 0) & (F.col("c") > 0)
    return out.select(
        "column_name", F.when(usable, F.col("statistic")).otherwise(0.0).alias("statistic"),
        (F.col("categories") - 1).alias("dof"),
        F.when(usable, chi_square_p(F.col("statistic"), (F.col("categories") - 1).cast("double"))).otherwise(1.0).alias("p_value"),
        F.when(usable, ratio(F.col("statistic"), F.col("all_rows"))).otherwise(0.0).alias("drift_score"))


def bin_edges(reference: DataFrame) -> DataFrame:
    """Range of each column's reference values, for equal-width bins; a constant gets unit width."""
    seen = reference.filter("value is not null").groupBy("column_name").agg(
        F.min("value").alias("low"), F.max("value").alias("high"))
    flat = F.col("low") == F.col("high")
    return seen.select("column_name", F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
                       F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))


def right_closed_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins (e0,e1], (e1,e2], ... with e0 itself in the first; 0 stands for missing or out of range."""
    step = (high - low) / bins
    inner = F.when(value.isNull() | F.isnan(value) | (value < low) | (value > high), 0)
    for i in range(1, bins):
        inner = inner.when(value <= low + step * i, i)
    return inner.otherwise(bins)


def _psi_term(ref_share: Column, cur_share: Column) -> Column:
    return F.when((ref_share > 0) & (cur_share > 0), (cur_share - ref_share) * F.log(cur_share / ref_share)).otherwise(0.0)


def psi_numeric(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Population stability index over bins of the reference range.

    A regular bin empty on one side adds nothing; the extra bin (missing or out
    of range) counts as 1e-6 on the side where it is absent.
    """
    cols = list(cols if cols is not None else numeric_columns(df))
    rows = _numeric_rows(df, cols)
    edges = bin_edges(rows.filter("period = 'ref'"))
    placed = rows.join(F.broadcast(edges), "column_name")  # one row per column
    cells = (placed.withColumn("bin", right_closed_bin(F.col("value"), F.col("low"), F.col("high"), bins))
             .groupBy("column_name", "bin").agg(_in("ref").alias("n_ref"), _in("cur").alias("n_cur")))
    totals = cells.groupBy("column_name").agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c"))
    shares = cells.join(F.broadcast(totals), "column_name")
    fill = F.when(F.col("bin") == 0, F.lit(ABSENT)).otherwise(F.lit(0.0))
    ref_share = F.when(F.col("n_ref") > 0, ratio(F.col("n_ref"), F.col("r"))).otherwise(fill)
    cur_share = F.when(F.col("n_cur") > 0, ratio(F.col("n_cur"), F.col("c"))).otherwise(fill)
    return shares.groupBy("column_name").agg(F.sum(_psi_term(ref_share, cur_share)).alias("psi"))


def psi_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Population stability index over categories; missing is a category, an absent one counts 1e-6."""
    cols = list(cols if cols is not None else [c for c in columns_of(df, "text") if c != "period"])
    counted = _paired_text(df, cols)
    totals = counted.groupBy("column_name").agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c"))
    shares = counted.join(F.broadcast(totals), "column_name")  # one row per column
    ref_share = F.when(F.col("n_ref") > 0, ratio(F.col("n_ref"), F.col("r"))).otherwise(ABSENT)
    cur_share = F.when(F.col("n_cur") > 0, ratio(F.col("n_cur"), F.col("c"))).otherwise(ABSENT)
    return shares.groupBy("column_name").agg(F.sum(_psi_term(ref_share, cur_share)).alias("psi"))


def column_drift(df: DataFrame, cols: Sequence[str], threshold: float = 0.05, test: str = "auto") -> DataFrame:
    """One result row per column: KS for numbers, chi-square for the rest, or PSI for both."""
    nums = [c for c in cols if kind_of(df.schema[c].dataType) == "numeric"]
    rest = [c for c in cols if c not in nums]
    parts = []
    if test == "psi":
        for found in ([psi_numeric(df, nums)] if nums else []) + ([psi_categorical(df, rest)] if rest else []):
            parts.append(found.select("column_name", F.lit("Population Stability Index").alias("test_method"),
                                      F.col("psi").alias("statistic"), F.lit(None).cast("double").alias("p_value"),
                                      F.col("psi").alias("drift_score")))
    else:
        if nums:
            parts.append(ks_2samp(df, nums).select(
                "column_name", F.lit("Kolmogorov-Smirnov").alias("test_method"), "statistic", "p_value",
                F.col("statistic").alias("drift_score")))
        if rest:
            parts.append(chi_square(df, rest).select(
                "column_name", F.lit("Chi-square").alias("test_method"), "statistic", "p_value", "drift_score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    detected = F.when(F.col("p_value").isNotNull(), F.col("p_value") < threshold).otherwise(F.col("drift_score") > threshold)
    return out.withColumn("drift_detected", detected).withColumn("severity", severity(F.col("drift_score")))


# ---- descriptions of both periods ----

def numeric_drift_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols if cols is not None else numeric_columns(df))
    keys = ["period", "column_name"]
    quart = quantiles(df, [0.25, 0.5, 0.75], ["q25", "median", "q75"], cols, by=["period"])
    n = F.col("valid")
    return (moments(df, cols, by=["period"]).join(F.broadcast(quart), keys, "left")  # columns x periods
            .select(*keys, F.col("row_count").alias("count"), (F.col("row_count") - n).alias("missing"), "mean", "median",
                    "std", "minimum", "maximum", "q25", "q75", corrected_skew(n, F.col("skew_pop")).alias("skewness"),
                    corrected_kurtosis(n, F.col("kurtosis_pop")).alias("kurtosis")))


def categorical_drift_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows, missing, distinct and entropy (natural log) per period and column."""
    cols = list(cols if cols is not None else [c for c in columns_of(df, "text") if c != "period"])
    counted = value_counts(df, cols, by=["period"], digest=True, keep_missing=True)
    known = F.col("value").isNotNull()
    n = F.when(known, F.col("n").cast("double"))
    return (counted.groupBy("period", "column_name")
            .agg(F.sum("n").alias("count"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
                 F.count("value").alias("unique_count"),
                 (F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("entropy")))


def top_categories(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    cols = list(cols if cols is not None else [c for c in columns_of(df, "text") if c != "period"])
    return top_values(value_counts(df, cols, by=["period"]), k, by=["period"])


def compare_histograms(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Each period's own equal-width histogram with densities."""
    return histogram(df, cols, bins, by=["period"])


def five_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    names = ["minimum", "q25", "median", "q75", "maximum"]
    return quantiles(df, [0.0, 0.25, 0.5, 0.75, 1.0], names, cols, by=["period"])


def compare_categories(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Counts in both periods for the union of each period's top k."""
    counted = value_counts(df, cols, by=["period"])
    tops = top_values(counted, k, by=["period"]).select("column_name", "value").distinct()
    return (counted.join(F.broadcast(tops), ["column_name", "value"])  # at most 2k values per column
            .groupBy("column_name", "value").agg(
                F.sum(F.when(F.col("period") == "ref", F.col("n")).otherwise(0)).alias("n_ref"),
                F.sum(F.when(F.col("period") == "cur", F.col("n")).otherwise(0)).alias("n_cur")))


def drift_summary(results: DataFrame) -> DataFrame:
    score = F.col("drift_score")
    return results.agg(
        F.count(F.lit(1)).alias("columns_analyzed"), F.count_if("drift_detected").alias("columns_with_drift"),
        F.avg(score).alias("overall_score"), F.max(score).alias("max_score"), F.min(score).alias("min_score"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("high_columns"),
        F.count_if(F.col("severity") == "medium").alias("medium_columns"),
        F.bool_or("drift_detected").alias("drift_detected"))


def period_sizes(df: DataFrame) -> DataFrame:
    """Sizes and row-number ranges of the two periods."""
    return (df.agg(F.count_if(F.col("period") == "ref").alias("ref_size"), F.count_if(F.col("period") == "cur").alias("cur_size"))
            .select("ref_size", "cur_size", F.lit(0).cast("long").alias("ref_start"), (F.col("ref_size") - 1).alias("ref_end"),
                    F.col("ref_size").alias("cur_start"), (F.col("ref_size") + F.col("cur_size") - 1).alias("cur_end")))


def drift_recommendations(results: DataFrame) -> DataFrame:
    """Rules over the summary, one row for each that fires."""
    def rule(fires, name, priority, category, measure):
        return F.when(fires, F.struct(F.lit(name).alias("rule"), F.lit(priority).alias("priority"),
                                      F.lit(category).alias("category"), measure.cast("double").alias("measure")))

    overall, high, medium = F.col("overall_score"), F.col("high_columns"), F.col("medium_columns")
    share = ratio(F.col("columns_with_drift"), F.col("columns_analyzed"))
    rows = F.array(
        rule(overall > 0.2, "significant_drift", "High", "Assessment", overall),
        rule((overall > 0.1) & (overall <= 0.2), "moderate_drift", "Medium", "Assessment", overall),
        rule(high > 0, "address_high_columns", "High", "Immediate Action", high),
        rule(share > 0.3, "model_at_risk", "High", "Model Impact", share),
        rule(overall > 0.15, "retrain_model", "High", "Model Management", overall),
        rule(medium > 0, "watch_medium_columns", "Medium", "Monitoring", medium),
        rule(F.lit(True), "automate_detection", "Medium", "Infrastructure", F.lit(1)),
        rule(F.lit(True), "document_patterns", "Low", "Documentation", F.lit(1)))
    return drift_summary(results).select(F.inline(F.array_compact(rows)))


def quality_drift(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Change of the missing ratio (over ``cols``) and of the duplicate ratio, one row."""
    gaps = missing_counts(df, cols, by=["period"]).groupBy("period").agg(
        ratio(F.sum("missing"), F.sum("row_count")).alias("missing_ratio"))
    dup = duplicate_count(df, by=["period"]).select(
        "period", ratio(F.col("duplicate_rows"), F.col("row_count")).alias("duplicate_ratio"))
    pick = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    wide = gaps.unionByName(dup, allowMissingColumns=True).agg(
        *[pick(p, c).alias(f"{p}_{c}") for p in ("ref", "cur") for c in ("missing_ratio", "duplicate_ratio")])
    return wide.withColumns({
        "missing_ratio_change": F.col("cur_missing_ratio") - F.col("ref_missing_ratio"),
        "duplicate_ratio_change": F.col("cur_duplicate_ratio") - F.col("ref_duplicate_ratio")})


def drift_suitability(df: DataFrame) -> DataFrame:
    """Which columns can be tested for drift, and how."""
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, kind_of(f.dataType))])
    kind, distinct = kinds[F.col("column_name")], F.col("distinct_count")
    gaps = percent(F.col("missing"), F.col("row_count"))
    label = (F.when((kind == "numeric") & (distinct < 2), "Constant")
             .when((kind == "numeric") & (gaps > 90), "Too many missing")
             .when(kind == "numeric", "Numerical Distribution")
             .when((kind == "text") & (distinct > 0.9 * F.col("row_count")), "High cardinality")
             .when(kind == "text", "Categorical Distribution").otherwise("Statistical"))
    return (column_summary(df).select("column_name", gaps.alias("missing_pct"), "distinct_count", label.alias("drift_type"))
            .withColumn("suitable", ~F.col("drift_type").isin("Constant", "Too many missing", "High cardinality")))


def pca_drift(df: DataFrame, cols: Sequence[str], components: int = 3) -> DataFrame:
    """Mean KS distance over principal components fitted on the reference.

    Missing values are 0 and scaling uses the reference, so both fits see only
    reference rows; the projections are then compared like ordinary columns.
    """
    cols = list(cols)
    filled = df.select("period", *[F.coalesce(number(df, c), F.lit(0.0)).alias(c) for c in cols])
    scaled = scale(filled, fit_scaler(filled.filter("period = 'ref'"), cols))
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(scaled)
    k = min(components, len(cols))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(rows.filter("period = 'ref'"))
    parts = model.transform(rows).select("period", vector_to_array("pc").alias("pc"))
    names = [f"pc{i + 1}" for i in range(k)]
    wide = parts.select("period", *[F.col("pc")[i].alias(nm) for i, nm in enumerate(names)])
    explained = [float(x) for x in model.explainedVariance.toArray()]
    return ks_2samp(wide, names).agg(F.avg("statistic").alias("score"), F.count(F.lit(1)).alias("components")).withColumn(
        "explained_variance", F.array(*[F.lit(x) for x in explained]))


def drift_report(df: DataFrame, cols: Sequence[str], threshold: float = 0.05) -> dict[str, DataFrame]:
    """Every section of the analysis by name. Write it with ``sinks.write_report``.

    The column results are settled, as three sections read them; the rest is lazy.
    """
    results = settle(column_drift(df, cols, threshold), "drift")
    nums = [c for c in cols if kind_of(df.schema[c].dataType) == "numeric"]
    texts = [c for c in cols if kind_of(df.schema[c].dataType) == "text"]
    sections = {"columns": results, "summary": drift_summary(results), "sizes": period_sizes(df),
                "recommendations": drift_recommendations(results), "quality": quality_drift(df, cols)}
    if nums:
        sections["numeric_stats"] = numeric_drift_stats(df, nums)
        sections["histograms"] = compare_histograms(df, nums)
    if texts:
        sections["categorical_stats"] = categorical_drift_stats(df, texts)
        sections["top_categories"] = top_categories(df, texts)
    if len(nums) >= 2:
        sections["multivariate"] = pca_drift(df, nums)
    return sections


