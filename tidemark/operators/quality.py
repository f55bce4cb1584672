"""Data-quality scan: issues, scores and readiness labels, one row per finding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import patterns as fixed
from tidemark.functions.arithmetic import at_least, corrected_skew, percent, ratio
from tidemark.functions.kinds import is_missing, kind_column, kind_of, number, numeric_columns, ref, text_columns
from tidemark.plans.counts import (LONG_TEXT, as_text, column_summary, duplicate_count, modes, value_counts)
from tidemark.plans.ranks import quantiles
from tidemark.plans.stats import beside, missing_counts, moments, per_column
from tidemark.session import settle

ISSUE_COLUMNS = ["column_name", "issue_type", "severity", "affected_rows", "affected_pct", "suggested_fix"]


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with missing values: count, percent, severity and fix."""
    return _judge_missing(missing_counts(df))


def _judge_missing(counts: DataFrame) -> DataFrame:
    pct = percent(F.col("missing"), F.col("row_count"))
    return (counts.filter("missing > 0")
            .withColumn("missing_pct", pct)
            .withColumn("severity", F.when(F.col("missing_pct") > 50, "high")
                        .when(F.col("missing_pct") > 20, "medium").otherwise("low"))
            .withColumn("suggested_fix", F.when(F.col("missing_pct") < 50, "impute").otherwise("drop_column")))


def casing_variants(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per text column: distinct values and distinct lower-cased values.

    Long text is compared by digest, so the shuffle carries at most 64 characters
    for each side.
    """
    cols = list(cols if cols is not None else text_columns(df))

    def packed(name):
        raw = ref(name).cast("string")
        low = F.lower(raw)
        short = lambda v: F.when(F.length(v) > LONG_TEXT, F.sha2(v, 256)).otherwise(v)
        return F.when(raw.isNotNull(), F.struct(short(raw).alias("raw"), short(low).alias("low")))

    pairs = (df.select(*[packed(c).alias(c) for c in cols])
             .unpivot([], [ref(c) for c in cols], "column_name", "pair")
             .filter("pair is not null").select("column_name", "pair.raw", "pair.low"))
    variants = pairs.groupBy("column_name", "low", "raw").agg(F.count(F.lit(1)).alias("n"))
    per_low = variants.groupBy("column_name", "low").agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    return per_low.groupBy("column_name").agg(
        F.sum("spellings").alias("distinct_count"), F.count(F.lit(1)).alias("distinct_lower"),
        F.sum("n").alias("valid"))


def casing_issues(df: DataFrame) -> DataFrame:
    return casing_variants(df).filter("distinct_lower < distinct_count")


def _pattern_rows(df: DataFrame, pattern: str) -> DataFrame:
    cols = text_columns(df)
    return per_column(df, cols, {"matches": lambda c: F.count_if(ref(c).cast("string").rlike(pattern))})


def date_strings(df: DataFrame) -> DataFrame:
    """Text columns holding dates, judged over all rows."""
    return _pattern_rows(df, fixed.DATE_PREFIX).filter("matches > 0")


def numeric_strings(df: DataFrame) -> DataFrame:
    """Text columns holding formatted numbers, judged over all rows."""
    return _pattern_rows(df, fixed.FORMATTED_NUMBER).filter("matches > 0")


def outlier_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Interquartile bounds and the rows outside them, for every numeric column.

    The bounds are one row per column, so that rows outside are counted in one more scan
    without a shuffle of values.
    """
    cols = list(cols if cols is not None else numeric_columns(df))
    quartiles = quantiles(df, [0.25, 0.75], ["q1", "q3"], cols)
    bounds = settle(quartiles.withColumn("lower_bound", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
                    .withColumn("upper_bound", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))), "bounds")
    edges = {r.column_name: (r.lower_bound, r.upper_bound) for r in bounds.collect()}
    kept = [c for c in cols if c in edges]
    if not kept:
        return bounds.select("*", F.lit(0).cast("long").alias("valid"), F.lit(0).cast("long").alias("outliers"), F.lit(0.0).alias("outlier_pct"))

    def outside(c):
        v, (low, high) = number(df, c), edges[c]
        return F.count_if((v < F.lit(low)) | (v > F.lit(high)))

    counts = per_column(df, kept, {"valid": lambda c: F.count(number(df, c)), "outliers": outside}).drop("row_count")
    return (bounds.join(F.broadcast(counts), "column_name")  # one row per column
            .select("column_name", "q1", "q3", "lower_bound", "upper_bound", "valid", "outliers")
            .withColumn("outlier_pct", percent(F.col("outliers"), F.col("valid"))))


def outlier_issues(df: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Columns whose outliers exceed ``threshold`` percent of all rows."""
    return _judge_outliers(outlier_table(df), missing_counts(df, numeric_columns(df)), threshold)


def _judge_outliers(table: DataFrame, counts: DataFrame, threshold: float = 5.0) -> DataFrame:
    rows = counts.select("column_name", "row_count")
    return (table.drop("outlier_pct").join(F.broadcast(rows), "column_name")
            .withColumn("outlier_pct", percent(F.col("outliers"), F.col("row_count")))
            .filter(F.col("outlier_pct") > threshold))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: row count, duplicate rows, percent."""
    return duplicate_count(df).withColumn("duplicate_pct", percent(F.col("duplicate_rows"), F.col("row_count")))


def scan_quality(df: DataFrame) -> DataFrame:
    """All findings as rows of one schema."""
    def shape(rows, issue, level, affected, pct, fix):
        as_col = lambda x: x if not isinstance(x, str) else F.lit(x)
        return rows.select("column_name", F.lit(issue).alias("issue_type"), as_col(level).alias("severity"),
                           affected.cast("long").alias("affected_rows"), pct.alias("affected_pct"),
                           as_col(fix).alias("suggested_fix"))

    whole = F.lit(100.0)
    texts = text_columns(df)
    matching = lambda pattern: lambda c: F.count_if(ref(c).cast("string").rlike(pattern)) if c in texts else F.sum(F.lit(0))
    # One scan for everything that is counted per column; one row per column.
    facts = settle(per_column(df, df.columns, {"missing": lambda c: F.count_if(is_missing(df, c)), "dates": matching(fixed.DATE_PREFIX),
                                               "numbers": matching(fixed.FORMATTED_NUMBER)}), "facts")
    parts = [shape(_judge_missing(facts), "missing_values", F.col("severity"), F.col("missing"),
                   F.col("missing_pct"), F.col("suggested_fix"))]
    if texts:
        totals = F.broadcast(facts.select("column_name", F.col("row_count").alias("total")))
        parts += [
            shape(casing_issues(df).join(totals, "column_name"), "inconsistent_casing", "medium",
                  F.col("total"), whole, "standardize_case"),
            shape(facts.filter("dates > 0"), "date_format", "medium", F.col("row_count"), whole, "to_datetime"),
            shape(facts.filter("numbers > 0"), "numeric_formatting", "medium", F.col("row_count"), whole, "to_number"),
        ]
    if numeric_columns(df):
        parts.append(shape(_judge_outliers(outlier_table(df), facts), "outliers", "low", F.col("outliers"), F.col("outlier_pct"), "iqr_filter"))
    dup = duplicate_rows(df).filter("duplicate_rows > 0").withColumn("column_name", F.lit("all_columns"))
    parts.append(shape(dup, "duplicate_rows", "medium", F.col("duplicate_rows"), F.col("duplicate_pct"), "drop_duplicates"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts by severity and by type, long form."""
    both = issues.select(F.inline(F.array(
        F.struct(F.lit("severity").alias("grouping"), F.col("severity").alias("label")),
        F.struct(F.lit("issue_type").alias("grouping"), F.col("issue_type").alias("label")))))
    return both.groupBy("grouping", "label").agg(F.count(F.lit(1)).alias("issues"))


def suggest_cleaning(issues: DataFrame) -> DataFrame:
    """Issue rows turned into operator calls, most severe first."""
    weight = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return issues.select(
        F.col("issue_type").alias("category"), F.col("severity").alias("priority"), weight.alias("priority_rank"),
        F.col("column_name"), F.col("suggested_fix").alias("operator"))


def completeness(df: DataFrame) -> DataFrame:
    """Percent present by column, plus ``*`` for all cells."""
    by_column = missing_counts(df)
    overall = by_column.agg(F.sum("row_count").alias("row_count"), F.sum("missing").alias("missing"))
    rows = by_column.select("column_name", "row_count", "missing").unionByName(
        overall.select(F.lit("*").alias("column_name"), "row_count", "missing"))
    return rows.withColumn("completeness_pct", 100.0 - percent(F.col("missing"), F.col("row_count")))


def uniqueness(df: DataFrame) -> DataFrame:
    """Distinct values per column; the ``*`` row holds distinct whole rows."""
    by_column = column_summary(df).select("column_name", "row_count", "distinct_count")
    whole = duplicate_count(df).select(F.lit("*").alias("column_name"), "row_count",
                                       (F.col("row_count") - F.col("duplicate_rows")).alias("distinct_count"))
    rows = by_column.unionByName(whole)
    return (rows.withColumn("duplicates", F.col("row_count") - F.col("distinct_count"))
            .withColumn("unique_pct", percent(F.col("distinct_count"), F.col("row_count"))))


def validity(df: DataFrame, positive_cols: Sequence[str] | None = None) -> DataFrame:
    """Negative values in columns that must be positive, and the score."""
    wanted = {c.lower() for c in (positive_cols if positive_cols is not None else fixed.POSITIVE_COLUMNS)}
    cols = [c for c in numeric_columns(df) if c.lower() in wanted]
    return _rule_score(df, cols, {c: F.count_if(number(df, c) < 0) for c in cols}, 100.0, 15.0)


def accuracy(df: DataFrame, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Values outside their plausible range, and the score."""
    ranges = {k.lower(): v for k, v in (ranges if ranges is not None else fixed.VALUE_RANGES).items()}
    cols = [c for c in numeric_columns(df) if c.lower() in ranges]
    outside = {c: F.count_if(~number(df, c).between(*[float(x) for x in ranges[c.lower()]])) for c in cols}
    return _rule_score(df, cols, outside, 85.0, 10.0)


def _rule_score(df, cols, counters, start, penalty):
    aggs = [F.count(F.lit(1)).alias("row_count")] + [counters[c].alias(f"#{i}") for i, c in enumerate(cols)]
    broken = [F.col(f"`#{i}`") for i in range(len(cols))]
    issues = sum([F.when(b > 0, 1).otherwise(0) for b in broken], F.lit(0))
    names = F.array(*[F.when(b > 0, F.lit(c)) for b, c in zip(broken, cols)]) if cols else F.array().cast("array<string>")
    return (df.agg(*aggs)
            .select("row_count", issues.cast("long").alias("issues"),
                    F.concat_ws(",", F.array_compact(names)).alias("columns"),
                    sum([b for b in broken], F.lit(0)).cast("long").alias("bad_values"))
            .withColumn("score", at_least(start - penalty * F.col("issues"), 0.0)))


def consistency(df: DataFrame) -> DataFrame:
    """100 minus 10 for each text column with mixed casing."""
    found = casing_variants(df).agg(F.count_if(F.col("distinct_lower") < F.col("distinct_count")).alias("issues"))
    return found.withColumn("score", at_least(100.0 - 10.0 * F.col("issues"), 0.0))


def value_kinds(df: DataFrame) -> DataFrame:
    """Kinds of value inside each text column: integer, decimal, date, boolean, text."""
    def kind(c):
        v = ref(c).cast("string")
        return F.when(v.isNotNull(),
                      F.when(v.try_cast("bigint").isNotNull(), "integer")
                      .when(v.try_cast("double").isNotNull(), "decimal")
                      .when(v.try_cast("date").isNotNull(), "date")
                      .when(F.lower(v).isin("true", "false"), "boolean").otherwise("text"))

    cols = text_columns(df)
    kinds = df.select(*[kind(c).alias(c) for c in cols])
    return value_counts(kinds, cols).select("column_name", F.col("value").alias("value_kind"), "n")


def value_kind_score(df: DataFrame) -> DataFrame:
    """Share of text columns holding a single kind of value."""
    per = value_kinds(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("kinds"))
    return (per.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("kinds") > 1).alias("mixed"))
            .withColumn("score", F.coalesce((1.0 - ratio(F.col("mixed"), F.col("checked"))) * 100.0, F.lit(100.0))))


def quality_metrics(df: DataFrame) -> DataFrame:
    """Missing, duplicate and outlier percentages and the composite score, one row."""
    cells = missing_counts(df).agg(F.sum("row_count").alias("cells"), F.sum("missing").alias("missing"))
    dup = duplicate_rows(df).select("row_count", "duplicate_pct")
    out = outlier_table(df).agg(F.sum("outliers").alias("outliers"))
    return (beside(cells, dup, out).select(
        percent(F.col("missing"), F.col("cells")).alias("missing_pct"), "duplicate_pct",
        percent(F.col("outliers"), F.col("row_count")).alias("outlier_pct"))
        .withColumn("score", at_least(100.0 - F.col("missing_pct") - F.col("duplicate_pct")
                                      - F.col("outlier_pct") / 10.0, 0.0)))


def column_skews(df: DataFrame) -> DataFrame:
    """Bias-corrected skewness per numeric column."""
    return moments(df).select("column_name", corrected_skew(F.col("valid"), F.col("skew_pop")).alias("skewness"))


def column_score(df: DataFrame) -> DataFrame:
    """100 minus 0.8 per missing percent, one decimal, within 0..100."""
    pct = percent(F.col("missing"), F.col("row_count"))
    score = F.round(F.least(F.lit(100.0), at_least(100.0 - 0.8 * pct, 0.0)), 1)
    return missing_counts(df).select("column_name", score.alias("score"))


def column_facts(df: DataFrame) -> DataFrame:
    """Kind, counts and outliers per column: the common ground of the label rules."""
    out = (outlier_table(df).select("column_name", "outliers") if numeric_columns(df) else None)
    facts = column_summary(df).withColumn("kind", kind_column(df))
    facts = (facts.withColumn("missing_pct", percent(F.col("missing"), F.col("row_count")))
             .withColumn("distinct_ratio", ratio(F.col("distinct_count"), F.col("row_count"))))
    if out is None:
        return facts.withColumn("outliers", F.lit(None).cast("long"))
    return facts.join(F.broadcast(out), "column_name", "left")  # one row per column


def column_issues(df: DataFrame) -> DataFrame:
    """Per column: which issue rules fire, how many, and 100 minus 10 for each."""
    facts = column_facts(df)
    missing = F.when(F.col("missing_pct") > 50, "high").when(F.col("missing_pct") > 5, "medium")
    wide = (F.col("kind") == "text") & (F.col("distinct_ratio") > 0.5)
    spread = F.coalesce(percent(F.col("outliers"), F.col("row_count")) > 5, F.lit(False))
    return (facts.select("column_name", missing.alias("missing_severity"), wide.alias("high_cardinality"),
                         spread.alias("many_outliers"))
            .withColumn("issues", F.col("missing_severity").isNotNull().cast("long")
                        + F.col("high_cardinality").cast("long") + F.col("many_outliers").cast("long"))
            .withColumn("score", 100 - 10 * F.col("issues")))


def readiness(df: DataFrame) -> DataFrame:
    """One row with the modeling and the drift readiness labels."""
    kinds = [kind_of(f.dataType) for f in df.schema.fields]
    only_text = "numeric" not in kinds and "text" in kinds
    facts = column_summary(df).agg(
        F.sum("row_count").alias("cells"), F.sum("missing").alias("missing"),
        F.count(F.lit(1)).alias("columns"), F.count_if(F.col("distinct_count") <= 1).alias("constant"))
    share = ratio(F.col("missing"), F.col("cells"))
    drift = 100.0 - 30.0 * share - 40.0 * ratio(F.col("constant"), F.col("columns"))
    return (facts.select((share * 100.0).alias("missing_pct"), "constant", drift.alias("drift_score"))
            .withColumn("modeling_readiness",
                        F.when(F.col("missing_pct") > 30, "needs_preprocessing")
                        .when(F.col("missing_pct") > 10, "minor_preprocessing")
                        .when(F.lit(only_text), "needs_encoding").otherwise("ready"))
            .withColumn("drift_readiness",
                        F.when(F.col("drift_score") >= 90, "Excellent").when(F.col("drift_score") >= 75, "Good")
                        .when(F.col("drift_score") >= 60, "Fair").otherwise("Poor")))


def class_counts(df: DataFrame) -> DataFrame:
    """Most and least frequent value per column (see ``plans.counts.modes``)."""
    return modes(value_counts(df))
