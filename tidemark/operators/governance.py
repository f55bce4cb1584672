"""Personal data, semantic types, quality gates, bias and interpretability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import patterns as fixed
from tidemark.functions.arithmetic import at_least, percent
from tidemark.functions.kinds import present, ref, text_columns
from tidemark.operators.profiling import column_roles, transform_suggestions
from tidemark.operators.quality import column_issues, completeness, consistency, duplicate_rows
from tidemark.plans.counts import column_summary
from tidemark.plans.stats import beside, missing_counts, per_column


def plain_text(df: DataFrame, name: str) -> Column:
    """Value as plain text; floats from 1e7 up without exponent."""
    value = present(df, name)
    text = value.cast("string")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        fixed_point = F.rtrim(value.cast("decimal(38,10)").cast("string"), F.lit("0"))
        fixed_point = F.when(fixed_point.endswith("."), F.concat(fixed_point, F.lit("0"))).otherwise(fixed_point)
        text = F.when((F.abs(value) >= 1e7) & (F.abs(value) < 1e16), fixed_point).otherwise(text)
    return text


def pii_columns(df: DataFrame) -> DataFrame:
    """Columns that look personal, by name and by value (an email anywhere, else a phone number)."""
    named = [c for c in df.columns if any(w in c.lower() for w in fixed.PII_NAME_WORDS)]
    rows = df.sparkSession.createDataFrame(
        [(c, "potential_pii") for c in named], "column_name string, pii_type string")
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return rows
    found = per_column(df, cols, {
        "emails": lambda c: F.count_if(ref(c).rlike(fixed.SEMANTIC_PATTERNS["email"])),
        "phones": lambda c: F.count_if(ref(c).rlike(fixed.SEMANTIC_PATTERNS["phone"])),
    })
    kind = F.when(F.col("emails") > 0, "email").when(F.col("phones") > 0, "phone")
    return rows.unionByName(found.select("column_name", kind.alias("pii_type")).filter("pii_type is not null"))


def semantic_types(df: DataFrame) -> DataFrame:
    """Best matching pattern per column over all rows; more than 80% must match."""
    cols = df.columns
    rows = (df.select(*[plain_text(df, c).alias(c) for c in cols])
            .unpivot([], [ref(c) for c in cols], "column_name", "value"))
    names = list(fixed.SEMANTIC_PATTERNS)
    counted = rows.groupBy("column_name").agg(
        F.count("value").alias("valid"),
        *[F.count_if(F.col("value").rlike(fixed.SEMANTIC_PATTERNS[n])).alias(n) for n in names])
    candidates = F.array(*[
        F.when(F.col(n) > 0.8 * F.col("valid"),
               F.struct(F.col(n).alias("matches"), F.lit(-i).alias("rank"), F.lit(n).alias("kind")))
        for i, n in enumerate(names)])
    best = F.array_max(F.array_compact(candidates))
    return counted.select(
        "column_name", "valid", F.coalesce(best["matches"], F.lit(0)).cast("long").alias("matches"),
        F.when(F.col("valid") == 0, "unknown").otherwise(F.coalesce(best["kind"], F.lit("generic"))).alias("semantic_type"))


def governance(df: DataFrame) -> DataFrame:
    """Quality gates, compliance score and production readiness, one row."""
    overall = completeness(df).filter("column_name = '*'").select(F.col("completeness_pct").alias("completeness"))
    dup = duplicate_rows(df).select("duplicate_rows", "duplicate_pct")
    even = (consistency(df).select(F.col("score").alias("consistency")) if text_columns(df)
            else df.sparkSession.range(1).select(F.lit(100.0).alias("consistency")))
    pii = pii_columns(df).agg(F.count(F.lit(1)).alias("pii_findings"))
    gate = (F.col("completeness") >= 90).cast("int") + (F.col("duplicate_pct") < 5).cast("int") + (
        F.col("consistency") > 80).cast("int")
    privacy = F.when(F.col("pii_findings") == 0, 100.0).otherwise(60.0)
    return (beside(overall, dup, even, pii)
            .withColumn("gates_passed", gate.cast("long"))
            .withColumn("compliance_score", (F.col("completeness") + privacy + F.col("gates_passed") * 100.0 / 3) / 3)
            .withColumn("production_ready", (F.col("completeness") >= 80) & (F.col("pii_findings") == 0)))


def governance_recommendations(report: DataFrame) -> DataFrame:
    """Rules over the one-row ``governance`` result."""
    rule = lambda when, kind, level, fix: F.when(when, F.struct(
        F.lit(kind).alias("rule"), F.lit(level).alias("priority"), F.lit(fix).alias("action")))
    rows = F.array(
        rule(F.col("pii_findings") > 0, "privacy", "high", "mask_pii"),
        rule(F.col("completeness") < 80, "data_quality", "high", "impute"),
        rule(F.col("duplicate_pct") >= 5, "data_integrity", "medium", "drop_duplicates"))
    return report.select(F.inline(F.array_compact(rows)))


def bias_indicators(df: DataFrame) -> DataFrame:
    """Imbalanced categorical columns, and one row when columns lack over 20% of values."""
    roles = column_roles(df).select("column_name", "role")
    classes = column_summary(df).filter("distinct_count > 1")
    skewed = (classes.join(F.broadcast(roles), "column_name").filter("role = 'categorical'")  # one row per column
              .withColumn("ratio", F.col("largest_class") / F.col("smallest_class").cast("double"))
              .filter("ratio > 10")
              .select(F.lit("class_imbalance").alias("indicator"), F.col("column_name").alias("columns"),
                      F.when(F.col("ratio") > 50, "high").otherwise("medium").alias("severity"), "ratio"))
    gaps = (missing_counts(df).filter(percent(F.col("missing"), F.col("row_count")) > 20)
            .agg(F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("columns"))
            .filter("columns <> ''")
            .select(F.lit("missing_data_bias").alias("indicator"), "columns", F.lit("medium").alias("severity"),
                    F.lit(None).cast("double").alias("ratio")))
    return skewed.unionByName(gaps)


def bias_risk(df: DataFrame) -> DataFrame:
    return (bias_indicators(df).agg(F.count(F.lit(1)).alias("indicators"))
            .withColumn("risk_score", F.least(F.lit(100), F.col("indicators") * 25).cast("long")))


def interpretability(df: DataFrame) -> DataFrame:
    """Score per column: penalties for cardinality, many transforms and open issues."""
    roles = column_roles(df).select("column_name", "role", "unique_pct")
    steps = transform_suggestions(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("transforms"))
    issues = column_issues(df).select("column_name", "issues")
    joined = (roles.join(F.broadcast(steps), "column_name", "left")  # all three hold one row per column
              .join(F.broadcast(issues), "column_name", "left").fillna(0, ["transforms", "issues"]))
    score = (100 - F.when((F.col("role") == "categorical") & (F.col("unique_pct") > 50), 30).otherwise(0)
             - F.when(F.col("transforms") > 2, 20).otherwise(0) - 10 * F.col("issues"))
    return joined.select("column_name", "role", "transforms", "issues",
                         F.greatest(score, F.lit(0)).cast("long").alias("score"))


def explainability(df: DataFrame) -> DataFrame:
    """Four readiness factors in one row."""
    overall = completeness(df).filter("column_name = '*'").select((F.col("completeness_pct") > 80).alias("quality_ok"))
    wide = column_roles(df).agg((F.count_if(F.col("unique_pct") > 90) < 3).alias("cardinality_ok"),
                                (F.count(F.lit(1)) < 100).alias("width_ok"))
    passed = 1 + F.col("quality_ok").cast("int") + F.col("cardinality_ok").cast("int") + F.col("width_ok").cast("int")
    return beside(overall, wide).withColumn("readiness_score", passed * 25.0)


def mask_pii(df: DataFrame, cols: Sequence[str], how: str = "hash") -> DataFrame:
    """Replace values: ``hash`` (SHA-256), ``mask`` (digits to 0, letters to x), ``redact`` (emails and phones in text)."""
    def masked(c):
        v = ref(c).cast("string")
        if how == "hash":
            return F.sha2(v, 256)
        if how == "mask":
            return F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[A-Za-z]", "x")
        if how == "redact":
            without_mail = F.regexp_replace(v, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "<email>")
            return F.regexp_replace(without_mail, r"\+?[0-9]{7,15}", "<phone>")
        raise ValueError(f"unknown masking: {how}")
    return df.withColumns({c: masked(c) for c in cols})


def column_insights(df: DataFrame) -> DataFrame:
    """Role, score, semantic type, transforms and issues per column."""
    facts = interpretability(df).select("column_name", "role", "transforms", "issues")
    return (facts.join(F.broadcast(semantic_types(df).select("column_name", "semantic_type")), "column_name")
            .withColumn("score", at_least(100.0 - 10.0 * F.col("issues"), 0.0)))
