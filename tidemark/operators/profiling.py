"""Profiles: overview, per-column statistics, roles, suggestions and chart data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions import patterns as fixed
from tidemark.functions.arithmetic import (at_least, corrected_skew, kolmogorov_p, normality_p, percent, ratio)
from tidemark.functions.kinds import (datetime_columns, display_type, is_missing, kind_column, kind_of, number,
                                      numeric_columns, present, ref, text_columns)
from tidemark.operators.quality import outlier_table
from tidemark.plans.counts import column_summary, duplicate_count, modes, top_values, value_counts
from tidemark.plans.ranks import numeric_counts, numeric_values, quantiles, running
from tidemark.plans.stats import beside, missing_counts, moments, per_column

FIXED_WIDTH = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4,
               "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def _map_literal(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _one_row_per_column(rows: DataFrame) -> DataFrame:
    """Results with one row per schema column are bounded by the schema; safe to broadcast."""
    return F.broadcast(rows)


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, logical bytes."""
    def width(f):
        if f.dataType.simpleString() in FIXED_WIDTH:
            return F.lit(FIXED_WIDTH[f.dataType.simpleString()])
        text = ref(f.name) if f.dataType.simpleString() == "string" else F.to_json(F.struct(ref(f.name)))
        return F.coalesce(F.octet_length(text), F.lit(0))

    cells = sum([is_missing(df, c).cast("long") for c in df.columns], F.lit(0).cast("long"))
    size = sum([width(f).cast("long") for f in df.schema.fields], F.lit(0).cast("long"))
    scan = df.agg(F.coalesce(F.sum(cells), F.lit(0)).alias("missing_cells"),
                  F.coalesce(F.sum(size), F.lit(0)).alias("logical_bytes"))
    return beside(duplicate_count(df), scan).withColumn("column_count", F.lit(len(df.columns)).cast("long"))


def samples(df: DataFrame, n: int = 3, cols: Sequence[str] | None = None) -> DataFrame:
    """Up to ``n`` distinct sample values per column, in ascending text order."""
    counted = value_counts(df, cols)
    order = Window.partitionBy("column_name").orderBy("value")
    return (counted.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
            .select("column_name", "position", "value"))


def first_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def column_table(df: DataFrame) -> DataFrame:
    """Type, display type, missing percent, score and distinct count per column."""
    types = _map_literal({f.name: f.dataType.simpleString() for f in df.schema.fields})
    shown = _map_literal({f.name: display_type(f.dataType) for f in df.schema.fields})
    pct = percent(F.col("missing"), F.col("row_count"))
    return column_summary(df).select(
        "column_name", types[F.col("column_name")].alias("data_type"),
        shown[F.col("column_name")].alias("display_type"), "missing", F.round(pct, 2).alias("missing_pct"),
        F.round(F.least(F.lit(100.0), at_least(100.0 - 0.8 * pct, 0.0)), 1).alias("score"), "distinct_count")


def _column_prints(df: DataFrame) -> dict[str, tuple]:
    """An order-free fingerprint per column: columns equal on every row have equal ones."""
    def plain(f):
        return ref(f.name) + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else ref(f.name)

    row = F.xxhash64(*[plain(f) for f in df.schema.fields])
    shaped = df.select(row.alias("_row"), *[plain(f).alias(f"_c{i}") for i, f in enumerate(df.schema.fields)])
    # The place of a value counts through its row's hash; null is hashed as such.
    cells = [F.xxhash64("_row", F.col(f"_c{c}").isNull(), f"_c{c}") for c in range(len(df.columns))]
    facts = shaped.agg(*[x for c, h in enumerate(cells) for x in (F.bit_xor(h).alias(f"x{c}"), F.sum(h.bitwiseAND(F.lit((1 << 24) - 1))).alias(f"s{c}"))]).first()
    return {name: (facts[f"x{c}"], facts[f"s{c}"]) for c, name in enumerate(df.columns)}


def duplicate_columns(df: DataFrame, batch: int = 200) -> DataFrame:
    """Pairs of same-type columns that are equal on every row (null equals null).

    One scan gives a fingerprint per column; pairs with equal ones are then compared value
    by value, ``batch`` of them in an aggregation. The work is linear in the columns and
    in the pairs returned. Columns that hold maps are left out.
    """
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    df = df.select(*[ref(c) for c in hashable])
    empty = df.sparkSession.createDataFrame([], "left_column string, right_column string")
    if len(hashable) < 2:
        return empty
    prints = _column_prints(df)
    alike: dict[tuple, list[str]] = {}
    for f in df.schema.fields:
        alike.setdefault((f.dataType.simpleString(), prints[f.name]), []).append(f.name)
    pairs = [(a, b) for names in alike.values() for i, a in enumerate(names) for b in names[i + 1:]]
    out = empty
    for start in range(0, len(pairs), batch):
        some = pairs[start:start + batch]
        wide = df.agg(*[F.bool_and(ref(a).eqNullSafe(ref(b))).alias(f"p{i}") for i, (a, b) in enumerate(some)])
        rows = [F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"p{i}").alias("same"))
                for i, (a, b) in enumerate(some)]
        out = out.unionByName(wide.select(F.inline(F.array(*rows))).filter("same").drop("same"))
    return out


def numeric_profile(df: DataFrame) -> DataFrame:
    """Range, centre, spread, population shape, zeros and negatives per numeric column."""
    middle = quantiles(df, [0.5], ["median"])
    return (moments(df).join(_one_row_per_column(middle), "column_name", "left")
            .select("column_name", "row_count", "valid", "minimum", "maximum", "mean", "median", "std",
                    F.col("skew_pop").alias("skewness"), F.col("kurtosis_pop").alias("kurtosis"),
                    "zeros", "negatives"))


def text_profile(df: DataFrame) -> DataFrame:
    """Lengths, empties, digits and special characters per text column."""
    v = lambda c: ref(c).cast("string")
    return per_column(df, text_columns(df), {
        "valid": lambda c: F.count(v(c)),
        "avg_length": lambda c: F.avg(F.length(v(c))),
        "max_length": lambda c: F.max(F.length(v(c))).cast("long"),
        "min_length": lambda c: F.min(F.length(v(c))).cast("long"),
        "empty": lambda c: F.count_if(v(c) == ""),
        "with_digit": lambda c: F.count_if(v(c).rlike("[0-9]")),
        "with_special": lambda c: F.count_if(v(c).rlike(r"[^a-zA-Z0-9\s]")),
    })


def top_text(df: DataFrame, k: int = 5, cols: Sequence[str] | None = None) -> DataFrame:
    """The k most common values per text column; ties in value order."""
    cols = list(cols if cols is not None else text_columns(df))
    return top_values(value_counts(df, cols), k).select("column_name", "position", "value", "n")


def categorical_profile(df: DataFrame) -> DataFrame:
    """Distinct count, most and least frequent value and cardinality label per text column."""
    cols = text_columns(df)
    rows = _one_row_per_column(missing_counts(df, cols).select("column_name", "row_count"))
    return (modes(value_counts(df, cols)).join(rows, "column_name")
            .withColumn("cardinality", F.when(ratio(F.col("distinct_count"), F.col("row_count")) > 0.5, "high")
                        .otherwise("low")))


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, std, min, exact quartiles, max."""
    quart = quantiles(df, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return (moments(df).join(_one_row_per_column(quart), "column_name", "left")
            .select("column_name", "valid", "mean", "std", "minimum", "q25", "q50", "q75", "maximum"))


def datetime_profile(df: DataFrame) -> DataFrame:
    """First and last moment, span in days, most common year and month per datetime column."""
    cols = datetime_columns(df)
    span = per_column(df, cols, {
        "valid": lambda c: F.count(ref(c)),
        "first": lambda c: F.min(ref(c).cast("timestamp_ntz")),
        "last": lambda c: F.max(ref(c).cast("timestamp_ntz")),
    }).withColumn("range_days", F.floor((F.unix_timestamp(F.col("last").cast("timestamp"))
                                         - F.unix_timestamp(F.col("first").cast("timestamp"))) / 86400))
    for part in ("year", "month"):
        counted = value_counts(df.select(*[getattr(F, part)(ref(c)).alias(c) for c in cols]), cols)
        top = counted.withColumn("value", F.col("value").cast("long")).groupBy("column_name").agg(
            F.min_by("value", F.struct((-F.col("n")).alias("neg"), "value")).alias(f"common_{part}"))
        span = span.join(_one_row_per_column(top), "column_name", "left")
    return span


def weekday_counts(df: DataFrame) -> DataFrame:
    """Rows per weekday (Monday is 0) of every datetime column."""
    cols = datetime_columns(df)
    counted = value_counts(df.select(*[F.weekday(ref(c)).alias(c) for c in cols]), cols)
    return counted.select("column_name", F.col("value").cast("long").alias("weekday"), "n")


def shape(df: DataFrame) -> DataFrame:
    """Population skewness, excess kurtosis and the normality p-value."""
    return moments(df).select(
        "column_name", "valid", F.col("skew_pop").alias("skewness"), F.col("kurtosis_pop").alias("kurtosis"),
        normality_p(F.col("valid"), F.col("skew_pop"), F.col("kurtosis_pop")).alias("normal_p"))


def uniform_ks(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One-sample KS distance from the uniform law on 0..1, per numeric column."""
    ranked = running(numeric_counts(df, cols), ["column_name"], "value", ["n"])
    cdf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value")))
    above = ratio(F.col("n_upto"), F.col("n_total")) - cdf
    below = cdf - ratio(F.col("n_upto") - F.col("n"), F.col("n_total"))
    return (ranked.groupBy("column_name")
            .agg(F.max(F.greatest(above, below)).alias("uniform_d"), F.max("n_total").alias("valid"))
            .withColumn("uniform_p", kolmogorov_p(F.col("uniform_d"), F.col("valid"))))


def distribution_label(df: DataFrame) -> DataFrame:
    """Two labels: by tests (normal, uniform, skewed) and by corrected skewness."""
    facts = shape(df).join(_one_row_per_column(uniform_ks(df).drop("valid")), "column_name", "left")
    skew = corrected_skew(F.col("valid"), F.col("skewness"))
    by_test = (F.when(F.col("valid") < 10, "insufficient_data").when(F.col("normal_p") > 0.05, "normal")
               .when(F.col("uniform_p") > 0.05, "uniform").when(F.abs("skewness") > 1, "skewed").otherwise("unknown"))
    by_skew = (F.when(F.abs(skew) < 0.5, "normal").when(skew > 1, "right_skewed")
               .when(skew < -1, "left_skewed").otherwise("slightly_skewed"))
    return facts.select("column_name", "valid", by_test.alias("label_by_test"), by_skew.alias("label_by_skew"))


def hierarchies(df: DataFrame) -> DataFrame:
    """Text columns with path-like separators, with the smallest example."""
    hit = lambda c: ref(c).cast("string").rlike(fixed.HIERARCHY)
    return per_column(df, text_columns(df), {
        "matches": lambda c: F.count_if(hit(c)),
        "example": lambda c: F.min(F.when(hit(c), ref(c).cast("string"))),
    }).filter("matches > 0").drop("row_count")


def foreign_keys(df: DataFrame, name_pattern: str = r"(_id$)|(^id_)") -> DataFrame:
    """Columns named like a reference whose distinct ratio lies strictly within 0.1..0.9."""
    facts = column_summary(df).withColumn("unique_ratio", ratio(F.col("distinct_count"), F.col("row_count")))
    return (facts.filter(F.lower("column_name").rlike(name_pattern))
            .filter((F.col("unique_ratio") > 0.1) & (F.col("unique_ratio") < 0.9))
            .select("column_name", "unique_ratio"))


def column_roles(df: DataFrame) -> DataFrame:
    """Role per column: name keywords first, then distinct ratio and kind."""
    by_name = {}
    for f in df.schema.fields:
        low = f.name.lower()
        by_name[f.name] = next((role for role, words in fixed.ROLE_KEYWORDS.items() if any(w in low for w in words)), "")
    named = F.nullif(_map_literal(by_name)[F.col("column_name")], F.lit(""))
    share = ratio(F.col("distinct_count"), F.col("row_count"))
    kind = kind_column(df)
    by_data = (F.when(share > 0.95, "id").when(kind == "numeric", "numerical")
               .when((kind == "text") & (share < 0.1), "categorical").when(kind == "text", "text")
               .when(kind == "datetime", "timestamp").otherwise("feature"))
    return column_summary(df).select(
        "column_name", "row_count", "distinct_count", (share * 100.0).alias("unique_pct"),
        F.coalesce(named, by_data).alias("role"))


def transform_suggestions(df: DataFrame) -> DataFrame:
    """Transforms suggested by range, skewness and cardinality, one row each."""
    parts = []
    if numeric_columns(df):
        m = moments(df)
        spread = F.try_divide(F.col("maximum"), F.col("minimum"))
        wide = (F.col("minimum") >= 0) & (F.coalesce(spread, F.when(F.col("maximum") > 0, F.lit(float("inf")))) > 10)
        parts.append(m.filter(wide).select("column_name", F.lit("log_transform").alias("suggestion")))
        parts.append(m.filter(F.abs("skew_pop") > 1).select("column_name", F.lit("normalization").alias("suggestion")))
    if text_columns(df):
        s = column_summary(df, text_columns(df))
        many = ratio(F.col("distinct_count"), F.col("row_count")) > 0.5
        parts.append(s.select("column_name", F.when(many, "text_encoding").otherwise("label_encoding").alias("suggestion")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prep_suggestions(df: DataFrame, issues: DataFrame, limit: int | None = None) -> DataFrame:
    """Every suggestion with its category and priority; with ``limit`` the first so many by priority.

    ``issues`` are the rows of ``quality.scan_quality``.
    """
    pick = ["category", "priority", "column_name", "suggestion"]
    lit = lambda c, p: [F.lit(c).alias("category"), F.lit(p).alias("priority")]
    parts = [issues.select(F.lit("data_quality").alias("category"),
                           F.when(F.col("severity") == "high", "high").otherwise("medium").alias("priority"),
                           "column_name", F.col("suggested_fix").alias("suggestion")),
             transform_suggestions(df).select(*lit("transformation", "medium"), "column_name", "suggestion")]
    if text_columns(df):
        few = F.when(F.col("distinct_count") < 10, "one_hot_encoding").otherwise("target_encoding")
        parts.append(column_summary(df, text_columns(df)).select(*lit("encoding", "medium"), "column_name", few.alias("suggestion")))
    nums = numeric_columns(df)
    if nums:
        how = F.when(F.col("std") > F.col("mean"), "standard_scaling").when(F.col("minimum") >= 0, "min_max_scaling")
        parts.append(moments(df).select(*lit("scaling", "medium"), "column_name", how.alias("suggestion"))
                     .filter("suggestion is not null"))
    if len(nums) > 1:
        made = [(f"{a}*{b}", "interaction_feature") for i, a in enumerate(nums) for b in nums[i + 1:]]
        made += [(f"{a}^2", "polynomial_feature") for a in nums]
        rows = df.sparkSession.createDataFrame(made, "column_name string, suggestion string")
        parts.append(rows.select(*lit("feature_engineering", "medium"), "column_name", "suggestion"))
    out = parts[0].select(*pick)
    for part in parts[1:]:
        out = out.unionByName(part.select(*pick))
    rank = F.when(F.col("priority") == "high", 0).otherwise(1)
    ordered = out.orderBy(rank, "category", "column_name", "suggestion")
    return ordered if limit is None else ordered.limit(limit)


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins from min to max per (by, column); the top edge falls in the last bin.

    Rows are put into their bins before the shuffle: one pass for the range, one
    for the bins, and only a row per bin and task is exchanged.
    """
    rows = numeric_values(df, cols, by)
    keys = [*by, "column_name"]
    edges = rows.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"),
                                    F.count(F.lit(1)).alias("total"))
    # constant columns use a unit-wide range around the value
    edges = (edges.withColumn("flat", F.col("low") == F.col("high"))
             .withColumn("low", F.when(F.col("flat"), F.col("low") - 0.5).otherwise(F.col("low")))
             .withColumn("high", F.when(F.col("flat"), F.col("high") + 0.5).otherwise(F.col("high"))).drop("flat"))
    bin_of = F.least(F.floor((F.col("value") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))
    return (rows.join(F.broadcast(edges), keys)  # one row per column (and period)
            .groupBy(*keys, "low", "high", "total", bin_of.cast("long").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("density", ratio(F.col("n") * bins, F.col("total") * (F.col("high") - F.col("low")))))


def chart_data(df: DataFrame) -> DataFrame:
    """Bars without images: missing per column, columns per type, role and distinct count."""
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column_name string, label string")
    per_type = types.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("chart", F.lit("types"))
    per_role = (column_roles(df).groupBy(F.col("role").alias("label")).agg(F.count(F.lit(1)).alias("n"))
                .withColumn("chart", F.lit("roles")))
    summary = column_summary(df)
    gaps = summary.filter("missing > 0").select(F.lit("missing").alias("chart"), F.col("column_name").alias("label"),
                                                F.col("missing").alias("n"))
    distinct = summary.select(F.lit("distinct").alias("chart"), F.col("column_name").alias("label"),
                              F.col("distinct_count").alias("n"))
    return gaps.unionByName(per_type).unionByName(per_role).unionByName(distinct).select("chart", "label", "n")


def scatter_sample(df: DataFrame, x: str, y: str, key: str, points: int = 1000) -> DataFrame:
    """A sampling operator: the ``points`` rows with the smallest key hash."""
    draw = F.conv(F.substring(F.md5(ref(key).cast("string")), 1, 8), 16, 10).cast("long")
    return (df.filter(present(df, x).isNotNull() & present(df, y).isNotNull())
            .select(ref(key), number(df, x).alias("x"), number(df, y).alias("y"), draw.alias("draw"))
            .orderBy("draw", ref(key)).limit(points).drop("draw"))


def kinds_of_columns(df: DataFrame) -> DataFrame:
    """Column name, kind and Spark type from the schema, and how many rows fill the column."""
    rows = [(f.name, kind_of(f.dataType), f.dataType.simpleString()) for f in df.schema.fields]
    kinds = df.sparkSession.createDataFrame(rows, "column_name string, kind string, data_type string")
    filled = missing_counts(df).select("column_name", (F.col("row_count") - F.col("missing")).alias("filled"))
    return kinds.join(F.broadcast(filled), "column_name")  # one row per column
