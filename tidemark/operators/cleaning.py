"""Cleaning and feature transforms.

Transforms that need statistics come in two steps, like Spark ML estimators: a
``fit_*`` that returns a small plain object (at most a few numbers per column),
and an apply step that is a projection with literals and adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.arithmetic import ratio
from tidemark.functions.kinds import is_missing, kind_of, number, numeric_columns, present, ref
from tidemark.operators.quality import outlier_table
from tidemark.plans.counts import modes, value_counts
from tidemark.plans.ranks import cut_points, quantiles, running, with_bucket
from tidemark.plans.sizing import broadcast_if_small
from tidemark.plans.stats import moments

ONE_HOT_LIMIT = 10


def select_checked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column selection that names what is missing and what exists."""
    lost = [c for c in cols if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns {lost}; available: {df.columns}")
    return df.select(*[ref(c) for c in cols])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(~is_missing(df, target))


def fit_imputer(df: DataFrame, cols: Sequence[str] | None = None, default: str = "missing") -> dict:
    """Median per numeric column, mode per other column; ``default`` where there is no mode."""
    cols = list(cols if cols is not None else df.columns)
    nums = [c for c in cols if kind_of(df.schema[c].dataType) == "numeric"]
    rest = [c for c in cols if c not in nums]
    fills: dict = {}
    if nums:
        fills.update({row.column_name: row.median for row in quantiles(df, [0.5], ["median"], nums).collect()})
    if rest:
        top = modes(value_counts(df, rest)).select("column_name", "most_frequent").collect()
        fills.update({c: default for c in rest})
        fills.update({row.column_name: row.most_frequent for row in top})
    return fills


def impute(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Numeric columns become double, as a median may fall between two integers."""
    def filled(c):
        if kind_of(df.schema[c].dataType) == "numeric":
            return F.coalesce(number(df, c), F.lit(fills[c]).cast("double"))
        return F.coalesce(ref(c), F.lit(fills[c]).cast(df.schema[c].dataType))
    return df.withColumns({c: filled(c) for c in fills if c in df.columns})


def fill_for_scoring(df: DataFrame) -> DataFrame:
    """Numeric gaps become 0, text gaps become 'missing'."""
    return df.fillna(0).fillna("missing")


def ffill(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Carry the last present value forward within each key.

    ``order`` must be unique within a key. Each key's rows are split along the
    first order column at global cut points, filled inside a piece, and the last
    value of earlier pieces is carried over, so no key is handled by a single task.
    """
    first = order[0]
    keys = list(keys)
    base = df if keys else df.withColumn("_all", F.lit(1))
    cuts = cut_points(df.filter(ref(first).isNotNull()).select(ref(first)).distinct(), [], first)
    placed = with_bucket(base.filter(ref(first).isNotNull()), cuts, [], first)
    loose = base.filter(ref(first).isNull()).withColumn("_bucket", F.lit(-1))
    placed = placed.unionByName(loose)
    keys = keys or ["_all"]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*[ref(o) for o in order])
    last = placed.groupBy(*keys, "_bucket").agg(
        *[F.max_by(present(df, c), F.when(~is_missing(df, c), at)).alias(f"_last_{c}") for c in cols])
    carried = last.select(*keys, "_bucket",
                          *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in cols])
    filled = placed.withColumns({c: F.last(present(df, c), ignorenulls=True).over(inside) for c in cols})
    out = filled.join(carried, keys + ["_bucket"])
    return out.withColumns({c: F.coalesce(ref(c), F.col(f"_carry_{c}")) for c in cols}).select(*[ref(c) for c in df.columns])


def standardize_case(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.lower(ref(col)))


def to_datetime(df: DataFrame, col: str, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy")) -> DataFrame:
    """First format that parses; otherwise null."""
    return df.withColumn(col, F.coalesce(*[F.try_to_timestamp(ref(col), F.lit(f)) for f in formats]))


def to_number(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.replace(ref(col), F.lit(","), F.lit("")).try_cast("double"))


def fit_iqr(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    return {r.column_name: (r.lower_bound, r.upper_bound) for r in outlier_table(df, cols).collect()}


def iqr_filter(df: DataFrame, bounds: Mapping[str, tuple[float, float]], mode: str = "drop") -> DataFrame:
    """Drop rows outside the bounds, or cap values at them. Missing values stay."""
    if mode == "cap":
        def capped(c, lo, hi):
            return F.when(~is_missing(df, c), F.greatest(F.lit(lo), F.least(F.lit(hi), number(df, c))))
        return df.withColumns({c: capped(c, lo, hi) for c, (lo, hi) in bounds.items()})
    keep = F.lit(True)
    for c, (lo, hi) in bounds.items():
        keep = keep & F.coalesce(number(df, c).between(lo, hi), F.lit(True))
    return df.filter(keep)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def log_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(number(df, c) > -1, F.log1p(number(df, c))) for c in cols})


def fit_scaler(df: DataFrame, cols: Sequence[str], how: str = "standard") -> dict[str, tuple[float, float]]:
    """(offset, width) per column: mean and population std, or min and range."""
    rows = moments(df, cols).collect()
    if how == "standard":
        pairs = {r.column_name: (r.mean, r.std_pop) for r in rows}
    elif how == "minmax":
        pairs = {r.column_name: (r.minimum, r.maximum - r.minimum) for r in rows}
    else:
        raise ValueError(f"unknown scaling: {how}")
    return {c: (offset, width or 1.0) for c, (offset, width) in pairs.items()}


def scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (number(df, c) - F.lit(o)) / F.lit(w) for c, (o, w) in fitted.items()})


def transform(df: DataFrame, exprs: Sequence[str] = (), where: str | None = None, preview: int | None = None) -> DataFrame:
    """User-given Spark SQL expressions, with an optional filter and a preview of n rows."""
    out = df.filter(where) if where else df
    out = out.selectExpr(*exprs) if exprs else out
    return out.limit(preview) if preview else out


def fit_one_hot(df: DataFrame, cols: Sequence[str], limit: int = ONE_HOT_LIMIT) -> dict[str, list[str]]:
    """Sorted categories per column; more than ``limit`` is an error."""
    fitted = {}
    for c in cols:
        rows = value_counts(df, [c]).select("value").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{c} has more than {limit} categories")
        fitted[c] = sorted(row.value for row in rows)
    return fitted


def one_hot(df: DataFrame, fitted: Mapping[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per fitted category plus ``_nan``; unseen values are all zeros."""
    flags = {}
    for c, values in fitted.items():
        for v in values:
            flags[f"{c}_{v}"] = F.coalesce((ref(c).cast("string") == v).cast("int"), F.lit(0))
        flags[f"{c}_nan"] = ref(c).isNull().cast("int")
    return df.withColumns(flags).drop(*fitted)


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): codes 0.. in text order, numbered without a global sort."""
    values = (df.select(ref(col).cast("string").alias("value")).filter("value is not null").distinct()
              .select("value", F.lit(1).alias("one")))
    return running(values, [], "value", ["one"]).select("value", (F.col("one_upto") - 1).cast("long").alias("code"))


def label_encode(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """Replace ``col`` by its code; a value without one becomes 0.

    The code table is broadcast when counted small; a larger one is joined by
    key, where AQE splits partitions that hold a hot value.
    """
    table = broadcast_if_small(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
    joined = df.join(table, ref(col).cast("string") == F.col("_value"), "left")
    return joined.withColumn(col, F.coalesce("_code", F.lit(0)).cast("long")).drop("_value", "_code")


def key_hash(key: Column) -> Column:
    """0 .. 2^32-1 from the MD5 of a key: a draw that repeats on any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def target_encode(df: DataFrame, col: str, target: str, key: str | None = None, folds: int = 0) -> DataFrame:
    """Adds ``<col>_target``: the mean target of the value.

    With ``folds`` each row uses the other folds only; a value seen in one fold
    falls back to the mean of the other folds.
    """
    name = f"{col}_target"
    y = number(df, target)
    if not folds:
        means = df.groupBy(ref(col)).agg(F.avg(y).alias(name))
        return df.join(broadcast_if_small(means), col, "left")
    base = df.withColumn("_fold", F.pmod(key_hash(ref(key)), F.lit(folds)))
    parts = base.groupBy(ref(col), "_fold").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    per_value = Window.partitionBy(ref(col))  # at most ``folds`` rows
    fold_rows = base.groupBy("_fold").agg(F.sum(y).alias("_fs"), F.count(y).alias("_fn"))
    whole = Window.partitionBy(F.lit(1))
    others = fold_rows.select("_fold", ((F.sum("_fs").over(whole) - F.col("_fs"))
                                        / (F.sum("_fn").over(whole) - F.col("_fn"))).alias("_rest"))
    rates = (parts.withColumn("_os", F.sum("_s").over(per_value) - F.col("_s"))
             .withColumn("_on", F.sum("_n").over(per_value) - F.col("_n"))
             .join(F.broadcast(others), "_fold")  # one row per fold
             .select(ref(col), "_fold", F.coalesce(ratio(F.col("_os"), F.col("_on")), F.col("_rest")).alias(name)))
    return base.join(broadcast_if_small(rates), [col, "_fold"], "left").drop("_fold")


def make_features(df: DataFrame, products: Sequence[tuple[str, str]] = (), squares: Sequence[str] = (),
                  ratios: Sequence[tuple[str, str]] = (), group_means: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Products, squares, ratios a/(b+1e-8), and means of a by category.

    A group mean is an aggregation joined back, not a window, so a category that
    holds a third of the rows is not sorted in one task.
    """
    new = {f"{a}_x_{b}": number(df, a) * number(df, b) for a, b in products}
    new.update({f"{a}_squared": number(df, a) * number(df, a) for a in squares})
    new.update({f"{a}_to_{b}_ratio": F.try_divide(number(df, a), number(df, b) + 1e-8) for a, b in ratios})
    out = df.withColumns(new) if new else df
    for value, category in group_means:
        means = df.groupBy(ref(category)).agg(F.avg(number(df, value)).alias(f"{value}_mean_by_{category}"))
        out = out.join(broadcast_if_small(means), category, "left")
    return out


def apply_cleaning(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Run the operators named by ``quality.suggest_cleaning``, parsing before filling."""
    steps = [(r.operator, r.column_name) for r in suggestions.select("operator", "column_name").collect()]
    named = lambda op: [c for o, c in steps if o == op]
    out = df
    for c in named("standardize_case"):
        out = standardize_case(out, c)
    for c in named("to_datetime"):
        out = to_datetime(out, c)
    for c in named("to_number"):
        if c not in named("to_datetime"):
            out = to_number(out, c)
    out = out.drop(*named("drop_column"))
    if named("impute"):
        out = impute(out, fit_imputer(out, named("impute")))
    drop_rows = [c for c in named("iqr_filter") if c in out.columns and c in numeric_columns(out)]
    if drop_rows:
        out = iqr_filter(out, fit_iqr(out, drop_rows))
    if named("drop_duplicates"):
        out = drop_duplicates(out)
    return out
