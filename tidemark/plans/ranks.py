"""Exact ranks, quantiles and running sums without a single-partition sort.

Values are grouped first, then each key's value range is split at cut points and
the running sum is taken inside a bucket; bucket totals, which are small, supply
the offsets. The cut points are the values with the smallest hash, so they are an
even random sample of the distinct values, as many as the data's size asks for up
to a bound per key, and the same on every evaluation. The result does not depend on them.

Quantiles read the table twice and shuffle almost nothing: a mergeable sketch brackets
each wanted rank, then values inside a bracket are counted one by one and the rest only
as the mass between brackets. The counts prove that the ranks lie inside; a bracket that
missed is widened to the whole range.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.kinds import number, numeric_columns, ref
from tidemark.plans.sizing import estimated_bytes, fits
from tidemark.session import settle

BUCKETS = 256
#: Most pieces: Spark keeps a ranking of up to this many rows per task ahead of its shuffle.
MOST_BUCKETS = 1000
PIECE_BYTES = 64 << 20
STEP = 16
#: Relative rank error of the sketch is 1 / ACCURACY; brackets reach twice as far.
ACCURACY = 2000
#: Up to this many values of a column are all inside.
FEW_VALUES = 10_000
#: Up to this many grouped values are ranked by one window per key.
WINDOW_ROWS = 1_000_000


def pieces_for(df: DataFrame) -> int:
    """Pieces for this much data by Catalyst's estimate; no job, and no effect on results."""
    return min(MOST_BUCKETS, max(BUCKETS, estimated_bytes(df) // PIECE_BYTES))


def cut_points(counted: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """(keys..., _cuts): at most ``buckets`` sorted values per key, or for the whole frame without keys.

    ``_cuts.every`` repeats each STEP-th value, so that a lookup takes two short scans.
    """
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.xxhash64(value), F.col(value))
        picked = counted.select(*keys, value, F.row_number().over(order).alias("_r")).filter(F.col("_r") <= buckets)
    else:
        picked = counted.orderBy(F.xxhash64(value), F.col(value)).limit(buckets)
    cuts = picked.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_all"))
    every = F.filter("_all", lambda c, at: at % STEP == 0)
    return cuts.select(*keys, F.struct(F.col("_all").alias("all"), every.alias("every")).alias("_cuts"))


def with_bucket(df: DataFrame, cuts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``_bucket``: the number of cut points at or below the value."""
    if keys:
        # at most BUCKETS values for each key, and keys are column names or periods
        both = df.join(F.broadcast(cuts), list(keys))
    else:
        both = df.withColumn("_cuts", cuts.scalar())
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col(value)))
    both = both.withColumn("_coarse", below(F.col("_cuts.every")))
    start = (F.col("_coarse") - 1) * STEP
    fine = below(F.slice(F.col("_cuts.all"), start + 1, F.lit(STEP)))
    bucket = F.when(F.col("_coarse") == 0, 0).otherwise(start + fine)
    return both.withColumn("_bucket", bucket).drop("_cuts", "_coarse")


def running(counted: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str],
            buckets: int | None = None) -> DataFrame:
    """Adds ``<m>_upto`` (inclusive running sum by value) and ``<m>_total`` per key.

    ``counted`` holds one row per (keys, value); ``keys`` must be few (column
    names, periods) and may be empty.
    """
    keys = list(keys)
    placed = with_bucket(counted, cut_points(counted, keys, value, buckets or pieces_for(counted)), keys, value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_before") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures])
    summed = placed.select("*", *[F.sum(m).over(inside).alias(f"{m}_inside") for m in measures])
    out = summed.join(F.broadcast(offsets), keys + ["_bucket"])
    for m in measures:
        out = out.withColumn(f"{m}_upto", F.col(f"{m}_inside") + F.col(f"{m}_before"))
    return out.drop("_bucket", *[f"{m}_{x}" for m in measures for x in ("inside", "before")])


def at_ranks(counted: DataFrame, keys: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]],
             buckets: int | None = None, small: bool = False) -> DataFrame:
    """(keys..., _total, names...): the value at each place (a 0-based rank made from the total), null when out of range.

    Bucket totals tell which bucket holds a place; only the values of those buckets
    are sorted, at most two per hundred at the usual number of places. ``small`` says
    that ``counted`` has few rows, which one window per key can rank.
    """
    keys = list(keys)
    if small:
        order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        near = counted.withColumn("_upto", F.sum("n").over(order)).withColumn("_total", F.sum("n").over(Window.partitionBy(*keys)))
        return near.groupBy(*keys).agg(F.max("_total").alias("_total"), *[
            F.min(F.when(F.col("_upto") > make(F.col("_total")), F.col(value))).alias(name) for name, make in places.items()])
    placed = with_bucket(counted, cut_points(counted, keys, value, buckets or pieces_for(counted)), keys, value)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_n")).select(
        *keys, "_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    ranks = {name: make(F.col("_total")) for name, make in places.items()}
    holds = [(rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n")) for rank in ranks.values()]
    wanted = totals.filter(functools.reduce(lambda x, y: x | y, holds)).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # at most one bucket for each key and place
    near = placed.join(F.broadcast(wanted), keys + ["_bucket"]).withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
    return near.groupBy(*keys).agg(F.max("_total").alias("_total"), *[
        F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(name) for name, rank in ranks.items()])


def numeric_values(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, value double): one row per present value."""
    cols = list(cols if cols is not None else [c for c in numeric_columns(df) if c not in by])
    shaped = df.select(*[ref(b) for b in by], *[(number(df, c) + F.lit(0.0)).alias(c) for c in cols])
    rows = shaped.unpivot([ref(b) for b in by], [ref(c) for c in cols], "column_name", "value")
    return rows.filter(F.col("value").isNotNull())


def numeric_counts(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, value double, n) over the present values."""
    return numeric_values(df, cols, by).groupBy(*[ref(b) for b in by], "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def quantiles_of_counts(counted: DataFrame, probs: Sequence[float], keys: Sequence[str],
                        names: Sequence[str], small: bool = False) -> DataFrame:
    """Linear-interpolation quantiles per key from grouped values."""
    place = lambda p, total: F.lit(float(p)) * (total - 1)
    places = {}
    for i, p in enumerate(probs):
        places[f"_lo{i}"] = lambda total, p=p: F.floor(place(p, total))
        places[f"_hi{i}"] = lambda total, p=p: F.ceil(place(p, total))
    found = at_ranks(counted, keys, "value", places, small=small)
    share = lambda p: place(p, F.col("_total")) - F.floor(place(p, F.col("_total")))
    pick = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share(p)).alias(nm)
            for i, (p, nm) in enumerate(zip(probs, names))]
    return found.select(*keys, *pick)


def _intervals(total: int, least: float, most: float, points: Sequence[float]) -> list[list[float]]:
    """Disjoint closed brackets from the sketch's values for each wanted place, two per place."""
    if total <= FEW_VALUES:
        return [[least, most]]
    out: list[list[float]] = []
    for low, high in sorted(zip(points[::2], points[1::2])):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _inside(shaped: DataFrame, by: Sequence[str], cols: Sequence[str], edges: dict) -> DataFrame:
    """(by..., column_name, _segment, value, n): values in brackets have odd segments; each even one is a single row with its least value."""
    def segment(v, lows, highs):
        steps = [F.coalesce((v >= x).cast("int"), F.lit(0)) for x in lows] + [F.coalesce((v > x).cast("int"), F.lit(0)) for x in highs]
        return functools.reduce(lambda a, b: a + b, steps)

    if by:
        most = max((len(x) for row in edges.values() for x in row), default=0) or 1
        fields = [shaped.schema[b] for b in by] + [T.StructField(f"_e{i}", T.ArrayType(T.ArrayType(T.DoubleType()))) for i in range(len(cols))]
        table = shaped.sparkSession.createDataFrame([(*key, *row) for key, row in edges.items()], T.StructType(fields))
        table = table.select(*[ref(b).alias(f"_by{i}") for i, b in enumerate(by)], *[f"_e{i}" for i in range(len(cols))])
        same = functools.reduce(lambda x, y: x & y, [ref(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
        shaped = shaped.join(F.broadcast(table), same)  # one row per group: periods and the like
        ends = [([F.get(F.get(f"_e{i}", F.lit(j)), F.lit(0)) for j in range(most)], [F.get(F.get(f"_e{i}", F.lit(j)), F.lit(1)) for j in range(most)])
                for i in range(len(cols))]
    else:
        ends = [([F.lit(a) for a, _ in row], [F.lit(b) for _, b in row]) for row in edges[()]]
    cells = [F.struct((segment(F.col(f"_v{i}"), *ends[i]) if ends[i][0] else F.lit(0)).alias("s"), F.col(f"_v{i}").alias("v")).alias(c)
             for i, c in enumerate(cols)]
    rows = shaped.select(*[ref(b) for b in by], *cells).unpivot([ref(b) for b in by], [ref(c) for c in cols], "column_name", "_cell")
    rows = rows.filter("_cell.v IS NOT NULL")
    return (rows.groupBy(*[ref(b) for b in by], "column_name", F.col("_cell.s").alias("_segment"),
                         F.when(F.col("_cell.s") % 2 == 1, F.col("_cell.v")).alias("_one"))
            .agg(F.min("_cell.v").alias("value"), F.count(F.lit(1)).alias("n")).drop("_one"))


def bracketed(df: DataFrame, probs: Sequence[float], cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, value, n): grouped values that have the quantiles of the whole, settled.

    Values away from the wanted ranks are folded into one row between two brackets.
    """
    shaped = df.select(*[ref(b) for b in by], *[(number(df, c) + F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(cols)])
    reach = 2.0 / ACCURACY
    points = [x for p in probs for x in (max(0.0, p - reach), min(1.0, p + reach))]
    rows = shaped.groupBy(*[ref(b) for b in by]).agg(*[x for i in range(len(cols)) for x in (
        F.count(f"_v{i}").alias(f"_n{i}"), F.min(f"_v{i}").alias(f"_least{i}"), F.max(f"_v{i}").alias(f"_most{i}"),
        F.percentile_approx(f"_v{i}", points, ACCURACY).alias(f"_p{i}"))]).collect()
    totals, edges = {}, {}
    for row in rows:
        key = tuple(row[b] for b in by)
        edges[key] = []
        for i, c in enumerate(cols):
            n, least, most = row[f"_n{i}"], row[f"_least{i}"], row[f"_most{i}"]
            totals[(*key, c)] = n, least, most
            found = [least if at <= 0 else most if at >= 1 else x for at, x in zip(points, row[f"_p{i}"] or [])]
            edges[key].append(_intervals(n, least, most, found) if n else [])
    while True:
        settled = settle(_inside(shaped, by, cols, edges), "brackets")
        missed = _missed(settled, probs, cols, by, totals)
        if not missed:
            return settled.drop("_segment")
        for *key, c in missed:
            edges[tuple(key)][cols.index(c)] = [list(totals[(*key, c)][1:])]


def _missed(settled: DataFrame, probs: Sequence[float], cols: Sequence[str], by: Sequence[str], totals: dict) -> list[tuple]:
    """The (by..., column) whose wanted ranks are not all inside a bracket, by the rows counted per segment."""
    mass: dict[tuple, list] = {}
    for r in settled.groupBy(*[ref(b) for b in by], "column_name", "_segment").agg(F.sum("n").alias("n")).collect():
        mass.setdefault((*(r[b] for b in by), r.column_name), []).append((r["_segment"], r.n))
    out = []
    for key, parts in mass.items():
        total, held, before = sum(n for _, n in parts), [], 0
        for segment, n in sorted(parts):
            if segment % 2:
                held.append((before, before + n))
            before += n
        ranks = {x for p in probs for x in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))}
        if not all(any(a <= x < b for a, b in held) for x in ranks):
            out.append(key)
    return out


def quantiles(df: DataFrame, probs: Sequence[float], names: Sequence[str], cols: Sequence[str] | None = None,
              by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, names...): exact quantiles of every numeric column. Reads ``df`` twice when called."""
    cols = list(cols if cols is not None else [c for c in numeric_columns(df) if c not in by])
    if not cols:
        return quantiles_of_counts(numeric_counts(df, cols, by), probs, [*by, "column_name"], names)
    counted = bracketed(df, probs, cols, by)
    return quantiles_of_counts(counted, probs, [*by, "column_name"], names, small=fits(counted, WINDOW_ROWS))
