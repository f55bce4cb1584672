"""Drift and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.arithmetic import severity
from tidemark.operators import drift as op
from tidemark.session import scratch_path
from tidemark.sources.sinks import report_rows
from tidemark.streaming import monitors
from workloads.common import LABELLED, each, labelled, longs, r, rounded, table, union

NUMS, TEXTS = ["price", "o_custkey", "gap"], ["status", "priority"]


def periods(s, d):
    """orders split in time; the current part has dearer, partly missing and new values."""
    split = op.split_temporal(table(s, d, "orders"), ["o_orderdate", "o_orderkey"], 0.7)
    cur = F.col("period") == "cur"
    return split.select(
        "period", "o_orderkey", "o_custkey",
        F.when(cur, F.col("o_totalprice") * 1.2).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 11 > F.when(cur, 3).otherwise(0), F.col("o_totalprice")).alias("gap"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("status"),
        F.when(cur & (F.col("o_orderkey") % 3 == 0), "9-NEW").otherwise(F.col("o_orderpriority")).alias("priority"))


PERIODS = """split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.7::double) THEN 'ref' ELSE 'cur' END AS period FROM orders),
 p AS (SELECT period, o_orderkey, o_custkey, CASE WHEN period = 'cur' THEN o_totalprice * 1.2::double ELSE o_totalprice END AS price,
   CASE WHEN o_orderkey % 11 > CASE WHEN period = 'cur' THEN 3 ELSE 0 END THEN o_totalprice END AS gap,
   CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status,
   CASE WHEN period = 'cur' AND o_orderkey % 3 = 0 THEN '9-NEW' ELSE o_orderpriority END AS priority FROM split)"""

KS = f"""nv AS ({each(NUMS, "SELECT '{c}' AS column_name, period, {c}::double AS v FROM p")}),
 ng AS (SELECT column_name, v, count(*) FILTER (WHERE period = 'ref') AS a, count(*) FILTER (WHERE period = 'cur') AS b FROM nv WHERE v IS NOT NULL GROUP BY ALL),
 nr AS (SELECT column_name, sum(a) OVER w / (sum(a) OVER (PARTITION BY column_name))::double AS fa, sum(b) OVER w / (sum(b) OVER (PARTITION BY column_name))::double AS fb,
   sum(a) OVER (PARTITION BY column_name) AS na, sum(b) OVER (PARTITION BY column_name) AS nb FROM ng WINDOW w AS (PARTITION BY column_name ORDER BY v)),
 ks0 AS (SELECT column_name, max(abs(fa - fb)) AS statistic, max(na)::bigint AS ref_size, max(nb)::bigint AS cur_size FROM nr GROUP BY column_name),
 ks1 AS (SELECT *, sqrt(ref_size::double * cur_size / (ref_size + cur_size)) AS e FROM ks0), ks2 AS (SELECT *, (e + 0.12 + 0.11 / e) * statistic AS lam FROM ks1),
 ks AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END AS p_value FROM ks2)"""

CHI = f"""tv AS ({each(TEXTS, "SELECT '{c}' AS column_name, period, {c} AS v FROM p")}),
 tg AS (SELECT column_name, v, count(*) FILTER (WHERE period = 'ref') AS a, count(*) FILTER (WHERE period = 'cur') AS b FROM tv WHERE v IS NOT NULL GROUP BY ALL),
 te AS (SELECT *, (sum(a) OVER w)::double AS ra, (sum(b) OVER w)::double AS rb, count(*) OVER w AS k FROM tg WINDOW w AS (PARTITION BY column_name)),
 tf AS (SELECT column_name, k, a, (a + b) * ra / (ra + rb) AS ea, b, (a + b) * rb / (ra + rb) AS eb FROM te),
 chi AS (SELECT column_name, (max(k) - 1)::bigint AS dof, sum(power(abs(a - ea) - CASE WHEN k = 2 THEN least(0.5, abs(a - ea)) ELSE 0 END, 2) / ea
   + power(abs(b - eb) - CASE WHEN k = 2 THEN least(0.5, abs(b - eb)) ELSE 0 END, 2) / eb) AS statistic, (SELECT count(*) FROM p) AS all_rows FROM tf GROUP BY column_name)"""

PSI_NUM = f"""pv AS ({each(NUMS, "SELECT '{c}' AS column_name, period, {c}::double AS v FROM p")}),
 pe AS (SELECT column_name, min(v) AS low, max(v) AS high FROM pv WHERE period = 'ref' GROUP BY column_name),
 pb AS (SELECT column_name, period, CASE WHEN v IS NULL OR v < low OR v > high THEN 0
   {' '.join(f'WHEN v <= low + (high - low) / 10 * {i} THEN {i}' for i in range(1, 10))} ELSE 10 END AS bin FROM pv JOIN pe USING (column_name)),
 pc AS (SELECT column_name, bin, count(*) FILTER (WHERE period = 'ref') AS a, count(*) FILTER (WHERE period = 'cur') AS b FROM pb GROUP BY ALL),
 ps AS (SELECT column_name, CASE WHEN a > 0 THEN a / sum(a) OVER (PARTITION BY column_name) WHEN bin = 0 THEN 1e-6 ELSE 0 END::double AS x,
   CASE WHEN b > 0 THEN b / sum(b) OVER (PARTITION BY column_name) WHEN bin = 0 THEN 1e-6 ELSE 0 END::double AS y FROM pc),
 psin AS (SELECT column_name, sum(CASE WHEN x > 0 AND y > 0 THEN (y - x) * ln(y / x) ELSE 0 END) AS psi FROM ps GROUP BY column_name)"""

PSI_TXT = f"""cv AS ({each(TEXTS, "SELECT '{c}' AS column_name, period, {c} AS v FROM p")}),
 cc AS (SELECT column_name, v, count(*) FILTER (WHERE period = 'ref') AS a, count(*) FILTER (WHERE period = 'cur') AS b FROM cv GROUP BY ALL),
 cs AS (SELECT column_name, CASE WHEN a > 0 THEN a / sum(a) OVER (PARTITION BY column_name) ELSE 1e-6 END::double AS x,
   CASE WHEN b > 0 THEN b / sum(b) OVER (PARTITION BY column_name) ELSE 1e-6 END::double AS y FROM cc),
 psit AS (SELECT column_name, sum((y - x) * ln(y / x)) AS psi FROM cs GROUP BY column_name)"""

SEV = "CASE WHEN {x} >= 0.3 THEN 'critical' WHEN {x} >= 0.2 THEN 'high' WHEN {x} >= 0.1 THEN 'medium' WHEN {x} >= 0.05 THEN 'low' ELSE 'none' END"
RESULTS = f"""{KS}, {CHI}, res AS (SELECT column_name, statistic AS score FROM ks UNION ALL SELECT column_name, statistic / all_rows FROM chi),
 rs AS (SELECT *, {SEV.replace('{x}', 'score')} AS severity FROM res)"""


def _psi_results(s, d):
    return op.column_drift(periods(s, d), NUMS + TEXTS, 0.1, "psi").select(
        "column_name", "test_method", "drift_score", "drift_detected", "severity")


def _events(s, d):
    e = table(s, d, "events")
    return e.select("ts", "value", "event_type", F.when(F.col("event_id") % 13 > 0, F.col("value")).alias("reading"))


def _stream(s, d):
    """events as a file stream, closed by one far-future row that moves the watermark."""
    path = scratch_path(s, "events-stream")
    rows = _events(s, d)
    last = rows.orderBy(F.col("ts").desc()).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    rows.write.parquet(path)
    last.write.mode("append").parquet(path)
    return s.readStream.schema(rows.schema).parquet(path)


def _baseline(s, d):
    first = _events(s, d).filter(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    return first


def _monitor(s, d):
    base = monitors.fit_baseline(_baseline(s, d), ["value", "reading", "event_type"])
    out = monitors.monitor_drift(_stream(s, d), base, "ts", "1 day", "1 hour", 0.005)
    got = monitors.run_available(out, scratch_path(s, "monitor"))
    return rounded(got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "column_name", "rows", "psi", "severity", "alert"), psi=6)


def _monitor_quality(s, d):
    bounds = monitors.fit_bounds(_baseline(s, d), ["value"])
    out = monitors.monitor_quality(_stream(s, d), "ts", ["value", "reading", "event_type"], bounds)
    got = monitors.run_available(out, scratch_path(s, "quality"))
    return rounded(got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rows", "duplicates", "missing_pct", "outliers"), missing_pct=6)


def _monitor_newest(s, d):
    base = monitors.fit_baseline(_baseline(s, d), ["value", "event_type"])
    path = scratch_path(s, "newest")
    e = table(s, d, "events")
    src = scratch_path(s, "newest-src")
    e.select("ts", "event_id", "value", "event_type").write.parquet(src)
    stream = s.readStream.schema(s.read.parquet(src).schema).parquet(src)
    monitors.monitor_drift_batches(stream, base, ["ts", "event_id"], path, 1000).awaitTermination()
    return rounded(s.read.parquet(f"{path}/scores").select("column_name", "rows", "psi", "severity", "alert"), psi=6)


MON_COLS = ["value", "reading"]
MON = f"""ev AS (SELECT ts, value, event_type, CASE WHEN event_id % 13 > 0 THEN value END AS reading FROM events),
 base AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-11'),
 be AS ({each(MON_COLS, "SELECT '{c}' AS column_name, min({c}) AS low, max({c}) AS high FROM base")}),
 bins AS (SELECT column_name, day, CASE WHEN v IS NULL OR v < low OR v > high THEN '0'
   {' '.join(f"WHEN v <= low + (high - low) / 10 * {i} THEN '{i}'" for i in range(1, 10))} ELSE '10' END AS bin, is_base
   FROM ({each(MON_COLS, "SELECT '{c}' AS column_name, strftime(ts, '%Y-%m-%d') AS day, {c} AS v, ts < TIMESTAMP '2024-01-11' AS is_base FROM ev")}) JOIN be USING (column_name)
   UNION ALL SELECT 'event_type', strftime(ts, '%Y-%m-%d'), event_type, ts < TIMESTAMP '2024-01-11' FROM ev),
 bs AS (SELECT column_name, bin, count(*) / sum(count(*)) OVER (PARTITION BY column_name) AS x FROM bins WHERE is_base GROUP BY column_name, bin),
 days AS (SELECT DISTINCT day, column_name FROM bins),
 live AS (SELECT day, column_name, bin, count(*) AS c, sum(count(*)) OVER (PARTITION BY day, column_name) AS n FROM bins GROUP BY day, column_name, bin),
 grid AS (SELECT day, column_name, bin FROM days JOIN bs USING (column_name) UNION SELECT day, column_name, bin FROM live),
 both_ AS (SELECT g.day, g.column_name, g.bin, coalesce(x, CASE WHEN g.column_name = 'event_type' OR g.bin = '0' THEN 1e-6 ELSE 0 END)::double AS x,
   coalesce(c / n, CASE WHEN g.column_name = 'event_type' OR g.bin = '0' THEN 1e-6 ELSE 0 END)::double AS y, coalesce(c, 0) AS c
   FROM grid g LEFT JOIN bs USING (column_name, bin) LEFT JOIN live USING (day, column_name, bin)),
 sc AS (SELECT day, column_name, sum(c)::bigint AS "rows", sum(CASE WHEN x > 0 AND y > 0 THEN (y - x) * ln(y / x) ELSE 0 END) AS psi FROM both_ GROUP BY day, column_name)"""

QUERIES = {
    "split_temporal": lambda s, d: op.split_temporal(table(s, d, "orders"), ["o_orderdate", "o_orderkey"], 0.7).select("o_orderkey", "period"),
    "split_random": lambda s, d: op.split_random(table(s, d, "customer"), "c_custkey", 0.7).select("c_custkey", "period"),
    "ks_2samp": lambda s, d: rounded(op.ks_2samp(periods(s, d), NUMS), statistic=6, p_value=6),
    "chi_square": lambda s, d: rounded(op.chi_square(periods(s, d), TEXTS).drop("p_value"), statistic=4, drift_score=6),
    "chi_square_2x2": lambda s, d: rounded(op.chi_square(
        periods(s, d).select("period", F.when(F.col("status").isin("F", "O"), F.col("status")).alias("status")), ["status"]).drop("p_value"),
        statistic=4, drift_score=6),
    "psi_numeric": lambda s, d: rounded(op.psi_numeric(periods(s, d), NUMS), psi=6),
    "psi_categorical": lambda s, d: rounded(op.psi_categorical(periods(s, d), TEXTS), psi=6),
    "column_drift": lambda s, d: rounded(op.column_drift(periods(s, d), NUMS + TEXTS).select(
        "column_name", "test_method", "drift_score", "severity"), drift_score=6),
    "column_drift_psi": lambda s, d: rounded(_psi_results(s, d), drift_score=6),
    "column_drift_pvalues": lambda s, d: op.column_drift(periods(s, d), NUMS + TEXTS),
    "severity_of_values": lambda s, d: table(s, d, "lineitem").groupBy(severity(F.col("l_discount") * 4).alias("severity")).agg(F.count(F.lit(1)).alias("n")),
    "numeric_drift_stats": lambda s, d: rounded(op.numeric_drift_stats(periods(s, d), NUMS), mean=4, median=4, std=4, minimum=4,
                                                maximum=4, q25=4, q75=4, skewness=5, kurtosis=5),
    "categorical_drift_stats": lambda s, d: rounded(op.categorical_drift_stats(periods(s, d), TEXTS), entropy=6),
    "top_categories": lambda s, d: longs(op.top_categories(periods(s, d), TEXTS, 3), "position"),
    "drift_summary": lambda s, d: rounded(op.drift_summary(op.column_drift(periods(s, d), NUMS + TEXTS)).drop(
        "columns_with_drift", "drift_detected"), overall_score=6, max_score=6, min_score=6),
    "period_sizes": lambda s, d: op.period_sizes(periods(s, d)),
    "drift_recommendations": lambda s, d: rounded(op.drift_recommendations(
        op.column_drift(periods(s, d), NUMS + TEXTS, 0.1, "psi")), measure=6),
    "pca_drift": lambda s, d: rounded(op.pca_drift(periods(s, d), ["price", "o_custkey"]).select("score", "components"), score=5),
    "quality_drift": lambda s, d: rounded(op.quality_drift(periods(s, d).drop("o_orderkey", "o_custkey", "price", "gap"), TEXTS),
                                          **{f"{p}_{c}": 6 for p in ("ref", "cur") for c in ("missing_ratio", "duplicate_ratio")},
                                          missing_ratio_change=6, duplicate_ratio_change=6),
    "drift_suitability": lambda s, d: rounded(op.drift_suitability(labelled(s, d).withColumn("fixed", F.lit(1.0)).withColumn(
        "doc", F.col("doc_id").cast("string"))), missing_pct=6),
    "compare_histograms": lambda s, d: rounded(op.compare_histograms(periods(s, d), ["price"]), density=10, low=4, high=4),
    "five_numbers": lambda s, d: rounded(op.five_numbers(periods(s, d), NUMS), minimum=4, q25=4, median=4, q75=4, maximum=4),
    "compare_categories": lambda s, d: op.compare_categories(periods(s, d), TEXTS, 3),
    "drift_report": lambda s, d: report_rows(op.drift_report(periods(s, d), NUMS + TEXTS)).groupBy("section").agg(
        F.count(F.lit(1)).alias("entries")),
    "monitor_drift": _monitor,
    "monitor_quality": _monitor_quality,
    "monitor_newest": _monitor_newest,
}

DS = ("SELECT period, '{c}' AS column_name, count(*) AS count, count(*) - count({c}) AS missing, "
      f"{r('avg({c})', 4)} AS mean, {r('quantile_cont({c}::double, 0.5)', 4)} AS median, {r('stddev_samp({c})', 4)} AS std, "
      f"{r('min({c})', 4)} AS minimum, {r('max({c})', 4)} AS maximum, {r('quantile_cont({c}::double, 0.25)', 4)} AS q25, "
      f"{r('quantile_cont({c}::double, 0.75)', 4)} AS q75, {r('skewness({c})', 5)} AS skewness, {r('kurtosis({c})', 5)} AS kurtosis FROM p GROUP BY period")

ORACLES = {
    "split_temporal": f"WITH {PERIODS} SELECT o_orderkey, period FROM split",
    "split_random": """SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5(c_custkey::varchar), 1, 8))::bigint, c_custkey)
        <= floor(count(*) OVER () * 0.7::double) THEN 'ref' ELSE 'cur' END AS period FROM customer""",
    "ks_2samp": f"WITH {PERIODS}, {KS} SELECT column_name, {r('statistic')} AS statistic, ref_size, cur_size, {r('p_value')} AS p_value FROM ks",
    "chi_square": f"WITH {PERIODS}, {CHI} SELECT column_name, {r('statistic', 4)} AS statistic, dof, {r('statistic / all_rows')} AS drift_score FROM chi",
    "chi_square_2x2": f"WITH {PERIODS}, q AS (SELECT period, CASE WHEN status IN ('F', 'O') THEN status END AS status FROM p), "
        + CHI.replace("SELECT 'status' AS column_name, period, status AS v FROM p", "SELECT 'status' AS column_name, period, status AS v FROM q").replace(
            "\nUNION ALL\nSELECT 'priority' AS column_name, period, priority AS v FROM p", "")
        + f" SELECT column_name, {r('statistic', 4)} AS statistic, dof, {r('statistic / all_rows')} AS drift_score FROM chi",
    "psi_numeric": f"WITH {PERIODS}, {PSI_NUM} SELECT column_name, {r('psi')} AS psi FROM psin",
    "psi_categorical": f"WITH {PERIODS}, {PSI_TXT} SELECT column_name, {r('psi')} AS psi FROM psit",
    "column_drift": f"""WITH {PERIODS}, {RESULTS} SELECT column_name, CASE WHEN column_name IN ('status', 'priority') THEN 'Chi-square' ELSE 'Kolmogorov-Smirnov' END AS test_method,
        {r('score')} AS drift_score, severity FROM rs""",
    "column_drift_psi": f"""WITH {PERIODS}, {PSI_NUM}, {PSI_TXT}, a AS (SELECT * FROM psin UNION ALL SELECT * FROM psit)
        SELECT column_name, 'Population Stability Index' AS test_method, {r('psi')} AS drift_score, psi > 0.1 AS drift_detected, {SEV.replace('{x}', 'psi')} AS severity FROM a""",
    "severity_of_values": f"WITH s AS (SELECT {SEV.replace('{x}', '(l_discount * 4)')} AS severity FROM lineitem) SELECT severity, count(*) AS n FROM s GROUP BY severity",
    "numeric_drift_stats": f"WITH {PERIODS} {each(NUMS, DS)}",
    "categorical_drift_stats": f"""WITH {PERIODS}, v AS ({each(TEXTS, "SELECT '{c}' AS column_name, period, {c} AS v, count(*) AS n FROM p GROUP BY ALL")}),
        q AS (SELECT *, n / sum(n) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY column_name, period) AS f FROM v)
        SELECT column_name, period, sum(n)::bigint AS count, coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::bigint AS missing, count(v) AS unique_count,
          {r('-sum(f * ln(f)) FILTER (WHERE v IS NOT NULL)')} AS entropy FROM q GROUP BY column_name, period""",
    "top_categories": f"""WITH {PERIODS}, v AS ({each(TEXTS, "SELECT '{c}' AS column_name, period, {c} AS value, count(*) AS n FROM p WHERE {c} IS NOT NULL GROUP BY ALL")}),
        k AS (SELECT *, row_number() OVER (PARTITION BY period, column_name ORDER BY n DESC, value) AS position FROM v) SELECT * FROM k WHERE position <= 3""",
    "drift_summary": f"""WITH {PERIODS}, {RESULTS} SELECT count(*) AS columns_analyzed, {r('avg(score)')} AS overall_score, {r('max(score)')} AS max_score, {r('min(score)')} AS min_score,
        count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high_columns, count(*) FILTER (WHERE severity = 'medium') AS medium_columns FROM rs""",
    "period_sizes": f"""WITH {PERIODS}, c AS (SELECT count(*) FILTER (WHERE period = 'ref') AS a, count(*) AS n FROM p)
        SELECT a AS ref_size, n - a AS cur_size, 0::bigint AS ref_start, a - 1 AS ref_end, a AS cur_start, n - 1 AS cur_end FROM c""",
    "drift_recommendations": f"""WITH {PERIODS}, {PSI_NUM}, {PSI_TXT}, a AS (SELECT psi AS x, {SEV.replace('{x}', 'psi')} AS severity FROM (SELECT * FROM psin UNION ALL SELECT * FROM psit)),
        z AS (SELECT avg(x) AS o, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS h, count(*) FILTER (WHERE severity = 'medium') AS m,
          count(*) FILTER (WHERE x > 0.1) / count(*)::double AS share FROM a),
        rules AS (SELECT 'significant_drift' AS rule, 'High' AS priority, 'Assessment' AS category, o AS measure FROM z WHERE o > 0.2
         UNION ALL SELECT 'moderate_drift', 'Medium', 'Assessment', o FROM z WHERE o > 0.1 AND o <= 0.2
         UNION ALL SELECT 'address_high_columns', 'High', 'Immediate Action', h FROM z WHERE h > 0
         UNION ALL SELECT 'model_at_risk', 'High', 'Model Impact', share FROM z WHERE share > 0.3
         UNION ALL SELECT 'retrain_model', 'High', 'Model Management', o FROM z WHERE o > 0.15
         UNION ALL SELECT 'watch_medium_columns', 'Medium', 'Monitoring', m FROM z WHERE m > 0
         UNION ALL SELECT 'automate_detection', 'Medium', 'Infrastructure', 1 UNION ALL SELECT 'document_patterns', 'Low', 'Documentation', 1)
        SELECT rule, priority, category, {r('measure')} AS measure FROM rules""",
    "pca_drift": f"""WITH {PERIODS}, f AS (SELECT avg(price) AS m1, stddev_pop(price) AS s1, avg(o_custkey) AS m2, stddev_pop(o_custkey) AS s2 FROM p WHERE period = 'ref'),
        z AS (SELECT period, (price - m1) / s1 AS a, (o_custkey - m2) / s2 AS b FROM p, f),
        v AS (SELECT 1 AS c, period, a + b AS v FROM z UNION ALL SELECT 2, period, a - b FROM z),
        w AS (SELECT c, sum(count(*) FILTER (WHERE period = 'ref')) OVER (PARTITION BY c ORDER BY v) / sum(count(*) FILTER (WHERE period = 'ref')) OVER (PARTITION BY c) AS fa,
          sum(count(*) FILTER (WHERE period = 'cur')) OVER (PARTITION BY c ORDER BY v) / sum(count(*) FILTER (WHERE period = 'cur')) OVER (PARTITION BY c) AS fb FROM v GROUP BY c, v),
        k AS (SELECT c, max(abs(fa - fb)) AS dist FROM w GROUP BY c) SELECT {r('avg(dist)', 5)} AS score, count(*) AS components FROM k""",
    "quality_drift": f"""WITH {PERIODS}, q AS (SELECT period, status, priority FROM p),
        a AS (SELECT period, ((count(*) - count(status)) + (count(*) - count(priority))) / (2.0 * count(*)) AS mr, 1 - count(DISTINCT (coalesce(status, '?'), coalesce(priority, '?'))) / count(*)::double AS dr FROM q GROUP BY period),
        b AS (SELECT (SELECT mr::double FROM a WHERE period = 'ref') AS rm, (SELECT dr FROM a WHERE period = 'ref') AS rd, (SELECT mr::double FROM a WHERE period = 'cur') AS cm, (SELECT dr FROM a WHERE period = 'cur') AS cd)
        SELECT {r('rm')} AS ref_missing_ratio, {r('rd')} AS ref_duplicate_ratio, {r('cm')} AS cur_missing_ratio, {r('cd')} AS cur_duplicate_ratio,
          {r('cm - rm')} AS missing_ratio_change, {r('cd - rd')} AS duplicate_ratio_change FROM b""",
    "drift_suitability": f"""WITH {LABELLED}, t AS (SELECT *, 1.0::double AS fixed, doc_id::varchar AS doc FROM labelled),
        f AS ({union(f"SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS n, (count(*) - count({c})) * 100.0::double / count(*) AS missing_pct, count(DISTINCT {c}) AS distinct_count FROM t"
              for c, k in [('doc_id', 'n'), ('text', 't'), ('lang', 't'), ('source', 't'), ('n_chars', 'n'), ('quality', 'n'), ('toxic', 'n'), ('fixed', 'n'), ('doc', 't')])}),
        g AS (SELECT *, CASE WHEN kind = 'n' AND distinct_count < 2 THEN 'Constant' WHEN kind = 'n' AND missing_pct > 90 THEN 'Too many missing' WHEN kind = 'n' THEN 'Numerical Distribution'
          WHEN distinct_count > 0.9 * n THEN 'High cardinality' ELSE 'Categorical Distribution' END AS drift_type FROM f)
        SELECT column_name, {r('missing_pct')} AS missing_pct, distinct_count, drift_type, drift_type NOT IN ('Constant', 'Too many missing', 'High cardinality') AS suitable FROM g""",
    "compare_histograms": f"""WITH {PERIODS}, e AS (SELECT period, min(price) AS low, max(price) AS high, count(*) AS total FROM p GROUP BY period),
        b AS (SELECT period, low, high, total, least(floor((price - low) * 30 / (high - low)), 29)::bigint AS bin, count(*) AS n FROM p JOIN e USING (period) GROUP BY 1, 2, 3, 4, 5)
        SELECT period, 'price' AS column_name, {r('low', 4)} AS low, {r('high', 4)} AS high, total, bin, n, {r('n * 30 / (total * (high - low))', 10)} AS density FROM b""",
    "five_numbers": f"WITH {PERIODS} " + each(NUMS, "SELECT period, '{c}' AS column_name, " + ", ".join(
        f"{r('quantile_cont({c}::double, ' + q + ')', 4)} AS {n}" for n, q in [("minimum", "0.0"), ("q25", "0.25"), ("median", "0.5"), ("q75", "0.75"), ("maximum", "1.0")]) + " FROM p GROUP BY period"),
    "compare_categories": f"""WITH {PERIODS}, v AS ({each(TEXTS, "SELECT '{c}' AS column_name, period, {c} AS value, count(*) AS n FROM p WHERE {c} IS NOT NULL GROUP BY ALL")}),
        k AS (SELECT DISTINCT column_name, value FROM (SELECT *, row_number() OVER (PARTITION BY period, column_name ORDER BY n DESC, value) AS position FROM v) WHERE position <= 3)
        SELECT column_name, value, coalesce(sum(n) FILTER (WHERE period = 'ref'), 0)::bigint AS n_ref, coalesce(sum(n) FILTER (WHERE period = 'cur'), 0)::bigint AS n_cur
        FROM v JOIN k USING (column_name, value) GROUP BY column_name, value""",
    "monitor_drift": f"WITH {MON} SELECT day, column_name, \"rows\", {r('psi')} AS psi, {SEV.replace('{x}', 'psi')} AS severity, psi > 0.005 AS alert FROM sc",
    "monitor_quality": f"""WITH {MON}, q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM base),
        g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, value, reading, event_type, count(*) AS n, count(*) - count(value) + count(*) - count(reading) + count(*) - count(event_type) AS gaps,
          count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outs FROM ev, q GROUP BY ALL)
        SELECT day, sum(n)::bigint AS "rows", sum(n - 1)::bigint AS duplicates, {r('sum(gaps) * 100.0 / (sum(n) * 3)')} AS missing_pct, sum(outs)::bigint AS outliers FROM g GROUP BY day""",
    "monitor_newest": f"""WITH nb AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000), base AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-11'),
        e AS (SELECT min(value) AS low, max(value) AS high FROM base),
        bins AS (SELECT 'value' AS column_name, is_base, CASE WHEN value < low OR value > high THEN '0' {' '.join(f"WHEN value <= low + (high - low) / 10 * {i} THEN '{i}'" for i in range(1, 10))} ELSE '10' END AS bin
           FROM (SELECT value, true AS is_base FROM base UNION ALL SELECT value, false FROM nb), e
          UNION ALL SELECT 'event_type', is_base, event_type FROM (SELECT event_type, true AS is_base FROM base UNION ALL SELECT event_type, false FROM nb)),
        c AS (SELECT column_name, bin, count(*) FILTER (WHERE is_base) AS a, count(*) FILTER (WHERE NOT is_base) AS b FROM bins GROUP BY ALL),
        t AS (SELECT column_name, b, CASE WHEN a > 0 THEN a / sum(a) OVER (PARTITION BY column_name) WHEN column_name = 'event_type' OR bin = '0' THEN 1e-6 ELSE 0 END::double AS x,
          CASE WHEN b > 0 THEN b / sum(b) OVER (PARTITION BY column_name) WHEN column_name = 'event_type' OR bin = '0' THEN 1e-6 ELSE 0 END::double AS y FROM c),
        z AS (SELECT column_name, sum(b)::bigint AS "rows", sum(CASE WHEN x > 0 AND y > 0 THEN (y - x) * ln(y / x) ELSE 0 END) AS psi FROM t GROUP BY column_name)
        SELECT column_name, "rows", {r('psi')} AS psi, {SEV.replace('{x}', 'psi')} AS severity, psi > 0.1 AS alert FROM z""",
}
