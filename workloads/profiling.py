"""Profiling and relationship queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import profiling as op, quality, relationships as rel
from workloads.common import (ALL, LABELLED, LABELLED_COLS, NUMERIC, SPARSE, TEXT, each, labelled, longs, r, rounded,
                              sparse_lines, table, union)
from workloads.quality import QUART, long_cte

TYPES = {
    "doc_id": ("bigint", "Int 64"), "text": ("string", "Object"), "lang": ("string", "Object"), "source": ("string", "Object"),
    "n_chars": ("bigint", "Int 64"), "quality": ("int", "Int 64"), "toxic": ("int", "Int 64"),
}
LINE_PAIRS = [(a, b) for i, a in enumerate(NUMERIC["lineitem"]) for b in NUMERIC["lineitem"][i + 1:]]


def _twin(s, d):
    line = table(s, d, "lineitem")
    return line.withColumn("q2", F.col("l_quantity"))


def _tied(s, d):
    part = table(s, d, "part")
    return part.select("p_retailprice", "p_size", (F.col("p_retailprice") * 2 + F.col("p_size")).alias("p_doubled"),
                       (-F.col("p_size")).alias("p_minus"))


def _cats(s, d):
    line = table(s, d, "lineitem")
    return line.select(
        "l_returnflag", "l_linestatus", F.concat("l_returnflag", F.lit("x")).alias("flag_copy"),
        F.when(F.col("l_linestatus") == "F", "f").when(F.col("l_quantity") > 45, "f").otherwise("o").alias("status_like"),
        F.when(F.col("l_returnflag") == "A", F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("mixed"))


CATS = """cats AS (SELECT l_returnflag, l_linestatus, concat(l_returnflag, 'x') AS flag_copy,
  CASE WHEN l_linestatus = 'F' THEN 'f' WHEN l_quantity > 45 THEN 'f' ELSE 'o' END AS status_like,
  CASE WHEN l_returnflag = 'A' THEN l_linestatus ELSE l_returnflag END AS mixed FROM lineitem)"""
CAT_COLS = ["l_returnflag", "l_linestatus", "flag_copy", "status_like", "mixed"]
CAT_PAIRS = [(a, b) for i, a in enumerate(CAT_COLS) for b in CAT_COLS[i + 1:]]

NUMERIC_DIGITS = dict(minimum=4, maximum=4, mean=4, median=4, std=4, skewness=5, kurtosis=5)


def _role(name: str) -> str | None:
    from tidemark.functions.patterns import ROLE_KEYWORDS
    return next((role for role, words in ROLE_KEYWORDS.items() if any(w in name for w in words)), None)


def roles_sql(source: str, cols: dict[str, str]) -> str:
    """cols: name -> kind."""
    parts = []
    for c, kind in cols.items():
        named = _role(c.lower())
        data = {"numeric": "'numerical'", "datetime": "'timestamp'",
                "text": f"CASE WHEN count(DISTINCT {c}) / count(*)::double < 0.1 THEN 'categorical' ELSE 'text' END"}[kind]
        role = f"'{named}'" if named else f"CASE WHEN count(DISTINCT {c}) / count(*)::double > 0.95 THEN 'id' ELSE {data} END"
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, "
                     f"count(DISTINCT {c}) * 100.0::double / count(*) AS unique_pct, {role} AS role FROM {source}")
    return union(parts)


DOC_KINDS = {"doc_id": "numeric", "text": "text", "lang": "text", "source": "text", "n_chars": "numeric"}
LINE_KINDS = {**{c: "numeric" for c in NUMERIC["lineitem"]}, **{c: "text" for c in TEXT["lineitem"]}, "l_shipdate": "datetime"}
PART_KINDS = {"p_partkey": "numeric", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "numeric",
              "p_retailprice": "numeric"}

TOP_SQL = """SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS position, value, n FROM vc"""

QUERIES = {
    "overview": lambda s, d: op.overview(labelled(s, d)),
    "column_samples": lambda s, d: longs(op.samples(table(s, d, "part"), 3), "position"),
    "first_rows": lambda s, d: op.first_rows(table(s, d, "customer"), ["c_acctbal", "c_custkey"], 5),
    "column_table": lambda s, d: op.column_table(labelled(s, d)),
    "duplicate_columns": lambda s, d: op.duplicate_columns(_twin(s, d)),
    "adjacent_correlations": lambda s, d: rel.adjacent_correlations(_tied(s, d)),
    "correlations": lambda s, d: rounded(rel.correlations(table(s, d, "lineitem")), correlation=6),
    "high_correlations": lambda s, d: rounded(rel.high_correlations(_tied(s, d)), correlation=6),
    "numeric_profile": lambda s, d: rounded(op.numeric_profile(table(s, d, "lineitem")), **NUMERIC_DIGITS),
    "numeric_profile_ranked": lambda s, d: rounded(op.numeric_profile(sparse_lines(s, d)), **NUMERIC_DIGITS),
    "text_profile": lambda s, d: rounded(op.text_profile(table(s, d, "documents")), avg_length=6),
    "top_text": lambda s, d: longs(op.top_text(table(s, d, "part")), "position"),
    "categorical_profile": lambda s, d: op.categorical_profile(table(s, d, "part")),
    "describe": lambda s, d: rounded(op.describe(table(s, d, "orders")), mean=4, std=4, minimum=4, q25=4, q50=4, q75=4, maximum=4),
    "describe_ranked": lambda s, d: rounded(op.describe(table(s, d, "orders")), mean=4, std=4, minimum=4,
                                            q25=4, q50=4, q75=4, maximum=4),
    "datetime_profile": lambda s, d: op.datetime_profile(table(s, d, "orders")).select(
        "column_name", "valid", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"),
        "range_days", "common_year", "common_month"),
    "weekday_counts": lambda s, d: op.weekday_counts(table(s, d, "lineitem")),
    "shape": lambda s, d: rounded(op.shape(table(s, d, "customer")), skewness=6, kurtosis=6, normal_p=6),
    "distribution_label": lambda s, d: op.distribution_label(table(s, d, "lineitem")),
    "uniform_ks": lambda s, d: rounded(op.uniform_ks(table(s, d, "lineitem"), ["l_discount", "l_tax", "l_quantity"]),
                                       uniform_d=6, uniform_p=6),
    "outlier_table": lambda s, d: rounded(quality.outlier_table(table(s, d, "customer")), q1=4, q3=4, lower_bound=4,
                                          upper_bound=4, outlier_pct=6),
    "cramers_v": lambda s, d: rounded(rel.cramers_v(_cats(s, d)), cramers_v=6),
    "hierarchies": lambda s, d: op.hierarchies(table(s, d, "orders")),
    "foreign_keys": lambda s, d: rounded(op.foreign_keys(table(s, d, "lineitem"), "key$"), unique_ratio=6),
    "column_roles": lambda s, d: rounded(op.column_roles(table(s, d, "documents")), unique_pct=6),
    "column_roles_part": lambda s, d: rounded(op.column_roles(table(s, d, "part")), unique_pct=6),
    "transform_suggestions": lambda s, d: op.transform_suggestions(table(s, d, "part")),
    "prep_suggestions": lambda s, d: op.prep_suggestions(labelled(s, d), quality.scan_quality(labelled(s, d))),
    "histogram": lambda s, d: rounded(op.histogram(table(s, d, "orders"), ["o_totalprice"]), density=10),
    "chart_data": lambda s, d: op.chart_data(labelled(s, d)),
    "scatter_sample": lambda s, d: op.scatter_sample(table(s, d, "lineitem").withColumn(
        "line_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")),
        "l_quantity", "l_extendedprice", "line_id", 500).select("x", "y"),
    "column_graph": lambda s, d: rel.column_graph(_tied(s, d)),
    "column_kinds": lambda s, d: op.kinds_of_columns(table(s, d, "lineitem")),
}

NUM_SQL = ("SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS valid, "
           f"{r('min({c})', 4)} AS minimum, {r('max({c})', 4)} AS maximum, {r('avg({c})', 4)} AS mean, "
           f"{r('quantile_cont({c}::double, 0.5)', 4)} AS median, {r('stddev_samp({c})', 4)} AS std, "
           f"{r('CASE WHEN count({c}) > 2 THEN skewness({c}) * (count({c}) - 2) / sqrt(count({c})::double * (count({c}) - 1)) END', 5)} AS skewness, "
           f"{r('kurtosis_pop({c})', 5)} AS kurtosis, "
           "count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives FROM ")

DESCRIBE_SQL = each(NUMERIC["orders"], "SELECT '{c}' AS column_name, count({c}) AS valid, "
    f"{r('avg({c})', 4)} AS mean, {r('stddev_samp({c})', 4)} AS std, {r('min({c})', 4)} AS minimum, "
    f"{r('quantile_cont({c}::double, 0.25)', 4)} AS q25, {r('quantile_cont({c}::double, 0.5)', 4)} AS q50, "
    f"{r('quantile_cont({c}::double, 0.75)', 4)} AS q75, {r('max({c})', 4)} AS maximum FROM orders")

G1 = "(skewness({c}) * (count({c}) - 2) / sqrt(count({c})::double * (count({c}) - 1)))"

NORMAL_CTE = """a AS (SELECT *, n::double AS x FROM m),
 b AS (SELECT *, 3*(x*x+27*x-70)*(x+1)*(x+3)/((x-2)*(x+5)*(x+7)*(x+9)) AS beta, g1*sqrt((x+1)*(x+3)/(6*(x-2))) AS y,
   3*(x-1)/(x+1) AS ek, 24*x*(x-2)*(x-3)/((x+1)*(x+1)*(x+3)*(x+5)) AS vk,
   6*(x*x-5*x+2)/((x+7)*(x+9))*sqrt(6*(x+3)*(x+5)/(x*(x-2)*(x-3))) AS s FROM a),
 c AS (SELECT *, sqrt(2*(beta-1))-1 AS w2, (g2+3-ek)/sqrt(vk) AS xk, 6+(8/s)*(2/s+sqrt(1+4/(s*s))) AS ak FROM b),
 e AS (SELECT *, asinh(y/sqrt(2/(w2-1)))/sqrt(0.5*ln(w2)) AS z1, 1+xk*sqrt(2/(ak-4)) AS q FROM c),
 f AS (SELECT *, (1-2/(9*ak)-sign(q)*cbrt((1-2/ak)/abs(q)))/sqrt(2/(9*ak)) AS z2 FROM e),
 p AS (SELECT *, exp(-(z1*z1+z2*z2)/2) AS normal_p FROM f)"""


def _moments_cte(table_name):
    return "m AS (" + each(NUMERIC[table_name], f"SELECT '{{c}}' AS column_name, count({{c}}) AS n, {G1} AS g1, kurtosis_pop({{c}}) AS g2, skewness({{c}}) AS sk FROM {table_name}") + ")"


def _ks_cte(cols):
    return ("v AS (" + each(cols, "SELECT '{c}' AS column_name, {c}::double AS v FROM lineitem") + """),
 w AS (SELECT column_name, v, count(*) AS n FROM v GROUP BY ALL),
 x0 AS (SELECT *, sum(n) OVER (PARTITION BY column_name ORDER BY v) AS upto, sum(n) OVER (PARTITION BY column_name) AS total, least(1, greatest(0, v)) AS cdf FROM w),
 ks AS (SELECT column_name, max(greatest(upto / total::double - cdf, cdf - (upto - n) / total::double)) AS uniform_d, max(total)::bigint AS valid FROM x0 GROUP BY column_name),
 kp AS (SELECT *, (sqrt(valid::double) + 0.12 + 0.11 / sqrt(valid::double)) * uniform_d AS lam FROM ks),
 kq AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END AS uniform_p FROM kp)""")


def _cramer_sql():
    parts = []
    for a, b in CAT_PAIRS:
        parts.append(f"""SELECT '{a}' AS left_column, '{b}' AS right_column, v AS cramers_v FROM (
          WITH o AS (SELECT ra.x, cb.y, count(cats.{a}) AS o FROM (SELECT DISTINCT {a} AS x FROM cats) ra CROSS JOIN (SELECT DISTINCT {b} AS y FROM cats) cb
             LEFT JOIN cats ON cats.{a} = ra.x AND cats.{b} = cb.y GROUP BY ra.x, cb.y),
           e AS (SELECT o::double AS o, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / (sum(o) OVER ())::double AS e,
             sum(o) OVER () AS n FROM o),
           k AS (SELECT (SELECT count(DISTINCT {a}) FROM cats) AS r, (SELECT count(DISTINCT {b}) FROM cats) AS c)
           SELECT sqrt(sum(CASE WHEN r = 2 AND c = 2 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) ELSE power(o - e, 2) END / e)
             / (max(n) * (least(max(r), max(c)) - 1))) AS v FROM e, k)""")
    return union(parts)


PART_MOM = each(NUMERIC["part"], f"SELECT '{{c}}' AS column_name, min({{c}})::double AS mn, max({{c}})::double AS mx, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, {G1} AS g1 FROM part")
LAB_NUM = ["doc_id", "n_chars", "quality", "toxic"]
LAB_TXT = ["text", "lang", "source"]
LAB_KINDS = {"doc_id": "numeric", "text": "text", "lang": "text", "source": "text", "n_chars": "numeric", "quality": "numeric", "toxic": "numeric"}
LAB_MOM = each(LAB_NUM, f"SELECT '{{c}}' AS column_name, min({{c}})::double AS mn, max({{c}})::double AS mx, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, {G1} AS g1 FROM labelled")

ORACLES = {
    "overview": f"""WITH {LABELLED} SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled)) AS duplicate_rows,
        sum((quality IS NULL)::bigint + (toxic IS NULL)::bigint)::bigint AS missing_cells,
        sum(8 + strlen(text) + strlen(lang) + strlen(source) + 8 + 4 + 4)::bigint AS logical_bytes, 7::bigint AS column_count FROM labelled""",
    "column_samples": f"""WITH vc AS ({each(ALL['part'], "SELECT DISTINCT '{c}' AS column_name, {c}::varchar AS value FROM part")}),
        ranked AS (SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY value) AS position, value FROM vc)
        SELECT * FROM ranked WHERE position <= 3""",
    "first_rows": "SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5",
    "column_table": f"WITH {LABELLED} " + union(
        f"""SELECT '{c}' AS column_name, '{t}' AS data_type, '{s}' AS display_type, count(*) - count({c}) AS missing,
        round((count(*) - count({c})) * 100.0::double / count(*), 2) AS missing_pct,
        round(100 - 0.8 * ((count(*) - count({c})) * 100.0::double / count(*)), 1) AS score, count(DISTINCT {c}) AS distinct_count FROM labelled"""
        for c, (t, s) in TYPES.items()),
    "duplicate_columns": "SELECT 'l_quantity' AS left_column, 'q2' AS right_column",
    "adjacent_correlations": """WITH t AS (SELECT p_retailprice AS a, p_size AS b, p_retailprice * 2 + p_size AS c, -p_size AS d FROM part)
        SELECT 'n0' AS label, floor(abs(corr(a, b)) * 100)::bigint AS value FROM t UNION ALL SELECT 'n1', floor(abs(corr(b, c)) * 100)::bigint FROM t
        UNION ALL SELECT 'n2', floor(abs(corr(c, d)) * 100)::bigint FROM t""",
    "correlations": union(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, {NUMERIC['lineitem'].index(a)}::bigint AS left_index, "
        f"{NUMERIC['lineitem'].index(b)}::bigint AS right_index, {r(f'corr({a}, {b})')} AS correlation FROM lineitem" for a, b in LINE_PAIRS),
    "high_correlations": "WITH t AS (SELECT p_retailprice, p_size, p_retailprice * 2 + p_size AS p_doubled, -p_size AS p_minus FROM part), c AS (" + union(
        f"SELECT '{a}' AS left_column, '{b}' AS right_column, corr({a}, {b}) AS correlation FROM t" for a, b in
        [("p_retailprice", "p_size"), ("p_retailprice", "p_doubled"), ("p_retailprice", "p_minus"), ("p_size", "p_doubled"),
         ("p_size", "p_minus"), ("p_doubled", "p_minus")]) + f") SELECT left_column, right_column, {r('correlation')} AS correlation, abs(correlation) > 0.9 AS redundant FROM c WHERE abs(correlation) > 0.7",
    "numeric_profile": each(NUMERIC["lineitem"], NUM_SQL + "lineitem"),
    "numeric_profile_ranked": f"WITH {SPARSE} " + each(["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], NUM_SQL + "sparse"),
    "text_profile": each(TEXT["documents"], "SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS valid, "
        f"{r('avg(length({c}))')} AS avg_length, max(length({{c}})) AS max_length, min(length({{c}})) AS min_length, "
        "count(*) FILTER (WHERE {c} = '') AS empty, count(*) FILTER (WHERE regexp_matches({c}, '[0-9]')) AS with_digit, "
        r"count(*) FILTER (WHERE regexp_matches({c}, '[^a-zA-Z0-9\s]')) AS with_special FROM documents"),
    "top_text": f"""WITH vc AS ({each(TEXT['part'], "SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM part GROUP BY {c}")}),
        ranked AS ({TOP_SQL}) SELECT * FROM ranked WHERE position <= 5""",
    "categorical_profile": f"""WITH vc AS ({each(TEXT['part'], "SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM part GROUP BY {c}")}),
        a AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS up,
          row_number() OVER (PARTITION BY column_name ORDER BY n, value DESC) AS down, count(*) OVER (PARTITION BY column_name) AS dc FROM vc)
        SELECT column_name, max(value) FILTER (WHERE up = 1) AS most_frequent, max(n) AS most_frequent_count,
          max(value) FILTER (WHERE down = 1) AS least_frequent, min(n) AS least_frequent_count, max(dc) AS distinct_count,
          (SELECT count(*) FROM part) AS row_count, CASE WHEN max(dc) > 0.5 * (SELECT count(*) FROM part) THEN 'high' ELSE 'low' END AS cardinality
        FROM a GROUP BY column_name""",
    "describe": DESCRIBE_SQL,
    "describe_ranked": DESCRIBE_SQL,
    "datetime_profile": """SELECT 'o_orderdate' AS column_name, count(o_orderdate) AS valid, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first,
        strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last, date_diff('day', min(o_orderdate), max(o_orderdate)) AS range_days,
        (SELECT year(o_orderdate) FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS common_year,
        (SELECT month(o_orderdate) FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS common_month FROM orders""",
    "weekday_counts": "SELECT 'l_shipdate' AS column_name, (isodow(l_shipdate) - 1)::bigint AS weekday, count(*) AS n FROM lineitem GROUP BY ALL",
    "shape": f"WITH {_moments_cte('customer')}, {NORMAL_CTE} SELECT column_name, n AS valid, {r('g1')} AS skewness, {r('g2')} AS kurtosis, {r('normal_p')} AS normal_p FROM p",
    "distribution_label": f"""WITH {_moments_cte('lineitem')}, {NORMAL_CTE}, {_ks_cte(NUMERIC['lineitem'])}
        SELECT column_name, p.n AS valid, CASE WHEN p.n < 10 THEN 'insufficient_data' WHEN normal_p > 0.05 THEN 'normal' WHEN uniform_p > 0.05 THEN 'uniform'
          WHEN abs(g1) > 1 THEN 'skewed' ELSE 'unknown' END AS label_by_test,
          CASE WHEN abs(sk) < 0.5 THEN 'normal' WHEN sk > 1 THEN 'right_skewed' WHEN sk < -1 THEN 'left_skewed' ELSE 'slightly_skewed' END AS label_by_skew
        FROM p JOIN kq USING (column_name)""",
    "uniform_ks": f"WITH {_ks_cte(['l_discount', 'l_tax', 'l_quantity'])} SELECT column_name, valid, {r('uniform_d')} AS uniform_d, {r('uniform_p')} AS uniform_p FROM kq",
    "outlier_table": f"""WITH {long_cte(NUMERIC['customer'], 'customer')}, {QUART}
        SELECT column_name, {r('q1', 4)} AS q1, {r('q3', 4)} AS q3, {r('lower_bound', 4)} AS lower_bound, {r('upper_bound', 4)} AS upper_bound,
          valid, outliers, {r('outliers * 100.0 / valid')} AS outlier_pct FROM o""",
    "cramers_v": f"WITH {CATS}, c AS ({_cramer_sql()}) SELECT left_column, right_column, {r('cramers_v')} AS cramers_v, CASE WHEN cramers_v > 0.6 THEN 'strong' ELSE 'moderate' END AS strength FROM c WHERE cramers_v > 0.3",
    "hierarchies": r"SELECT 'o_orderpriority' AS column_name, count(*) AS matches, min(o_orderpriority) AS example FROM orders WHERE regexp_matches(o_orderpriority, '[/\\>-]')",
    "foreign_keys": "WITH u AS (" + each(["l_orderkey", "l_partkey", "l_suppkey"], "SELECT '{c}' AS column_name, count(DISTINCT {c}) / count(*)::double AS u FROM lineitem") + f") SELECT column_name, {r('u')} AS unique_ratio FROM u WHERE u > 0.1 AND u < 0.9",
    "column_roles": f"WITH f AS ({roles_sql('documents', DOC_KINDS)}) SELECT column_name, row_count, distinct_count, {r('unique_pct')} AS unique_pct, role FROM f",
    "column_roles_part": f"WITH f AS ({roles_sql('part', PART_KINDS)}) SELECT column_name, row_count, distinct_count, {r('unique_pct')} AS unique_pct, role FROM f",
    "transform_suggestions": f"""WITH m AS ({PART_MOM}), t AS ({each(TEXT['part'], "SELECT '{c}' AS column_name, count(DISTINCT {c}) / count(*)::double AS u FROM part")})
        SELECT column_name, 'log_transform' AS suggestion FROM m WHERE mn >= 0 AND (CASE WHEN mn = 0 THEN mx > 0 ELSE mx / mn > 10 END)
        UNION ALL SELECT column_name, 'normalization' FROM m WHERE abs(g1) > 1
        UNION ALL SELECT column_name, CASE WHEN u > 0.5 THEN 'text_encoding' ELSE 'label_encoding' END FROM t""",
    "prep_suggestions": f"""WITH {LABELLED}, m AS ({LAB_MOM}), t AS ({each(LAB_TXT, "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS dc, count(*) AS n FROM labelled")}),
        {long_cte(LAB_NUM, 'labelled')}, {QUART},
        miss AS ({each(LABELLED_COLS, "SELECT '{c}' AS column_name, (count(*) - count({c})) * 100.0 / count(*) AS pct FROM labelled")}),
        s AS (SELECT 'data_quality' AS category, CASE WHEN pct > 50 THEN 'high' ELSE 'medium' END AS priority, column_name,
            CASE WHEN pct < 50 THEN 'impute' ELSE 'drop_column' END AS suggestion FROM miss WHERE pct > 0
          UNION ALL SELECT 'data_quality', 'medium', column_name, 'iqr_filter' FROM o WHERE outliers * 100.0 / row_count > 5
          UNION ALL SELECT 'transformation', 'medium', column_name, 'log_transform' FROM m WHERE mn >= 0 AND (CASE WHEN mn = 0 THEN mx > 0 ELSE mx / mn > 10 END)
          UNION ALL SELECT 'transformation', 'medium', column_name, 'normalization' FROM m WHERE abs(g1) > 1
          UNION ALL SELECT 'transformation', 'medium', column_name, CASE WHEN dc > 0.5 * n THEN 'text_encoding' ELSE 'label_encoding' END FROM t
          UNION ALL SELECT 'encoding', 'medium', column_name, CASE WHEN dc < 10 THEN 'one_hot_encoding' ELSE 'target_encoding' END FROM t
          UNION ALL SELECT 'scaling', 'medium', column_name, CASE WHEN std > mean THEN 'standard_scaling' ELSE 'min_max_scaling' END FROM m WHERE std > mean OR mn >= 0
          UNION ALL VALUES """ + ", ".join([f"('feature_engineering', 'medium', '{a}*{b}', 'interaction_feature')" for i, a in enumerate(LAB_NUM) for b in LAB_NUM[i + 1:]]
             + [f"('feature_engineering', 'medium', '{a}^2', 'polynomial_feature')" for a in LAB_NUM]) + f""")
        SELECT * FROM s""",
    "histogram": f"""WITH e AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS total FROM orders),
        b AS (SELECT low, high, total, least(floor((o_totalprice - low) * 30 / (high - low)), 29)::bigint AS bin, count(*) AS n FROM orders, e GROUP BY 1, 2, 3, 4)
        SELECT 'o_totalprice' AS column_name, low, high, total, bin, n, {r('n * 30 / (total * (high - low))', 10)} AS density FROM b""",
    "chart_data": f"""WITH {LABELLED}, f AS ({roles_sql('labelled', LAB_KINDS)}), miss AS ({each(LABELLED_COLS, "SELECT '{c}' AS label, count(*) - count({c}) AS n FROM labelled")})
        SELECT 'missing' AS chart, label, n FROM miss WHERE n > 0
        UNION ALL SELECT 'types', label, count(*) FROM (VALUES ('bigint'), ('string'), ('string'), ('string'), ('bigint'), ('int'), ('int')) t(label) GROUP BY label
        UNION ALL SELECT 'roles', role, count(*) FROM f GROUP BY role UNION ALL SELECT 'distinct', column_name, distinct_count FROM f""",
    "column_graph": f"""WITH t AS (SELECT p_retailprice, p_size, p_retailprice * 2 + p_size AS p_doubled, -p_size AS p_minus FROM part),
        f AS ({roles_sql('t', {c: 'numeric' for c in ['p_retailprice', 'p_size', 'p_doubled', 'p_minus']})}), c AS (""" + union(
        f"SELECT '{a}' AS source, '{b}' AS target, corr({a}, {b}) AS r FROM t" for a, b in
        [("p_retailprice", "p_size"), ("p_retailprice", "p_doubled"), ("p_retailprice", "p_minus"), ("p_size", "p_doubled"),
         ("p_size", "p_minus"), ("p_doubled", "p_minus")]) + """)
        SELECT 'node' AS item, column_name AS source, NULL::varchar AS target, role FROM f UNION ALL SELECT 'edge', source, target, NULL FROM c WHERE abs(r) > 0.7""",
    "column_kinds": union(f"SELECT '{f}' AS column_name, '{k}' AS kind, '{t}' AS data_type, count({f}) AS filled FROM lineitem" for f, k, t in [
        ("l_orderkey", "numeric", "bigint"), ("l_partkey", "numeric", "bigint"), ("l_suppkey", "numeric", "bigint"),
        ("l_linenumber", "numeric", "int"), ("l_quantity", "numeric", "double"), ("l_extendedprice", "numeric", "double"),
        ("l_discount", "numeric", "double"), ("l_tax", "numeric", "double"), ("l_returnflag", "text", "string"),
        ("l_linestatus", "text", "string"), ("l_shipdate", "datetime", "timestamp_ntz")]),
    "scatter_sample": """SELECT l_quantity AS x, l_extendedprice AS y FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
        ORDER BY ('0x' || substr(md5(k), 1, 8))::bigint, k LIMIT 500""",
}
