"""Quality scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as op
from workloads.common import (ALL, LABELLED, LABELLED_COLS, MESSY, NUMERIC, each, labelled, lang_source, longs,
                              messy, r, rounded, table)

DATE_RE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"
NUM_RE = r"^\d{1,3}(,\d{3})*(\.\d+)?$"
MESSY_TEXT = ["priority", "day_text", "price_text", "status"]

MISSING_SQL = each(LABELLED_COLS, "SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing FROM labelled")
OUTLIERS = "SELECT '{c}' AS column_name, {c}::double AS v FROM {t}"
QUART = """q AS (SELECT column_name, count(*) AS row_count, count(v) AS valid,
   quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY column_name),
 b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q),
 o AS (SELECT b.column_name, b.row_count, b.valid, q1, q3, lower_bound, upper_bound,
   count(*) FILTER (WHERE v < lower_bound OR v > upper_bound) AS outliers
   FROM b JOIN long USING (column_name) GROUP BY ALL)"""


def long_cte(cols, source):
    return "long AS (" + each(cols, OUTLIERS.replace("{t}", source)) + ")"




QUERIES = {
    "missing_values": lambda s, d: rounded(longs(op.missing_values(labelled(s, d)), "missing", "row_count"), missing_pct=6),
    "casing_issues": lambda s, d: longs(op.casing_issues(messy(s, d)), "distinct_count", "distinct_lower", "valid"),
    "date_strings": lambda s, d: longs(op.date_strings(messy(s, d)), "matches", "row_count"),
    "numeric_strings": lambda s, d: longs(op.numeric_strings(messy(s, d)), "matches", "row_count"),
    "outlier_issues": lambda s, d: rounded(
        op.outlier_issues(messy(s, d)), q1=4, q3=4, lower_bound=4, upper_bound=4, outlier_pct=6),
    "duplicate_rows": lambda s, d: rounded(op.duplicate_rows(lang_source(s, d)), duplicate_pct=6),
    "duplicate_documents": lambda s, d: rounded(
        op.duplicate_rows(table(s, d, "documents").select("text", "lang")), duplicate_pct=6),
    "scan_quality": lambda s, d: rounded(op.scan_quality(messy(s, d)), affected_pct=6),
    "issue_summary": lambda s, d: op.issue_summary(op.scan_quality(messy(s, d))),
    "cleaning_suggestions": lambda s, d: longs(op.suggest_cleaning(op.scan_quality(labelled(s, d))), "priority_rank"),
    "completeness": lambda s, d: rounded(op.completeness(labelled(s, d)), completeness_pct=6),
    "uniqueness": lambda s, d: rounded(op.uniqueness(table(s, d, "lineitem")), unique_pct=6),
    "validity": lambda s, d: op.validity(table(s, d, "customer"), ["c_acctbal", "c_custkey"]),
    "accuracy": lambda s, d: op.accuracy(
        table(s, d, "lineitem"), {"l_quantity": (0, 40), "l_discount": (0, 0.2), "l_tax": (0, 0.05)}),
    "consistency": lambda s, d: op.consistency(messy(s, d)),
    "value_kinds": lambda s, d: op.value_kinds(messy(s, d)),
    "value_kind_score": lambda s, d: rounded(op.value_kind_score(messy(s, d)), score=6),
    "quality_metrics": lambda s, d: rounded(
        op.quality_metrics(labelled(s, d)), missing_pct=6, duplicate_pct=6, outlier_pct=6, score=6),
    "column_skews": lambda s, d: rounded(op.column_skews(table(s, d, "lineitem")), skewness=5),
    "column_score": lambda s, d: op.column_score(labelled(s, d)),
    "column_issues": lambda s, d: op.column_issues(labelled(s, d)),
    "readiness": lambda s, d: rounded(op.readiness(labelled(s, d)), missing_pct=6, drift_score=6),
}

MESSY_SCAN = f"""WITH {MESSY}, {long_cte(['price'], 'messy')}, {QUART},
 casing AS ({each(MESSY_TEXT, "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS a, count(DISTINCT lower({c})) AS b, count(*) AS n FROM messy")}),
 dates AS ({each(MESSY_TEXT, f"SELECT '{{c}}' AS column_name, count(*) AS n, count(*) FILTER (WHERE regexp_matches({{c}}, '{DATE_RE}')) AS m FROM messy")}),
 nums AS ({each(MESSY_TEXT, f"SELECT '{{c}}' AS column_name, count(*) AS n, count(*) FILTER (WHERE regexp_matches({{c}}, '{NUM_RE}')) AS m FROM messy")}),
 dup AS (SELECT count(*) AS total, (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS d FROM messy),
 issues AS (
 SELECT column_name, 'inconsistent_casing' AS issue_type, 'medium' AS severity, n AS affected_rows, 100.0::double AS affected_pct, 'standardize_case' AS suggested_fix FROM casing WHERE b < a
 UNION ALL SELECT column_name, 'date_format', 'medium', n, 100.0, 'to_datetime' FROM dates WHERE m > 0
 UNION ALL SELECT column_name, 'numeric_formatting', 'medium', n, 100.0, 'to_number' FROM nums WHERE m > 0
 UNION ALL SELECT column_name, 'outliers', 'low', outliers, {r('outliers * 100.0 / row_count')}, 'iqr_filter' FROM o WHERE outliers * 100.0 / row_count > 5
 UNION ALL SELECT 'all_columns', 'duplicate_rows', 'medium', total - d, {r('(total - d) * 100.0 / total')}, 'drop_duplicates' FROM dup WHERE total > d)"""

LABELLED_NUM = ["doc_id", "n_chars", "quality", "toxic"]
LABELLED_TXT = ["text", "lang", "source"]

ORACLES = {
    "missing_values": f"""WITH {LABELLED}, m AS ({MISSING_SQL})
        SELECT column_name, row_count, missing, {r('missing * 100.0 / row_count')} AS missing_pct,
          CASE WHEN missing * 100.0 / row_count > 50 THEN 'high' WHEN missing * 100.0 / row_count > 20 THEN 'medium' ELSE 'low' END AS severity,
          CASE WHEN missing * 100.0 / row_count < 50 THEN 'impute' ELSE 'drop_column' END AS suggested_fix
        FROM m WHERE missing > 0""",
    "casing_issues": f"""WITH {MESSY}, c AS ({each(MESSY_TEXT, "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count(DISTINCT lower({c})) AS distinct_lower, count({c}) AS valid FROM messy")})
        SELECT * FROM c WHERE distinct_lower < distinct_count""",
    "date_strings": f"""WITH {MESSY}, c AS ({each(MESSY_TEXT, f"SELECT '{{c}}' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE regexp_matches({{c}}, '{DATE_RE}')) AS matches FROM messy")})
        SELECT * FROM c WHERE matches > 0""",
    "numeric_strings": f"""WITH {MESSY}, c AS ({each(MESSY_TEXT, f"SELECT '{{c}}' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE regexp_matches({{c}}, '{NUM_RE}')) AS matches FROM messy")})
        SELECT * FROM c WHERE matches > 0""",
    "outlier_issues": f"""WITH {MESSY}, {long_cte(['price'], 'messy')}, {QUART}
        SELECT column_name, row_count, valid, {r('q1', 4)} AS q1, {r('q3', 4)} AS q3, {r('lower_bound', 4)} AS lower_bound,
          {r('upper_bound', 4)} AS upper_bound, outliers, {r('outliers * 100.0 / row_count')} AS outlier_pct
        FROM o WHERE outliers * 100.0 / row_count > 5""",
    "duplicate_rows": f"""WITH t AS (SELECT count(*) AS n FROM documents GROUP BY lang, source)
        SELECT sum(n)::bigint AS row_count, sum(n - 1)::bigint AS duplicate_rows, {r('sum(n - 1) * 100.0 / sum(n)')} AS duplicate_pct FROM t""",
    "duplicate_documents": f"""WITH t AS (SELECT count(*) AS n FROM documents GROUP BY text, lang)
        SELECT sum(n)::bigint AS row_count, sum(n - 1)::bigint AS duplicate_rows, {r('sum(n - 1) * 100.0 / sum(n)')} AS duplicate_pct FROM t""",
    "scan_quality": MESSY_SCAN + " SELECT * FROM issues",
    "issue_summary": MESSY_SCAN + """ SELECT 'severity' AS "grouping", severity AS label, count(*) AS issues FROM issues GROUP BY severity
        UNION ALL SELECT 'issue_type', issue_type, count(*) FROM issues GROUP BY issue_type""",
    "cleaning_suggestions": f"""WITH {LABELLED}, m AS ({MISSING_SQL}), p AS (SELECT *, missing * 100.0 / row_count AS pct FROM m WHERE missing > 0),
        {long_cte(LABELLED_NUM, 'labelled')}, {QUART}
        SELECT 'missing_values' AS category, CASE WHEN pct > 50 THEN 'high' WHEN pct > 20 THEN 'medium' ELSE 'low' END AS priority,
          (CASE WHEN pct > 50 THEN 3 WHEN pct > 20 THEN 2 ELSE 1 END)::bigint AS priority_rank, column_name,
          CASE WHEN pct < 50 THEN 'impute' ELSE 'drop_column' END AS operator FROM p
        UNION ALL SELECT 'outliers', 'low', 1, column_name, 'iqr_filter' FROM o WHERE outliers * 100.0 / row_count > 5""",
    "completeness": f"""WITH {LABELLED}, m AS ({MISSING_SQL}), a AS (SELECT * FROM m UNION ALL SELECT '*', sum(row_count)::bigint, sum(missing)::bigint FROM m)
        SELECT *, {r('100 - missing * 100.0 / row_count')} AS completeness_pct FROM a""",
    "uniqueness": f"""WITH u AS ({each(ALL['lineitem'], "SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count FROM lineitem")}
          UNION ALL SELECT '*', count(*), (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) FROM lineitem)
        SELECT *, row_count - distinct_count AS duplicates, {r('distinct_count * 100.0 / row_count')} AS unique_pct FROM u""",
    "validity": """SELECT count(*) AS row_count, (count(*) FILTER (WHERE c_acctbal < 0) > 0)::bigint AS issues,
          CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) > 0 THEN 'c_acctbal' ELSE '' END AS columns,
          count(*) FILTER (WHERE c_acctbal < 0) AS bad_values,
          (100 - 15 * (count(*) FILTER (WHERE c_acctbal < 0) > 0)::int)::double AS score FROM customer""",
    "accuracy": """WITH c AS (SELECT count(*) AS row_count, count(*) FILTER (WHERE l_quantity NOT BETWEEN 0 AND 40) AS a,
          count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 0.2) AS b, count(*) FILTER (WHERE l_tax NOT BETWEEN 0 AND 0.05::double) AS d FROM lineitem)
        SELECT row_count, (a > 0)::bigint + (b > 0)::bigint + (d > 0)::bigint AS issues,
          concat_ws(',', CASE WHEN a > 0 THEN 'l_quantity' END, CASE WHEN b > 0 THEN 'l_discount' END, CASE WHEN d > 0 THEN 'l_tax' END) AS columns,
          a + b + d AS bad_values, (85 - 10 * ((a > 0)::int + (b > 0)::int + (d > 0)::int))::double AS score FROM c""",
    "consistency": f"""WITH {MESSY}, c AS ({each(MESSY_TEXT, "SELECT (count(DISTINCT lower({c})) < count(DISTINCT {c}))::bigint AS bad FROM messy")})
        SELECT sum(bad)::bigint AS issues, greatest(100.0 - 10 * sum(bad), 0)::double AS score FROM c""",
    "value_kinds": f"""WITH {MESSY}, long AS ({each(MESSY_TEXT, "SELECT '{c}' AS column_name, {c} AS v FROM messy WHERE {c} IS NOT NULL")})
        SELECT column_name, CASE WHEN try_cast(v AS BIGINT) IS NOT NULL THEN 'integer' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'decimal'
          WHEN try_cast(v AS DATE) IS NOT NULL THEN 'date' WHEN lower(v) IN ('true', 'false') THEN 'boolean' ELSE 'text' END AS value_kind, count(*) AS n
        FROM long GROUP BY ALL""",
    "value_kind_score": f"""WITH {MESSY}, long AS ({each(MESSY_TEXT, "SELECT '{c}' AS column_name, {c} AS v FROM messy WHERE {c} IS NOT NULL")}),
        k AS (SELECT column_name, count(DISTINCT CASE WHEN try_cast(v AS BIGINT) IS NOT NULL THEN 'integer' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'decimal'
          WHEN try_cast(v AS DATE) IS NOT NULL THEN 'date' WHEN lower(v) IN ('true', 'false') THEN 'boolean' ELSE 'text' END) AS kinds FROM long GROUP BY column_name)
        SELECT count(*) AS checked, count(*) FILTER (WHERE kinds > 1) AS mixed, {r('(1 - count(*) FILTER (WHERE kinds > 1) / count(*)::double) * 100')} AS score FROM k""",
    "quality_metrics": f"""WITH {LABELLED}, m AS ({MISSING_SQL}), {long_cte(LABELLED_NUM, 'labelled')}, {QUART},
        p AS (SELECT (SELECT sum(missing) * 100.0 / sum(row_count) FROM m)::double AS missing_pct,
          (SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled))) * 100.0 / count(*) FROM labelled)::double AS duplicate_pct,
          (SELECT sum(outliers) * 100.0 / (SELECT count(*) FROM labelled) FROM o)::double AS outlier_pct)
        SELECT {r('missing_pct')} AS missing_pct, {r('duplicate_pct')} AS duplicate_pct, {r('outlier_pct')} AS outlier_pct,
          {r('greatest(100 - missing_pct - duplicate_pct - outlier_pct / 10, 0)')} AS score FROM p""",
    "column_skews": each(NUMERIC["lineitem"], f"SELECT '{{c}}' AS column_name, {r('skewness({c})', 5)} AS skewness FROM lineitem"),
    "column_score": f"""WITH {LABELLED}, m AS ({MISSING_SQL})
        SELECT column_name, round(least(100, greatest(0, 100 - 0.8 * (missing * 100.0::double / row_count)))::double, 1) AS score FROM m""",
    "column_issues": f"""WITH {LABELLED}, m AS ({each(LABELLED_COLS, "SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS dc FROM labelled")}),
        {long_cte(LABELLED_NUM, 'labelled')}, {QUART},
        f AS (SELECT m.column_name, CASE WHEN missing * 100.0 / m.row_count > 50 THEN 'high' WHEN missing * 100.0 / m.row_count > 5 THEN 'medium' END AS missing_severity,
          m.column_name IN ('text', 'lang', 'source') AND dc / m.row_count::double > 0.5 AS high_cardinality,
          coalesce(outliers * 100.0 / m.row_count > 5, false) AS many_outliers FROM m LEFT JOIN o USING (column_name))
        SELECT *, (missing_severity IS NOT NULL)::bigint + high_cardinality::bigint + many_outliers::bigint AS issues,
          100 - 10 * ((missing_severity IS NOT NULL)::bigint + high_cardinality::bigint + many_outliers::bigint) AS score FROM f""",
    "readiness": f"""WITH {LABELLED}, m AS ({each(LABELLED_COLS, "SELECT count(*) AS row_count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS dc FROM labelled")}),
        a AS (SELECT sum(missing) / sum(row_count)::double AS s, count(*) FILTER (WHERE dc <= 1) AS constant, count(*) AS k FROM m),
        b AS (SELECT s * 100 AS missing_pct, constant, 100 - 30 * s - 40.0 * constant / k AS drift_score FROM a)
        SELECT {r('missing_pct')} AS missing_pct, constant, {r('drift_score')} AS drift_score,
          CASE WHEN missing_pct > 30 THEN 'needs_preprocessing' WHEN missing_pct > 10 THEN 'minor_preprocessing' ELSE 'ready' END AS modeling_readiness,
          CASE WHEN drift_score >= 90 THEN 'Excellent' WHEN drift_score >= 75 THEN 'Good' WHEN drift_score >= 60 THEN 'Fair' ELSE 'Poor' END AS drift_readiness FROM b""",
}
