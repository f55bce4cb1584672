"""Governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import patterns as fixed
from tidemark.operators import governance as op
from workloads.common import (ALL, LABELLED, LABELLED_COLS, MESSY, NUMERIC, TEXT, each, labelled, longs, messy, r,
                              rounded, table, union)
from workloads.profiling import G1, PART_KINDS, LAB_KINDS, roles_sql
from workloads.quality import QUART, long_cte

EMAIL, PHONE = fixed.SEMANTIC_PATTERNS["email"], fixed.SEMANTIC_PATTERNS["phone"]


def contacts(s, d):
    """customer with made-up contact columns of every pattern."""
    c = table(s, d, "customer")
    key = F.col("c_custkey").cast("string")
    pad = F.lpad(key, 4, "0")
    return c.select(
        "c_custkey", "c_name", "c_acctbal",
        F.concat(F.replace("c_name", F.lit("#"), F.lit("")), F.lit("@example.com")).alias("mail"),
        F.concat(F.lit("+4930"), F.lpad(key, 7, "1")).alias("tel"),
        F.concat(F.lit("1"), pad).alias("plz"),
        F.concat(pad, F.lit("-"), pad, F.lit(" "), pad, pad).alias("pay"),
        F.concat(F.substring(pad, 1, 3), F.lit("-12-"), pad).alias("social_no"),
        F.concat(F.lit("http://example.com/"), key).alias("home"),
        F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 256).cast("string")).alias("ip"),
        F.concat(F.lit("$"), pad, F.lit(".5")).alias("fee"),
        F.concat(F.lit("1995-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")).alias("born"))


CONTACTS = """contacts AS (SELECT c_custkey, c_name, c_acctbal, concat(replace(c_name, '#', ''), '@example.com') AS mail,
  concat('+4930', right(lpad(c_custkey::varchar, 7, '1'), 7)) AS tel, concat('1', lpad(c_custkey::varchar, 4, '0')) AS plz,
  concat(lpad(c_custkey::varchar, 4, '0'), '-', lpad(c_custkey::varchar, 4, '0'), ' ', lpad(c_custkey::varchar, 4, '0'), lpad(c_custkey::varchar, 4, '0')) AS pay,
  concat(substr(lpad(c_custkey::varchar, 4, '0'), 1, 3), '-12-', lpad(c_custkey::varchar, 4, '0')) AS social_no,
  concat('http://example.com/', c_custkey) AS home, concat('10.0.0.', c_custkey % 256) AS ip,
  concat('$', lpad(c_custkey::varchar, 4, '0'), '.5') AS fee,
  concat('1995-01-', lpad((c_custkey % 28 + 1)::varchar, 2, '0')) AS born FROM customer)"""
CONTACT_COLS = ["c_custkey", "c_name", "c_acctbal", "mail", "tel", "plz", "pay", "social_no", "home", "ip", "fee", "born"]
CONTACT_TEXT = [c for c in CONTACT_COLS if c not in ("c_custkey", "c_acctbal")]


def semantic_sql(source, cols):
    names = list(fixed.SEMANTIC_PATTERNS)
    counts = ", ".join(f"count(*) FILTER (WHERE regexp_matches({{c}}::varchar, '{p}')) AS {n}"
                       for n, p in fixed.SEMANTIC_PATTERNS.items())
    # literal braces of the patterns survive, as only {c} is replaced
    parts = union(("SELECT '{c}' AS column_name, count({c}) AS valid, " + counts + f" FROM {source}").replace("{c}", c) for c in cols)
    best = "greatest(" + ", ".join(f"CASE WHEN {n} > 0.8 * valid THEN {n} ELSE 0 END" for n in names) + ")"
    pick = " ".join(f"WHEN {n} = best AND best > 0 THEN '{n}'" for n in names)
    return f"""sem AS ({parts}), sb AS (SELECT *, {best} AS best FROM sem),
      semantic AS (SELECT column_name, valid, best AS matches, CASE WHEN valid = 0 THEN 'unknown' {pick} ELSE 'generic' END AS semantic_type FROM sb)"""


def pii_sql(source, all_cols, text_cols):
    named = [c for c in all_cols if any(w in c.lower() for w in fixed.PII_NAME_WORDS)]
    by_name = [f"SELECT '{c}' AS column_name, 'potential_pii' AS pii_type" for c in named]
    by_value = [f"""SELECT '{c}' AS column_name, CASE WHEN count(*) FILTER (WHERE regexp_matches({c}, '{EMAIL}')) > 0 THEN 'email'
      WHEN count(*) FILTER (WHERE regexp_matches({c}, '{PHONE}')) > 0 THEN 'phone' END AS pii_type FROM {source}""" for c in text_cols]
    return f"pii AS (SELECT * FROM ({union(by_name + by_value)}) WHERE pii_type IS NOT NULL)"


GOV_LABELLED = f"""WITH {LABELLED}, {pii_sql('labelled', LABELLED_COLS, ['text', 'lang', 'source'])},
  m AS ({each(LABELLED_COLS, "SELECT count(*) AS row_count, count(*) - count({c}) AS missing FROM labelled")}),
  casing AS ({each(['text', 'lang', 'source'], "SELECT (count(DISTINCT lower({c})) < count(DISTINCT {c}))::int AS bad FROM labelled")}),
  g AS (SELECT (SELECT 100 - sum(missing) * 100.0 / sum(row_count) FROM m)::double AS completeness,
    (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled)) FROM labelled) AS duplicate_rows,
    (SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labelled))) * 100.0 / count(*) FROM labelled)::double AS duplicate_pct,
    (SELECT greatest(0, 100 - 10 * sum(bad)) FROM casing)::double AS consistency, (SELECT count(*) FROM pii) AS pii_findings),
  h AS (SELECT *, (completeness >= 90)::bigint + (duplicate_pct < 5)::bigint + (consistency > 80)::bigint AS gates_passed FROM g)"""

GOV_MESSY = f"""WITH {MESSY}, g AS (SELECT 0 AS pii_findings, 100.0 AS completeness,
    (SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy))) * 100.0 / count(*) FROM messy)::double AS duplicate_pct)"""

INTERPRET_PART = f"""roles AS ({roles_sql('part', PART_KINDS)}),
  mom AS ({each(NUMERIC['part'], f"SELECT '{{c}}' AS column_name, min({{c}})::double AS mn, max({{c}})::double AS mx, {G1} AS g1 FROM part")}),
  steps AS (SELECT column_name, (mn >= 0 AND (CASE WHEN mn = 0 THEN mx > 0 ELSE mx / mn > 10 END))::bigint + (abs(g1) > 1)::bigint AS transforms FROM mom
    UNION ALL SELECT column_name, 1 FROM roles WHERE column_name IN ('p_name', 'p_brand', 'p_type')),
  {long_cte(NUMERIC['part'], 'part')}, {QUART},
  iss AS (SELECT roles.column_name, (roles.column_name IN ('p_name', 'p_brand', 'p_type') AND unique_pct > 50)::bigint
      + coalesce(outliers * 100.0 / roles.row_count > 5, false)::bigint AS issues FROM roles LEFT JOIN o USING (column_name)),
  inter AS (SELECT roles.column_name, role, transforms, issues,
     greatest(0, 100 - CASE WHEN role = 'categorical' AND unique_pct > 50 THEN 30 ELSE 0 END - CASE WHEN transforms > 2 THEN 20 ELSE 0 END - 10 * issues)::bigint AS score
     FROM roles JOIN steps USING (column_name) JOIN iss USING (column_name))"""

QUERIES = {
    "pii_columns": lambda s, d: op.pii_columns(contacts(s, d)),
    "semantic_types": lambda s, d: op.semantic_types(contacts(s, d)),
    "semantic_types_lineitem": lambda s, d: op.semantic_types(table(s, d, "lineitem").drop("l_shipdate")),
    "governance": lambda s, d: rounded(op.governance(labelled(s, d)), completeness=6, duplicate_pct=6, compliance_score=6),
    "governance_recommendations": lambda s, d: op.governance_recommendations(op.governance(labelled(s, d))),
    "bias_indicators": lambda s, d: rounded(op.bias_indicators(_lopsided(s, d)), ratio=6),
    "bias_risk": lambda s, d: op.bias_risk(_lopsided(s, d)),
    "interpretability": lambda s, d: op.interpretability(table(s, d, "part")),
    "explainability": lambda s, d: op.explainability(labelled(s, d)),
    "column_insights": lambda s, d: op.column_insights(table(s, d, "part")),
    "mask_pii": lambda s, d: op.mask_pii(op.mask_pii(contacts(s, d), ["mail"], "hash"), ["tel", "c_name"], "mask").select(
        "c_custkey", "c_name", "mail", "tel"),
    "redact_text": lambda s, d: op.mask_pii(
        table(s, d, "documents").select("doc_id", "text"), ["text"], "redact").select("doc_id", F.md5("text").alias("digest")),
}


def _lopsided(s, d):
    """labelled plus a status column where one value is 60 times as common."""
    return labelled(s, d).withColumn("order_status", F.when(F.col("doc_id") % 61 == 0, "rare").otherwise("common")).withColumn(
        "kind_type", F.when(F.col("doc_id") % 21 == 0, "few").otherwise("many"))


LOPSIDED = f"""{LABELLED}, lop AS (SELECT *, CASE WHEN doc_id % 61 = 0 THEN 'rare' ELSE 'common' END AS order_status,
  CASE WHEN doc_id % 21 = 0 THEN 'few' ELSE 'many' END AS kind_type FROM labelled)"""
LOP_KINDS = {**LAB_KINDS, "order_status": "text", "kind_type": "text"}
BIAS = f"""WITH {LOPSIDED}, roles AS ({roles_sql('lop', LOP_KINDS)}),
  vc AS ({each(LOP_KINDS, "SELECT '{c}' AS column_name, count(*) AS n FROM lop WHERE {c} IS NOT NULL GROUP BY {c}")}),
  k AS (SELECT column_name, max(n) / min(n)::double AS ratio FROM vc GROUP BY column_name HAVING count(*) > 1),
  gaps AS ({each(LOP_KINDS, "SELECT '{c}' AS column_name, (count(*) - count({c})) * 100.0 / count(*) AS pct FROM lop")}),
  ind AS (SELECT 'class_imbalance' AS indicator, column_name AS columns, CASE WHEN ratio > 50 THEN 'high' ELSE 'medium' END AS severity, ratio
    FROM k JOIN roles USING (column_name) WHERE role = 'categorical' AND ratio > 10
   UNION ALL SELECT 'missing_data_bias', string_agg(column_name, ',' ORDER BY column_name), 'medium', NULL FROM gaps WHERE pct > 20 HAVING count(*) > 0)"""

ORACLES = {
    "pii_columns": f"WITH {CONTACTS}, {pii_sql('contacts', CONTACT_COLS, CONTACT_TEXT)} SELECT * FROM pii",
    "semantic_types": f"WITH {CONTACTS}, {semantic_sql('contacts', CONTACT_COLS)} SELECT * FROM semantic",
    "semantic_types_lineitem": f"WITH {semantic_sql('lineitem', NUMERIC['lineitem'] + TEXT['lineitem'])} SELECT * FROM semantic",
    "governance": f"""{GOV_LABELLED} SELECT {r('completeness')} AS completeness, duplicate_rows, {r('duplicate_pct')} AS duplicate_pct, consistency, pii_findings, gates_passed,
        {r('(completeness + CASE WHEN pii_findings = 0 THEN 100 ELSE 60 END + gates_passed * 100.0 / 3) / 3')} AS compliance_score,
        completeness >= 80 AND pii_findings = 0 AS production_ready FROM h""",
    "governance_recommendations": f"""{GOV_LABELLED} SELECT 'privacy' AS rule, 'high' AS priority, 'mask_pii' AS action FROM h WHERE pii_findings > 0
        UNION ALL SELECT 'data_quality', 'high', 'impute' FROM h WHERE completeness < 80
        UNION ALL SELECT 'data_integrity', 'medium', 'drop_duplicates' FROM h WHERE duplicate_pct >= 5""",
    "bias_indicators": f"{BIAS} SELECT indicator, columns, severity, {r('ratio')} AS ratio FROM ind",
    "bias_risk": f"{BIAS} SELECT count(*) AS indicators, least(100, 25 * count(*))::bigint AS risk_score FROM ind",
    "interpretability": f"WITH {INTERPRET_PART} SELECT * FROM inter",
    "explainability": f"""WITH {LABELLED}, roles AS ({roles_sql('labelled', LAB_KINDS)}),
        m AS ({each(LABELLED_COLS, "SELECT count(*) AS row_count, count(*) - count({c}) AS missing FROM labelled")}),
        f AS (SELECT (SELECT 100 - sum(missing) * 100.0 / sum(row_count) > 80 FROM m) AS quality_ok,
          (SELECT count(*) FILTER (WHERE unique_pct > 90) < 3 FROM roles) AS cardinality_ok, (SELECT count(*) < 100 FROM roles) AS width_ok)
        SELECT *, 25.0::double * (1 + quality_ok::int + cardinality_ok::int + width_ok::int) AS readiness_score FROM f""",
    "column_insights": f"""WITH {INTERPRET_PART}, {semantic_sql('part', ALL['part'])}
        SELECT inter.column_name, role, transforms, issues, semantic_type, greatest(0, 100 - 10 * issues)::double AS score
        FROM inter JOIN semantic USING (column_name)""",
    "mask_pii": f"""WITH {CONTACTS} SELECT c_custkey, regexp_replace(regexp_replace(c_name, '[0-9]', '0', 'g'), '[A-Za-z]', 'x', 'g') AS c_name,
        sha256(mail) AS mail, regexp_replace(regexp_replace(tel, '[0-9]', '0', 'g'), '[A-Za-z]', 'x', 'g') AS tel FROM contacts""",
    "redact_text": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '<email>', 'g'),
        '\+?[0-9]{7,15}', '<phone>', 'g')) AS digest FROM documents""",
}
