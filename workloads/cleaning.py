"""Cleaning, feature and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning as op, quality
from tidemark.session import scratch_path
from tidemark.sources import catalog, readers, sinks
from workloads.common import (LABELLED, MESSY, NUMERIC, SPARSE, TABLES, each, labelled, longs, messy, r, rounded,
                              sparse_lines, table, union)
from workloads.quality import QUART, long_cte
from workloads.governance import pii_sql

CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
SCHEMA_COLS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
}


def _csv_roundtrip(s, d):
    path = scratch_path(s, "export-csv")
    sinks.export(table(s, d, "customer"), path, "csv")
    return readers.read_csv(s, path, CUSTOMER_SCHEMA)


def _json_roundtrip(s, d):
    path = scratch_path(s, "export-json")
    sinks.export(table(s, d, "customer"), path, "json")
    return readers.read_json(s, path, CUSTOMER_SCHEMA)


def _text_docs(s, d):
    path = scratch_path(s, "text-docs")
    table(s, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    docs = readers.read_text_docs(s, path)
    return docs.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"),
                       F.regexp_replace("text", r"\n$", "").alias("text"))


def _report(s, d):
    sections = {"completeness": quality.completeness(labelled(s, d)), "duplicates": quality.duplicate_rows(labelled(s, d))}
    path = scratch_path(s, "report")
    sinks.write_report(sections, path)
    return s.read.text(path).groupBy("section").agg(F.count(F.lit(1)).alias("entries"))


def _imputed(s, d):
    df = sparse_lines(s, d)
    return op.impute(df, op.fit_imputer(df, ["l_discount", "l_tax", "l_returnflag"]))




def _ffill(s, d):
    events = table(s, d, "events").withColumn("reading", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return op.ffill(events, ["event_type"], ["ts", "event_id"], ["reading"]).select("event_id", "reading")


def _scaled(s, d, how):
    df = table(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return op.scale(df, op.fit_scaler(df, ["c_acctbal", "c_nationkey"], how))


def _one_hot(s, d):
    df = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("status"))
    return op.one_hot(df, op.fit_one_hot(df, ["status"]))


def _label_encode(s, d):
    df = table(s, d, "part").select("p_partkey", "p_name")
    codes = op.label_codes(df.filter("p_partkey % 2 = 0"), "p_name")
    return op.label_encode(df, "p_name", codes)


def _label_encode_all(s, d):
    df = table(s, d, "part").select("p_partkey", "p_name")
    return op.label_encode(df, "p_name", op.label_codes(df, "p_name"))


def _clean_messy(s, d):
    df = messy(s, d)
    out = op.apply_cleaning(df, quality.suggest_cleaning(quality.scan_quality(df)))
    return out.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("priority").alias("priorities"),
                   F.max("price").alias("max_price"), F.sum(F.col("price_text").cast("decimal(18,2)")).cast("double").alias("price_sum"),
                   F.max(F.date_format("day_text", "yyyy-MM-dd")).alias("last_day"))


QUERIES = {
    "source_union_tables": lambda s, d: readers.read_tables(
        s, {t: f"{d}/{t}.parquet" for t in ("customer", "supplier", "nation")}),
    "source_csv": _csv_roundtrip,
    "source_json": _json_roundtrip,
    "source_text_docs": _text_docs,
    "table_catalog": lambda s, d: catalog.table_catalog({t: table(s, d, t) for t in TABLES}).drop("sample_rows"),
    "registry_summary": lambda s, d: rounded(
        catalog.registry_summary({t: table(s, d, t) for t in SCHEMA_COLS}), mean_completeness=6),
    "report_sink": _report,
    "table_card": lambda s, d: catalog.table_card(table(s, d, "customer"), "customer", ["c_custkey"]),
    "compare_tables": lambda s, d: catalog.compare_tables(
        {"documents": table(s, d, "documents"), "labels": table(s, d, "labels"), "benchmark": table(s, d, "benchmark"),
         "conversations": table(s, d, "conversations")}),
    "select_checked": lambda s, d: op.select_checked(table(s, d, "orders"), ["o_orderkey", "o_totalprice"]),
    "drop_null_target": lambda s, d: op.drop_null_target(labelled(s, d), "quality"),
    "impute": lambda s, d: _imputed(s, d).groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_discount"), 6).alias("discount"), F.round(F.sum("l_tax"), 6).alias("tax")),
    "fill_for_scoring": lambda s, d: op.fill_for_scoring(
        labelled(s, d).withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.col("source")))),
    "forward_fill": _ffill,
    "standardize_case": lambda s, d: op.standardize_case(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment"),
    "to_datetime": lambda s, d: op.to_datetime(_dates(s, d), "day_text").select(
        "o_orderkey", F.date_format("day_text", "yyyy-MM-dd").alias("day")),
    "to_number": lambda s, d: op.to_number(messy(s, d), "price_text").groupBy("status").agg(
        F.count("price_text").alias("n"), F.max("price_text").alias("top"), F.min("price_text").alias("low")),
    "iqr_filter": lambda s, d: _iqr(s, d, "drop").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("top")),
    "iqr_cap": lambda s, d: _iqr(s, d, "cap").groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("price"), 4).alias("top"), F.round(F.min("price"), 4).alias("low")),
    "drop_duplicates": lambda s, d: op.drop_duplicates(table(s, d, "documents").select("lang", "source")),
    "log_transform": lambda s, d: rounded(
        op.log_transform(table(s, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]), p_retailprice=6),
    "scale_standard": lambda s, d: rounded(_scaled(s, d, "standard"), c_acctbal=6, c_nationkey=6),
    "scale_minmax": lambda s, d: rounded(_scaled(s, d, "minmax"), c_acctbal=6, c_nationkey=6),
    "user_transform": lambda s, d: op.transform(
        table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice * (1 - l_discount) AS net"], "l_quantity > 48"),
    "one_hot": _one_hot,
    "label_encode": _label_encode,
    "label_encode_all": _label_encode_all,
    "label_codes": lambda s, d: op.label_codes(table(s, d, "customer"), "c_name"),
    "target_encode": lambda s, d: rounded(op.target_encode(
        table(s, d, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size"), p_brand_target=6),
    "target_encode_folds": lambda s, d: rounded(op.target_encode(
        table(s, d, "part").select("p_partkey", "p_name", "p_size"), "p_name", "p_size", "p_partkey", 5), p_name_target=6),
    "make_features": lambda s, d: rounded(op.make_features(
        table(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), [("p_size", "p_retailprice")], ["p_size"],
        [("p_retailprice", "p_size")], [("p_retailprice", "p_brand")]),
        p_size_x_p_retailprice=4, p_retailprice_to_p_size_ratio=5, p_retailprice_mean_by_p_brand=5).drop("p_brand"),
    "apply_cleaning": _clean_messy,
}


def _dates(s, d):
    o = table(s, d, "orders")
    day = F.col("o_orderdate")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
                    .when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "MM/dd/yyyy"))
                    .when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "MM-dd-yyyy")).otherwise("unknown").alias("day_text"))


def _iqr(s, d, mode):
    df = messy(s, d).select("status", "price")
    return op.iqr_filter(df, op.fit_iqr(df, ["price"]), mode)


PRICE_BOUNDS = f"{MESSY}, {long_cte(['price'], 'messy')}, {QUART}"

ORACLES = {
    "source_union_tables": """SELECT *, 'customer' AS _source_table FROM customer UNION ALL BY NAME SELECT *, 'supplier' AS _source_table FROM supplier
        UNION ALL BY NAME SELECT *, 'nation' AS _source_table FROM nation""",
    "source_csv": "SELECT * FROM customer",
    "source_json": "SELECT * FROM customer",
    "source_text_docs": "SELECT item_id, text FROM benchmark",
    "table_catalog": union(f"SELECT '{t}' AS table_name, count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE {t})) AS column_count, "
                           f"(SELECT string_agg(column_name, ',') FROM (DESCRIBE {t})) AS column_names FROM {t}" for t in TABLES),
    "registry_summary": f"""WITH {', '.join(pii_sql(t, cols, [c for c in cols if c.endswith('name') or c.endswith('segment')]).replace('pii AS', f'pii_{t} AS', 1) for t, cols in SCHEMA_COLS.items())}
        SELECT 4::bigint AS tables, 100.0::double AS mean_completeness, ({' + '.join(f'(SELECT count(*) FROM pii_{t})' for t in SCHEMA_COLS)})::bigint AS governance_findings""",
    "report_sink": "SELECT 'completeness' AS section, 8::bigint AS entries UNION ALL SELECT 'duplicates', 1",
    "compare_tables": union(f"""SELECT '{a}' AS left_table, '{b}' AS right_table, '{c}' AS column_name, true AS same_kind, (SELECT count(*) FROM {a}) AS left_rows,
        (SELECT count(*) FROM {b}) AS right_rows, (SELECT count(DISTINCT {c}) FROM {a}) AS left_distinct, (SELECT count(DISTINCT {c}) FROM {b}) AS right_distinct"""
        for a, b, c in [("benchmark", "documents", "text"), ("conversations", "documents", "text"), ("benchmark", "conversations", "text"), ("documents", "labels", "doc_id")]),
    "select_checked": "SELECT o_orderkey, o_totalprice FROM orders",
    "drop_null_target": f"WITH {LABELLED} SELECT * FROM labelled WHERE quality IS NOT NULL",
    "impute": f"""WITH {SPARSE}, f AS (SELECT quantile_cont(l_discount, 0.5) AS md, quantile_cont(l_tax, 0.5) AS mt FROM sparse)
        SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(coalesce(l_discount, md)), 6) AS discount, round(sum(coalesce(l_tax, mt)), 6) AS tax
        FROM sparse, f GROUP BY l_orderkey, l_linenumber""",
    "fill_for_scoring": f"""WITH {LABELLED} SELECT doc_id, text, lang, CASE WHEN doc_id % 4 > 0 THEN source ELSE 'missing' END AS source, n_chars,
        coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM labelled""",
    "forward_fill": """SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reading FROM events""",
    "standardize_case": "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer",
    "to_datetime": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "to_number": f"""WITH {MESSY}, n AS (SELECT status, try_cast(replace(price_text, ',', '') AS DOUBLE) AS v FROM messy)
        SELECT status, count(v) AS n, max(v) AS top, min(v) AS low FROM n GROUP BY status""",
    "iqr_filter": f"""WITH {PRICE_BOUNDS} SELECT status, count(*) AS n, max(price) AS top FROM messy, o WHERE price BETWEEN lower_bound AND upper_bound GROUP BY status""",
    "iqr_cap": f"""WITH {PRICE_BOUNDS}, c AS (SELECT status, greatest(lower_bound, least(upper_bound, price)) AS v FROM messy, o)
        SELECT status, count(*) AS n, round(max(v), 4) AS top, round(min(v), 4) AS low FROM c GROUP BY status""",
    "drop_duplicates": "SELECT DISTINCT lang, source FROM documents",
    "log_transform": f"SELECT p_partkey, {r('ln(1 + p_retailprice)')} AS p_retailprice FROM part",
    "scale_standard": f"""SELECT c_custkey, {r('(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()')} AS c_acctbal,
        {r('(c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER ()')} AS c_nationkey FROM customer""",
    "scale_minmax": f"""SELECT c_custkey, {r('(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ())')} AS c_acctbal,
        {r('(c_nationkey - min(c_nationkey) OVER ()) / (max(c_nationkey) OVER () - min(c_nationkey) OVER ())::double')} AS c_nationkey FROM customer""",
    "user_transform": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity > 48",
    "one_hot": """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS s FROM orders)
        SELECT o_orderkey, coalesce(s = 'F', false)::int AS "status_F", coalesce(s = 'O', false)::int AS "status_O", coalesce(s = 'P', false)::int AS "status_P",
        (s IS NULL)::int AS status_nan FROM t""",
    "label_encode": """WITH c AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0))
        SELECT p_partkey, coalesce(code, 0)::bigint AS p_name FROM part LEFT JOIN c USING (p_name)""",
    "label_codes": "SELECT c_name AS value, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer)",
    "target_encode": f"SELECT p_partkey, p_brand, p_size, {r('avg(p_size) OVER (PARTITION BY p_brand)')} AS p_brand_target FROM part",
    "target_encode_folds": f"""WITH t AS (SELECT *, ('0x' || substr(md5(p_partkey::varchar), 1, 8))::bigint % 5 AS fold FROM part),
        s AS (SELECT p_name, fold, sum(p_size) AS s, count(*) AS n FROM t GROUP BY ALL),
        o AS (SELECT p_name, fold, (sum(s) OVER (PARTITION BY p_name) - s)::double / nullif(sum(n) OVER (PARTITION BY p_name) - n, 0) AS m FROM s),
        f AS (SELECT fold, sum(p_size) AS s, count(*) AS n FROM t GROUP BY fold), g AS (SELECT fold, ((sum(s) OVER () - s)::double / (sum(n) OVER () - n)) AS rest FROM f)
        SELECT p_partkey, t.p_name, p_size, {r('coalesce(m, rest)')} AS p_name_target FROM t JOIN o USING (p_name, fold) JOIN g USING (fold)""",
    "make_features": f"""SELECT p_partkey, p_size, p_retailprice, {r('p_size * p_retailprice', 4)} AS p_size_x_p_retailprice, (p_size * p_size)::double AS p_size_squared,
        {r('p_retailprice / (p_size + 1e-8)', 5)} AS p_retailprice_to_p_size_ratio, {r('avg(p_retailprice) OVER (PARTITION BY p_brand)', 5)} AS p_retailprice_mean_by_p_brand FROM part""",
    "apply_cleaning": f"""WITH {PRICE_BOUNDS}, k AS (SELECT DISTINCT lower(priority) AS priority, day_text, price_text, price, status FROM messy, o
          WHERE price BETWEEN lower_bound AND upper_bound)
        SELECT count(*) AS row_count, count(DISTINCT priority) AS priorities, max(price) AS max_price,
          sum(replace(price_text, ',', '')::decimal(18,2))::double AS price_sum, max(day_text) AS last_day FROM k""",
}

#: The same check with codes from all parts.
ORACLES["label_encode_all"] = ORACLES["label_encode"].replace(" WHERE p_partkey % 2 = 0", "")
