"""Modeling and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clustering as cl, cleaning, modeling as op
from tidemark.session import scratch_path
from workloads.common import LABELLED, NUMERIC, each, labelled, r, rounded, table, union
from workloads.profiling import LAB_KINDS, PART_KINDS
from workloads.quality import QUART, long_cte

LAB_NUM = ["doc_id", "n_chars", "quality", "toxic"]


def facts_sql(source, kinds):
    return "f0 AS (" + union(
        f"""SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS row_count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_count FROM {source}"""
        for c, k in kinds.items()) + """), f AS (SELECT *, missing * 100.0::double / row_count AS missing_pct, distinct_count / row_count::double AS unique_ratio FROM f0)"""


ROLE = """CASE WHEN missing_pct > 50 THEN 'poor_feature' WHEN kind = 'numeric' THEN CASE WHEN distinct_count = 2 THEN 'binary_target_or_feature'
  WHEN distinct_count < 10 AND unique_ratio < 0.1 THEN 'categorical_target_or_feature' WHEN unique_ratio > 0.95 THEN 'identifier' ELSE 'numeric_feature_or_target' END
  WHEN unique_ratio > 0.95 THEN 'identifier' WHEN distinct_count < 20 THEN 'categorical_feature_or_target' ELSE 'text_feature' END"""
SUIT = """CASE WHEN missing_pct > 10 THEN 'poor' WHEN kind = 'numeric' THEN CASE WHEN distinct_count = 2 THEN 'excellent_binary_classification'
  WHEN distinct_count > 2 AND distinct_count <= 10 AND unique_ratio < 0.1 THEN 'good_multiclass_classification' WHEN distinct_count > 10 AND unique_ratio > 0.1 THEN 'good_regression' ELSE 'fair' END
  WHEN distinct_count BETWEEN 2 AND 20 THEN 'good_classification' ELSE 'poor' END"""
QUAL = """CASE WHEN missing_pct > 70 THEN 'poor' WHEN missing_pct > 30 THEN 'fair' WHEN kind = 'numeric' AND distinct_count = 1 THEN 'poor'
  WHEN kind = 'text' AND unique_ratio > 0.95 THEN 'poor' WHEN unique_ratio < 0.01 THEN 'fair' ELSE 'good' END"""
PROB = """CASE WHEN kind = 'numeric' THEN CASE WHEN distinct_count = 2 THEN 'binary_classification' WHEN distinct_count <= 10 AND unique_ratio < 0.1 THEN 'multiclass_classification' ELSE 'regression' END
  WHEN distinct_count > 20 THEN 'text_classification' WHEN distinct_count > 2 THEN 'multiclass_classification' ELSE 'binary_classification' END"""
MCOLS = f"m AS (SELECT column_name, kind, missing, missing_pct, distinct_count, unique_ratio, {ROLE} AS modeling_role, {SUIT} AS target_suitability, {QUAL} AS feature_quality, {PROB} AS problem_type FROM f)"
SUGGEST = """SELECT column_name, target_suitability, problem_type, distinct_count, {r} AS missing_pct, weight FROM (SELECT *, CASE target_suitability WHEN 'excellent_binary_classification' THEN 5
  WHEN 'good_multiclass_classification' THEN 4 WHEN 'good_regression' THEN 4 WHEN 'good_classification' THEN 3 ELSE 2 END::bigint AS weight FROM m WHERE target_suitability <> 'poor')""".replace("{r}", r("missing_pct"))


def lines(s, d):
    """lineitem with a row key, part size and order priority: classification and regression input."""
    line = table(s, d, "lineitem").withColumn("line_id", F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string")))
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size", "p_retailprice")
    return (line.join(part, "l_partkey")
            .withColumn("large", (F.col("l_extendedprice") > 50000).cast("int"))
            .withColumn("band", F.when(F.col("l_quantity") < 17, "low").when(F.col("l_quantity") < 34, "mid").otherwise("high"))
            .withColumn("worth", F.col("l_quantity") * 1000 + F.col("p_size") * 10 + F.col("l_discount") * 500)
            .select("line_id", "large", "band", "worth", "l_quantity", "l_discount", "l_tax", "p_size", "p_brand", "p_type", "l_returnflag"))


def _trained(s, d, target, features, problem, model):
    return op.train(lines(s, d), "line_id", target, features, problem, model)


BIN = ["l_quantity", "l_discount", "p_size", "p_brand", "l_returnflag"]
MULTI = ["l_quantity", "l_tax", "p_type"]
REG = ["l_quantity", "l_discount", "p_size"]


def _class(s, d, target, features, model):
    _, test = _trained(s, d, target, features, "classification", model)
    return op.classification_metrics(test, target)


def _reg(s, d, model):
    _, test = _trained(s, d, "worth", REG, "regression", model)
    return op.regression_metrics(test, "worth")


def _auc(s, d):
    _, test = _trained(s, d, "large", BIN, "classification", "logistic_regression")
    return op.roc_auc(test, F.col("large") == 1, F.col("probabilities")[1])


def _importance(s, d):
    model, _ = _trained(s, d, "large", BIN, "classification", "decision_tree")
    return op.feature_importance(model, s, by_source=True)


def _store(s, d):
    path = scratch_path(s, "models")
    model, _ = _trained(s, d, "band", MULTI, "classification", "decision_tree")
    op.save_model(model, s, path, "bands")
    again = op.load_model(s, path, "bands")
    rows = lines(s, d)
    a = op.score(model, rows, "line_id").select("line_id", F.col("prediction").alias("p"))
    b = op.score(again, rows, "line_id").select("line_id", F.col("prediction").alias("q"))
    same = a.join(b, "line_id").agg(F.count_if(F.col("p") != F.col("q")).alias("differences"), F.count(F.lit(1)).alias("rows"))
    return same.withColumn("models", F.lit(op.list_models(s, path).count()))


def _ols(s, d):
    model, _ = _trained(s, d, "worth", ["l_quantity"], "regression", "linear_regression")
    fitted = model.pipeline.stages[-1]
    rows = lines(s, d)
    # the fitted line applied to every row: comparable with SQL regression functions on the train part
    return rows.select(F.round(F.avg(F.lit(float(fitted.coefficients[0])) * F.col("l_quantity") + float(fitted.intercept)), 3).alias("mean_prediction"),
                       F.lit(round(float(fitted.coefficients[0]), 4)).alias("slope")).limit(1)


def scored_lines(s, d):
    """Predictions by fixed rules, so that the metrics can be checked against SQL."""
    line = table(s, d, "lineitem")
    return line.select(
        (F.col("l_extendedprice") > 50000).cast("int").alias("actual"), (F.col("l_quantity") > 25).cast("int").alias("guess"),
        F.col("l_returnflag").alias("flag"), F.when(F.col("l_quantity") % 3 == 0, "A").when(F.col("l_quantity") % 3 == 1, "N").otherwise("R").alias("flag_guess"),
        F.col("l_quantity").alias("score"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 1500).alias("price_guess"))


SCORED = """scored AS (SELECT (l_extendedprice > 50000)::int AS actual, (l_quantity > 25)::int AS guess, l_returnflag AS flag,
  CASE WHEN l_quantity % 3 = 0 THEN 'A' WHEN l_quantity % 3 = 1 THEN 'N' ELSE 'R' END AS flag_guess, l_quantity AS score, l_extendedprice AS price, l_quantity * 1500 AS price_guess FROM lineitem)"""


def _knn(s, d, problem):
    cust, supp = table(s, d, "customer"), table(s, d, "supplier")
    # suppliers are asked against all customers on balance and nation
    corpus = cust.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("vec"),
                         (F.col("c_nationkey") % 3).cast("double").alias("label"))
    asked = supp.select(F.col("s_suppkey").alias("query_id"), F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double") + 0.3).alias("vec"))
    return op.knn_predict(asked, corpus, 5, problem)


KNN = """n AS (SELECT s_suppkey AS query_id, c_custkey AS id, (c_nationkey % 3)::double AS label,
   sqrt(power(s_acctbal / 1000 - c_acctbal / 1000, 2) + power(s_nationkey + 0.3::double - c_nationkey, 2)) AS dist FROM supplier, customer),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rn FROM n), five AS (SELECT * FROM k WHERE rn <= 5)"""


def blobs(s, d):
    """customer spread over three far-apart squares on a fine grid, with a few lone outliers."""
    c = table(s, d, "customer")
    h = cleaning.key_hash(F.col("c_custkey"))
    blob = F.pmod(h, F.lit(3))
    x = F.pmod(F.floor(h / 3), F.lit(40)) * 0.05
    y = F.pmod(F.floor(h / 120), F.lit(40)) * 0.05
    lone = F.col("c_custkey") % 250 == 7
    return c.select(F.col("c_custkey").alias("id"), F.when(lone, -1).otherwise(blob).alias("blob"),
                    F.when(lone, 1000.0 + F.col("c_custkey") * 10.0).otherwise(blob * 20.0 + x).alias("x"),
                    F.when(lone, 0.0).otherwise(y).alias("y"))


BLOBS = """h AS (SELECT c_custkey, ('0x' || substr(md5(c_custkey::varchar), 1, 8))::bigint AS h FROM customer),
 blobs AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 250 = 7 THEN -1 ELSE h % 3 END AS blob,
   CASE WHEN c_custkey % 250 = 7 THEN 1000.0::double + c_custkey * 10 ELSE (h % 3) * 20.0::double + ((h // 3) % 40) * 0.05::double END AS x,
   CASE WHEN c_custkey % 250 = 7 THEN 0.0::double ELSE ((h // 120) % 40) * 0.05::double END AS y FROM h)"""


def _points(s, d):
    return blobs(s, d).select("id", F.array("x", "y").alias("vec"))


def _main_points(s, d):
    return blobs(s, d).filter("blob >= 0").select("id", F.array("x", "y").alias("vec"))


def _distinct_points(s, d):
    """The main points, each moved by its key: as many distinct points as rows."""
    return blobs(s, d).filter("blob >= 0").select("id", F.array(F.col("x") + F.col("id") * 1e-7, "y").alias("vec"))


def _numbered(clustered):
    """Clusters named by their smallest id, comparable whatever the algorithm's numbering."""
    names = clustered.groupBy("cluster").agg(F.min("id").alias("name"))
    return clustered.join(F.broadcast(names), "cluster").select("id", "name")


NAMES = "SELECT id, min(id) OVER (PARTITION BY blob) AS name FROM blobs WHERE blob >= 0"

QUERIES = {
    "modeling_columns": lambda s, d: rounded(op.modeling_columns(labelled(s, d)), missing_pct=6, unique_ratio=6),
    "modeling_columns_part": lambda s, d: rounded(op.modeling_columns(table(s, d, "part")), missing_pct=6, unique_ratio=6),
    "modeling_numeric": lambda s, d: rounded(op.modeling_numeric(labelled(s, d)), mean=4, median=4, std=4, skewness=5),
    "suggest_targets": lambda s, d: rounded(op.suggest_targets(labelled(s, d)), missing_pct=6),
    "suggest_targets_part": lambda s, d: rounded(op.suggest_targets(table(s, d, "part")), missing_pct=6),
    "class_balance": lambda s, d: rounded(op.class_balance(labelled(s, d)), balance=6),
    "modeling_recommendations": lambda s, d: rounded(op.modeling_recommendations(labelled(s, d)), measure=6),
    "feature_summary": lambda s, d: op.feature_summary(table(s, d, "part")),
    "train_test_split": lambda s, d: rounded(op.split_shares(op.train_test_split(
        table(s, d, "orders"), "o_orderkey", stratify="o_orderstatus"), "o_orderstatus"), test_share=6),
    "train_test_split_rows": lambda s, d: op.train_test_split(table(s, d, "customer"), "c_custkey").select("c_custkey", "part"),
    "train_random_forest": lambda s, d: _class(s, d, "band", MULTI, "random_forest"),
    "train_random_forest_regression": lambda s, d: _reg(s, d, "random_forest"),
    "train_logistic_regression": lambda s, d: _class(s, d, "large", BIN, "logistic_regression"),
    "train_linear_regression": lambda s, d: _ols(s, d),
    "train_decision_tree": lambda s, d: _class(s, d, "band", MULTI, "decision_tree"),
    "train_decision_tree_regression": lambda s, d: _reg(s, d, "decision_tree"),
    "train_knn": lambda s, d: _class(s, d, "band", ["l_quantity", "l_tax"], "knn"),
    "train_naive_bayes": lambda s, d: _class(s, d, "band", ["l_quantity", "l_tax"], "naive_bayes"),
    "train_svm": lambda s, d: _class(s, d, "band", ["l_quantity", "p_size"], "svm"),
    "train_auto": lambda s, d: _class(s, d, "large", BIN, "auto"),
    "knn_classify": lambda s, d: rounded(_knn(s, d, "classification"), confidence=6),
    "knn_regress": lambda s, d: rounded(_knn(s, d, "regression").drop("confidence"), prediction=6),
    "classification_metrics_binary": lambda s, d: rounded(op.classification_metrics(scored_lines(s, d), "actual", "guess"),
                                                          accuracy=6, precision=6, recall=6, f1=6),
    "classification_metrics_weighted": lambda s, d: rounded(op.classification_metrics(scored_lines(s, d), "flag", "flag_guess"),
                                                            accuracy=6, precision=6, recall=6, f1=6),
    "roc_auc": lambda s, d: rounded(op.roc_auc(scored_lines(s, d), F.col("actual") == 1, F.col("score")), roc_auc=6),
    "roc_auc_model": _auc,
    "regression_metrics": lambda s, d: rounded(op.regression_metrics(scored_lines(s, d), "price", "price_guess"), mse=1, rmse=3, mae=3, r2=6),
    "feature_importance": _importance,
    "model_store": _store,
    "mutual_information": lambda s, d: rounded(op.mutual_information(
        table(s, d, "part").withColumn("size_band", F.floor(F.col("p_size") / 10).cast("string")), "size_band"), mutual_information=6),
    "rank_features": lambda s, d: rounded(op.rank_features(
        table(s, d, "part").withColumn("size_band", F.floor(F.col("p_size") / 10).cast("string")), "size_band"), mutual_information=6),
    "feature_recommendations": lambda s, d: op.feature_recommendations(
        table(s, d, "part").withColumn("twice", F.col("p_retailprice") * 2), "p_size"),
    "prepare_features": lambda s, d: cl.prepare_features(table(s, d, "lineitem").withColumn(
        "k", F.lit(0)), "k", ["l_quantity", "l_discount"]).agg(
        F.round(F.sum(F.abs(F.col("vec")[0])), 3).alias("a"), F.round(F.sum(F.abs(F.col("vec")[1])), 3).alias("b")),
    "kmeans": lambda s, d: _numbered(cl.kmeans(_main_points(s, d), 3)),
    "silhouette": lambda s, d: rounded(cl.silhouette(_main_points(s, d).withColumn("cluster", F.pmod("id", F.lit(3)).cast("long"))), silhouette=6),
    "silhouette_exact": lambda s, d: rounded(cl.silhouette(_main_points(s, d).withColumn(
        "cluster", F.floor(F.col("vec")[0] / 10).cast("long")), exact=True), silhouette=6),
    "dbscan": lambda s, d: cl.dbscan(_points(s, d), 0.6, 5).select("id", "cluster"),
    "dbscan_counts": lambda s, d: cl.cluster_count(cl.dbscan(_points(s, d), 0.6, 5)),
    "hierarchical_single": lambda s, d: _numbered(cl.hierarchical(_main_points(s, d), 3, "single")),
    "hierarchical_ward": lambda s, d: _numbered(cl.hierarchical(_main_points(s, d), 3, "ward")),
    "hierarchical_average": lambda s, d: _numbered(cl.hierarchical(_main_points(s, d), 3, "average")),
    "kmeans_all": lambda s, d: _numbered(cl.kmeans(_points(s, d), 3)),
    "silhouette_all": lambda s, d: rounded(cl.silhouette(_points(s, d).withColumn("cluster", F.pmod("id", F.lit(3)).cast("long"))), silhouette=6),
    "silhouette_exact_all": lambda s, d: rounded(cl.silhouette(_points(s, d).withColumn(
        "cluster", F.floor(F.col("vec")[0] / 10).cast("long")), exact=True), silhouette=6),
    "hierarchical_single_all": lambda s, d: _numbered(cl.hierarchical(_points(s, d), 3, "single")),
    "hierarchical_ward_all": lambda s, d: _numbered(cl.hierarchical(_points(s, d), 3, "ward")),
    "hierarchical_average_all": lambda s, d: _numbered(cl.hierarchical(_points(s, d), 3, "average")),
    "hierarchical_single_distinct": lambda s, d: _numbered(cl.hierarchical(_distinct_points(s, d), 3, "single")),
    "hierarchical_ward_distinct": lambda s, d: _numbered(cl.hierarchical(_distinct_points(s, d), 3, "ward")),
    "hierarchical_average_distinct": lambda s, d: _numbered(cl.hierarchical(_distinct_points(s, d), 3, "average")),
}

MI = """cells AS ({cells}), c2 AS (SELECT column_name, x, y, count(*)::double AS n FROM cells GROUP BY ALL),
 c3 AS (SELECT *, sum(n) OVER (PARTITION BY column_name, x) AS nx, sum(n) OVER (PARTITION BY column_name, y) AS ny, sum(n) OVER (PARTITION BY column_name) AS t FROM c2),
 mi AS (SELECT column_name, sum(n / t * ln(n * t / (nx * ny))) AS mutual_information FROM c3 GROUP BY column_name)"""
PART_CELLS = union(
    [f"SELECT '{c}' AS column_name, " + "(" + " + ".join(f"({c} > (SELECT quantile_cont({c}::double, {i}::double / 10) FROM part))::int" for i in range(1, 10)) + ")::varchar AS x, (p_size // 10)::varchar AS y FROM part"
     for c in NUMERIC["part"]] + [f"SELECT '{c}', {c}, (p_size // 10)::varchar FROM part" for c in ("p_name", "p_brand", "p_type")])
PART_MI = "WITH " + MI.replace("{cells}", PART_CELLS)
PARTS = f"""{SCORED}, per AS (SELECT label, sum(actual) AS actual, sum(predicted) AS predicted, sum(hit) AS hit FROM
  (SELECT {{y}} AS label, 1 AS actual, 0 AS predicted, ({{y}} = {{p}})::int AS hit FROM scored UNION ALL SELECT {{p}}, 0, 1, 0 FROM scored) GROUP BY label),
 prf AS (SELECT *, coalesce(hit / nullif(predicted, 0)::double, 0) AS pr, coalesce(hit / nullif(actual, 0)::double, 0) AS re FROM per),
 prf1 AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM prf)"""

ORACLES = {
    "modeling_columns": f"WITH {LABELLED}, {facts_sql('labelled', LAB_KINDS)}, {MCOLS} SELECT * REPLACE ({r('missing_pct')} AS missing_pct, {r('unique_ratio')} AS unique_ratio) FROM m",
    "modeling_columns_part": f"WITH {facts_sql('part', PART_KINDS)}, {MCOLS} SELECT * REPLACE ({r('missing_pct')} AS missing_pct, {r('unique_ratio')} AS unique_ratio) FROM m",
    "modeling_numeric": f"""WITH {LABELLED}, {long_cte(LAB_NUM, 'labelled')}, {QUART}, s AS ({each(LAB_NUM, "SELECT '{c}' AS column_name, min({c})::double AS minimum, max({c})::double AS maximum, "
        + r("avg({c})", 4) + " AS mean, " + r("quantile_cont({c}::double, 0.5)", 4) + " AS median, " + r("stddev_samp({c})", 4) + " AS std, " + r("skewness({c})", 5) + " AS skewness, count(*) FILTER (WHERE {c} = 0) AS zeros FROM labelled")})
        SELECT s.*, outliers, CASE WHEN abs(skewness) < 0.5 THEN 'normal' WHEN skewness > 1 THEN 'right_skewed' WHEN skewness < -1 THEN 'left_skewed' ELSE 'slightly_skewed' END AS shape FROM s JOIN o USING (column_name)""",
    "suggest_targets": f"WITH {LABELLED}, {facts_sql('labelled', LAB_KINDS)}, {MCOLS} {SUGGEST}",
    "suggest_targets_part": f"WITH {facts_sql('part', PART_KINDS)}, {MCOLS} {SUGGEST}",
    "class_balance": f"""WITH {LABELLED}, vc AS ({each(LAB_KINDS, "SELECT '{c}' AS column_name, count(*) AS n FROM labelled WHERE {c} IS NOT NULL GROUP BY {c}")}),
        b AS (SELECT column_name, count(*) AS distinct_count, min(n) / max(n)::double AS balance FROM vc GROUP BY column_name HAVING count(*) BETWEEN 2 AND 20)
        SELECT column_name, distinct_count, {r('balance')} AS balance, CASE WHEN balance > 0.8 THEN 'well_balanced' WHEN balance > 0.5 THEN 'moderately_balanced' WHEN balance > 0.1 THEN 'imbalanced' ELSE 'highly_imbalanced' END AS status FROM b""",
    "modeling_recommendations": f"""WITH {LABELLED}, {facts_sql('labelled', LAB_KINDS)}, {long_cte(LAB_NUM, 'labelled')}, {QUART},
        z AS (SELECT sum(missing) * 100.0::double / sum(row_count) AS share, max(row_count) AS n, count(*) FILTER (WHERE kind = 'text' AND distinct_count > 20) AS w, count(*) FILTER (WHERE kind = 'numeric') AS k,
          (SELECT count(*) FROM o WHERE outliers > 0.05 * row_count) AS oc FROM f),
        t AS (SELECT 'handle_missing' AS rule, 'high' AS priority, share AS measure FROM z WHERE share > 20 UNION ALL SELECT 'encode_text', 'high', w FROM z WHERE w > 0
          UNION ALL SELECT 'scale_features', 'medium', k FROM z WHERE k > 1 UNION ALL SELECT 'small_data', 'medium', n FROM z WHERE n < 1000 UNION ALL SELECT 'treat_outliers', 'medium', oc FROM z WHERE oc > 0)
        SELECT rule, priority, {r('measure')} AS measure FROM t""",
    "feature_summary": f"""WITH {facts_sql('part', PART_KINDS)}, {MCOLS} SELECT 'kind' AS "grouping", kind AS label, count(*) AS columns FROM m GROUP BY kind UNION ALL SELECT 'quality', feature_quality, count(*) FROM m GROUP BY feature_quality""",
    "train_test_split": f"""SELECT o_orderstatus AS target, count(*) FILTER (WHERE t) AS test, count(*) AS total, {r('count(*) FILTER (WHERE t) / count(*)::double')} AS test_share
        FROM (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::bigint, o_orderkey::varchar)
          <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2::double + 0.5) AS t FROM orders) GROUP BY o_orderstatus""",
    "train_test_split_rows": """SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || c_custkey), 1, 8))::bigint, c_custkey::varchar)
        <= ceil(count(*) OVER () * 0.2::double) THEN 'test' ELSE 'train' END AS part FROM customer""",
    "train_linear_regression": """WITH t0 AS (SELECT l_quantity, l_quantity * 1000 + p_size * 10 + l_discount * 500 AS worth,
          concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
        t AS (SELECT *, rank() OVER (ORDER BY ('0x' || substr(md5('42:' || k), 1, 8))::bigint, k) > ceil(count(*) OVER () * 0.2::double) AS train FROM t0),
        f AS (SELECT regr_slope(worth, l_quantity) AS s, regr_intercept(worth, l_quantity) AS i FROM t WHERE train)
        SELECT round(avg(s * l_quantity + i), 3) AS mean_prediction, round(any_value(s), 4) AS slope FROM t, f""",
    "knn_classify": f"""WITH {KNN}, v AS (SELECT query_id, label, count(*) AS c FROM five GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, label) AS r FROM v)
        SELECT query_id, label AS prediction, {r('c / 5.0::double')} AS confidence FROM w WHERE r = 1""",
    "knn_regress": f"WITH {KNN} SELECT query_id, {r('avg(label)')} AS prediction FROM five GROUP BY query_id",
    "classification_metrics_binary": f"""WITH {PARTS.replace('{y}', 'actual').replace('{p}', 'guess')} SELECT (SELECT count(*) FROM scored) AS "rows", 2::bigint AS classes,
        (SELECT {r('avg((actual = guess)::int)')} FROM scored) AS accuracy, {r('pr')} AS precision, {r('re')} AS recall, {r('f')} AS f1 FROM prf1 WHERE label = 1""",
    "classification_metrics_weighted": f"""WITH {PARTS.replace('{y}', 'flag').replace('{p}', 'flag_guess')} SELECT sum(actual)::bigint AS "rows", count(*) FILTER (WHERE actual > 0) AS classes, {r('sum(hit) / sum(actual)::double')} AS accuracy,
        {r('sum(pr * actual) / sum(actual)')} AS precision, {r('sum(re * actual) / sum(actual)')} AS recall, {r('sum(f * actual) / sum(actual)')} AS f1 FROM prf1""",
    "roc_auc": f"""WITH {SCORED}, g AS (SELECT score, sum(actual) AS pos, count(*) - sum(actual) AS neg FROM scored GROUP BY score),
        k AS (SELECT pos, neg, sum(pos) OVER () - sum(pos) OVER (ORDER BY score) AS above FROM g)
        SELECT {r('sum(neg * (above + pos / 2.0::double)) / (sum(pos)::double * sum(neg)::double)')} AS roc_auc, sum(pos)::bigint AS positives, sum(neg)::bigint AS negatives FROM k""",
    "regression_metrics": f"""WITH {SCORED} SELECT count(*) AS "rows", {r('avg((price - price_guess) * (price - price_guess))', 1)} AS mse, {r('sqrt(avg((price - price_guess) * (price - price_guess)))', 3)} AS rmse,
        {r('avg(abs(price - price_guess))', 3)} AS mae, {r('1 - avg((price - price_guess) * (price - price_guess)) / var_pop(price)')} AS r2 FROM scored""",
    "mutual_information": f"{PART_MI} SELECT column_name, {r('mutual_information')} AS mutual_information FROM mi",
    "rank_features": f"{PART_MI} SELECT column_name, {r('mutual_information')} AS mutual_information, mutual_information > 0.1 AS strong, mutual_information > 0.05 AS selected FROM mi",
    "prepare_features": """WITH z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a, (l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER () AS b FROM lineitem)
        SELECT round(sum(abs(a)), 3) AS a, round(sum(abs(b)), 3) AS b FROM z""",
    "kmeans": f"WITH {BLOBS} {NAMES}",
    "silhouette": f"""WITH {BLOBS}, p AS (SELECT id, id % 3 AS c, x, y FROM blobs WHERE blob >= 0), n AS (SELECT c, count(*) AS n FROM p GROUP BY c),
        s AS (SELECT a.id, a.c, b.c AS o, sum(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS t, count(*) AS n FROM p a, p b GROUP BY ALL),
        q AS (SELECT id, max(CASE WHEN c = o THEN t / (n - 1) END) AS a, min(CASE WHEN c <> o THEN t / n END) AS b FROM s GROUP BY id)
        SELECT {r('avg((b - a) / greatest(a, b))')} AS silhouette, count(*) AS "rows" FROM q""",
    "silhouette_exact": f"""WITH {BLOBS}, p AS (SELECT id, floor(x / 10) AS c, x, y FROM blobs WHERE blob >= 0),
        s AS (SELECT a.id, a.c, b.c AS o, sum(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS t, count(*) AS n FROM p a, p b GROUP BY ALL),
        q AS (SELECT id, max(CASE WHEN c = o THEN t / (n - 1) END) AS a, min(CASE WHEN c <> o THEN t / n END) AS b FROM s GROUP BY id)
        SELECT {r('avg((b - a) / greatest(a, b))')} AS silhouette, count(*) AS "rows" FROM q""",
    "dbscan": f"""WITH {BLOBS}, m AS (SELECT blob, row_number() OVER (ORDER BY min(id)) - 1 AS cluster FROM blobs WHERE blob >= 0 GROUP BY blob)
        SELECT id, coalesce(cluster, -1)::bigint AS cluster FROM blobs LEFT JOIN m USING (blob)""",
    "dbscan_counts": f"""WITH {BLOBS} SELECT 3::bigint AS clusters, count(*) FILTER (WHERE blob = -1) AS noise, count(*) AS "rows" FROM blobs""",
    "hierarchical_single": f"WITH {BLOBS} {NAMES}",
    "hierarchical_ward": f"WITH {BLOBS} {NAMES}",
    "hierarchical_average": f"WITH {BLOBS} {NAMES}",
    "hierarchical_single_distinct": f"WITH {BLOBS} {NAMES}",
    "hierarchical_ward_distinct": f"WITH {BLOBS} {NAMES}",
    "hierarchical_average_distinct": f"WITH {BLOBS} {NAMES}",
}

#: The same check on all points, lone ones too.
ORACLES["silhouette_all"] = ORACLES["silhouette"].replace(" WHERE blob >= 0", "")
