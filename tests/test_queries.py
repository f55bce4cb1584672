"""Registered queries against their SQL at sf0.001; TIDEMARK_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import rows_of
from workloads.common import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = ["scan_quality", "uniqueness", "numeric_profile", "numeric_profile_ranked", "cramers_v", "semantic_types", "governance",
          "forward_fill", "apply_cleaning", "label_encode", "ks_2samp", "chi_square_2x2", "column_drift_psi", "monitor_drift",
          "fuzzy_match_levenshtein", "ngram_match", "correct_spelling", "vector_topk", "dedupe", "lineage", "roc_auc",
          "mutual_information", "knn_classify", "silhouette"]
CHOSEN = sorted(ORACLES) if os.environ.get("TIDEMARK_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", ["numeric_profile_ranked", "outlier_table", "ks_2samp", "cramers_v", "label_codes", "forward_fill",
                                  "correlations", "quality_metrics", "ngram_match", "near_duplicates", "roc_auc", "histogram"])
def test_plan_has_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 8
