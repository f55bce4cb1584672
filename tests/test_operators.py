"""Edge cases of quality, cleaning, drift, modeling and streaming operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import activity, cleaning as c, drift, modeling as mo, profiling, quality
from tidemark.session import scratch_path
from tidemark.sources import catalog, readers, sinks
from tidemark.streaming import monitors


def test_missing_thresholds(spark):
    rows = [(1.0 if i >= 5 else None, "a" if i >= 2 else None, None, i) for i in range(10)]
    got = {r.column_name: r for r in quality.missing_values(spark.createDataFrame(rows, "h double, q string, n string, f int")).collect()}
    assert got["h"].severity == "medium" and got["h"].suggested_fix == "drop_column"  # exactly 50%
    assert got["q"].severity == "low" and got["n"].severity == "high" and "f" not in got


def test_scan_of_empty_and_constant(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert quality.scan_quality(empty).count() == 0
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    row = profiling.numeric_profile(one).first()
    assert row.minimum == row.maximum == row.median == 1.0 and row.std is None


def test_cleaning_keeps_dates_and_numbers(spark):
    df = spark.createDataFrame([("2024-01-02", "1,234.5"), ("01/31/2024", "x"), ("soon", "7")], "d string, n string")
    got = c.to_number(c.to_datetime(df, "d"), "n").collect()
    assert [r.d and r.d.date() for r in got] == [dt.date(2024, 1, 2), dt.date(2024, 1, 31), None]
    assert [r.n for r in got] == [1234.5, None, 7.0]


def test_ffill_equals_plain_loop(spark):
    random.seed(1)
    rows = [(random.choice("aab"), i, random.choice([None, float(i)])) for i in range(400)]
    random.shuffle(rows)
    got = {r.t: r.v for r in c.ffill(spark.createDataFrame(rows, "k string, t int, v double").repartition(5), ["k"], ["t"], ["v"]).collect()}
    last = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        last[k] = v if v is not None else last.get(k)
        assert got[t] == last[k]


def test_imputer_modes_and_medians(spark):
    df = spark.createDataFrame([(1.0, "b", None), (None, "a", None), (4.0, None, None), (5.0, "a", None), (9.0, "b", None)],
                               "x double, s string, e string")
    fills = c.fit_imputer(df)
    assert fills == {"x": 4.5, "s": "a", "e": "missing"}
    assert c.impute(df, fills).filter("x is null or s is null or e is null").count() == 0


def test_one_hot_and_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("z",)], "s string")
    hot = c.one_hot(df, {"s": ["a", "b"]}).collect()
    assert [tuple(r) for r in hot] == [(0, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]
    codes = c.label_codes(df.filter("s <> 'z'"), "s")
    assert sorted(r.s for r in c.label_encode(df, "s", codes).collect()) == [0, 0, 0, 1]
    with pytest.raises(ValueError):
        c.fit_one_hot(spark.range(30).select(F.col("id").cast("string").alias("s")), ["s"])
    with pytest.raises(ValueError):
        c.select_checked(df, ["s", "nope"])


def test_drift_of_equal_and_apart_samples(spark):
    rows = [("ref", float(i), "x") for i in range(50)] + [("cur", float(i), "x") for i in range(50)]
    same = spark.createDataFrame(rows, "period string, v double, t string")
    got = {r.column_name: r for r in drift.column_drift(same, ["v", "t"]).collect()}
    assert got["v"].statistic == 0 and not got["v"].drift_detected and got["v"].severity == "none"
    assert got["t"].p_value == 1.0 and got["t"].statistic == 0.0
    apart = same.withColumn("v", F.when(F.col("period") == "cur", F.col("v") + 1000).otherwise(F.col("v")))
    far = drift.ks_2samp(apart, ["v"]).first()
    assert far.statistic == 1.0 and far.p_value < 1e-6
    swapped = apart.withColumn("period", F.when(F.col("period") == "cur", "ref").otherwise("cur"))
    assert drift.ks_2samp(swapped, ["v"]).first().statistic == 1.0


def test_yates_on_two_by_two(spark):
    rows = [("ref", "a")] * 10 + [("ref", "b")] * 20 + [("cur", "a")] * 30 + [("cur", "b")] * 5
    got = drift.chi_square(spark.createDataFrame(rows, "period string, t string"), ["t"]).first()
    assert got.dof == 1 and abs(got.statistic - 16.5777) < 1e-3 or abs(got.statistic - sum(
        (abs(o - e) - 0.5) ** 2 / e for o, e in ((10, 30 * 40 / 65), (20, 30 * 25 / 65), (30, 35 * 40 / 65), (5, 35 * 25 / 65)))) < 1e-9


def test_temporal_split_is_a_partition(spark):
    df = spark.range(101).select("id", (F.col("id") % 10).alias("day"))
    split = drift.split_temporal(df, ["day", "id"], 0.7)
    ref = {r.id for r in split.filter("period = 'ref'").collect()}
    want = sorted(range(101), key=lambda i: (i % 10, i))[:70]
    assert ref == set(want)


def test_train_score_and_store(spark):
    rows = [(i, float(i % 17), "abc"[i % 3], f"v{i % 40}", None if i % 9 == 0 else float(i % 5), "yes" if i % 17 > 8 else "no") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, x double, s string, w string, g double, y string")
    model, test = mo.train(df, "id", "y", ["x", "s", "w", "g"], "classification", "decision_tree")
    assert mo.classification_metrics(test, "y").first().accuracy == 1.0
    assert mo.feature_importance(model, spark).first().feature == "x"
    path = scratch_path(spark, "store")
    mo.save_model(model, spark, path, "one")
    again = mo.load_model(spark, path, "one")
    unseen = spark.createDataFrame([(1, 16.0, "q", "new", None), (2, 0.0, None, None, 1.0)], "id int, x double, s string, w string, g double")
    assert {r.id: r.prediction for r in mo.score(again, unseen, "id").collect()} == {1: "yes", 2: "no"}
    assert mo.list_models(spark, path).first().name == "one"
    with pytest.raises(ValueError):
        mo.score(model, unseen.drop("x"), "id")


def test_knn_model(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(200)], "id int, x double, y double")
    _, test = mo.train(df, "id", "y", ["x"], "regression", "knn")
    assert mo.regression_metrics(test, "y").first().r2 > 0.99


def test_readers_and_sinks(spark):
    base = scratch_path(spark, "io")
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, "line\nbreak")], "id int, t string")
    sinks.export(df, f"{base}/json", "json")
    assert readers.read_json(spark, f"{base}/json", "id int, t string").exceptAll(df).count() == 0
    sinks.export(df.filter("id = 1"), f"{base}/csv", "csv")
    assert readers.read_csv(spark, f"{base}/csv").first().t == 'say "hi", you'
    df.select("t").filter("t like 'line%'").write.text(f"{base}/text")
    assert readers.read_text_docs(spark, f"{base}/text").filter("text <> ''").first().text.startswith("line\nbreak")
    entry = catalog.table_catalog({"d": df}).first()
    assert entry.row_count == 2 and len(entry.sample_rows) == 2


def test_lineage_counts_each_node_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("z", "a")], "src string, dst string")
    got = {(r.direction, r.node): r.hops for r in activity.lineage(edges, "a", "both", 3).collect()}
    assert got == {("downstream", "b"): 1, ("downstream", "c"): 1, ("upstream", "c"): 1, ("upstream", "z"): 1, ("upstream", "b"): 2}


def _write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, "ts timestamp, v double").coalesce(1).write.mode(mode).parquet(path)


def test_monitor_drops_late_rows_and_restarts_cleanly(spark):
    src, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    day = lambda d, h=1: dt.datetime(2024, 3, d, h)
    base = monitors.fit_baseline(spark.createDataFrame([(day(1), float(i)) for i in range(100)], "ts timestamp, v double"), ["v"])
    _write(spark, src, [(day(2), float(i)) for i in range(50)] + [(day(4), 1.0)])

    def run():
        stream = spark.readStream.schema("ts timestamp, v double").parquet(src)
        return monitors.run_available(monitors.monitor_drift(stream, base, "ts"), out)

    first = run()
    assert [(r.window_start.day, r.rows) for r in first.collect()] == [(2, 50)]
    _write(spark, src, [(day(2), 500.0)] * 30 + [(day(9), 2.0)])  # the window of day 2 is closed
    again = sorted((r.window_start.day, r.rows) for r in run().collect())
    assert again == [(2, 50), (4, 1)]


def test_newest_rows_monitor_keeps_two_folders(spark, tmp_path):
    import os

    base = monitors.fit_baseline(spark.createDataFrame([(i, float(i)) for i in range(100)], "k long, v double"), ["v"])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(4):
        spark.createDataFrame([(n * 50 + i, float((n * 50 + i) % 130)) for i in range(50)], "k long, v double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, v double").option("maxFilesPerTrigger", 1).parquet(source)
    monitors.monitor_drift_batches(stream, base, ["k"], out, 60).awaitTermination()
    assert sorted(x for x in os.listdir(f"{out}/newest") if not x.startswith(".")) == ["2", "3"]
    rows = {r.batch_id: r["rows"] for r in spark.read.parquet(f"{out}/scores").collect()}
    assert rows == {0: 50, 1: 60, 2: 60, 3: 60}
    assert spark.read.parquet(f"{out}/newest/3").count() == 60
