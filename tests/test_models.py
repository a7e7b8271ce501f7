"""Values of the model operators against loops: folds at the same time, slices, the in-sample Sharpe ratio, splits, hold-out."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import cv, labels, sessions


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 180
    y = rng.integers(0, 2, n)
    t0 = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(i)) for i in rng.permutation(n)]
    pdf = pd.DataFrame({"row_id": np.arange(n), "symbol": "A", "t0": t0, "t1": [t + dt.timedelta(hours=2) for t in t0], "I_x": y + rng.normal(0, 0.3, n), "N_x": rng.normal(size=n), "label": y.astype(float), "w": 1.0})
    return spark.createDataFrame(pdf, "row_id long, symbol string, t0 timestamp_ntz, t1 timestamp_ntz, I_x double, N_x double, label double, w double").coalesce(1).cache()


def test_folds_at_the_same_time_score_as_one_by_one(spark, data):
    folds = cv.purged_kfold(data, 3).cache()
    table = cv.fold_table(data, folds)
    runs = [[(i, s) for i, s, _, _ in cv.cv_scores(data, folds, ["I_x", "N_x"], "accuracy", table=table, parallelism=p, num_trees=4)] for p in (1, 3)]
    assert runs[0] == runs[1] and [i for i, _ in runs[0]] == [0, 1, 2] and all(s > 0.7 for _, s in runs[0])
    # a fold's rows are those of its roles, and its scores those of the model on its test rows
    for i, s, model, te in cv.cv_scores(data, folds, ["I_x", "N_x"], "accuracy", table=table, num_trees=4):
        assert {r.row_id for r in te.collect()} == {r.row_id for r in folds.where((F.col("fold") == i) & (F.col("role") == "test")).collect()}
        p = model.transform(te).toPandas()
        assert np.isclose(s, (p.prediction == p.label).mean())


def test_jobs_keep_their_order(spark):
    assert cv.together(spark, [lambda k=k: k * k for k in range(9)], 4) == [k * k for k in range(9)]
    assert cv.together(spark, [], 4) == []


def test_sliced_importance_is_the_mean_of_the_slices(spark, data):
    def importance(rows):
        return rows.agg(F.avg("I_x").alias("I_x"), F.sum("N_x").alias("N_x")).unpivot([], ["I_x", "N_x"], "feature", "mean")
    out = {r.feature: r for r in cv.sliced_importance(data, F.col("row_id") % 3, 3, importance).collect()}
    p = data.toPandas()
    parts = [p[p.row_id % 3 == k] for k in range(3)]
    assert np.isclose(out["I_x"].sliced_mean, np.mean([q.I_x.mean() for q in parts])) and np.isclose(out["I_x"].whole_mean, p.I_x.mean())
    assert np.isclose(out["N_x"].sliced_mean, p.N_x.sum() / 3) and np.isclose(out["N_x"].whole_mean, p.N_x.sum())


def test_in_sample_sharpe_is_that_of_the_best_point(spark):
    found = spark.createDataFrame([(0, "a", 0.5, 0.1), (1, "b", 0.7, 0.2), (2, "c", 0.7, 0.3), (3, "d", -2.0, 0.1)], "point int, params string, mean_score double, std_score double")
    r = cv.is_sharpe(found).collect()
    assert [(x.point, x.params) for x in r] == [(1, "b")] and np.isclose(r[0].is_sharpe, 3.5)
    assert cv.is_sharpe(found.where("point = 0").withColumn("std_score", F.lit(0.0))).first().is_sharpe is None


def test_chronological_split(data):
    train, test = cv.chronological_split(data, 0.25)
    order = [r.row_id for r in data.orderBy("t0", "symbol").collect()]
    assert {r.row_id for r in train.collect()} == set(order[:135]) and {r.row_id for r in test.collect()} == set(order[135:])


def test_holdout_metrics_and_one_vs_rest(spark, data):
    train, test = cv.chronological_split(data, 0.25)
    model = cv.bagged_one_vs_rest(train, ["I_x", "N_x"], subsampling=0.6, num_trees=5, max_depth=3)
    p = model.transform(test).toPandas()
    r = cv.holdout_metrics(model, test).first()
    hit = ((p.prediction == 1) & (p.label == 1)).sum()
    assert r.test_rows == 45 and np.isclose(r.accuracy, (p.prediction == p.label).mean()) and r.accuracy > 0.75
    assert np.isclose(r.precision, hit / (p.prediction == 1).sum()) and np.isclose(r.recall, hit / (p.label == 1).sum())


def test_primary_scores_by_hand(spark):
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=k) for k in range(6)]
    sides, bins = [1, 1, -1, -1, 1, -1], [1, 0, 0, 1, 1, 0]
    ev = spark.createDataFrame([("A", a, s) for a, s in zip(t, sides)] + [("B", t[0], -1)], "symbol string, t0 timestamp_ntz, side int")
    b = spark.createDataFrame([("A", a, s) for a, s in zip(t, bins)] + [("B", t[0], 0)], "symbol string, t0 timestamp_ntz, bin int")
    out = {r.symbol: r for r in labels.primary_scores(ev, b).collect()}
    assert np.isclose(out["A"].accuracy, 4 / 6) and np.isclose(out["A"].precision, 2 / 3) and np.isclose(out["A"].recall, 2 / 3)
    assert out["B"].accuracy == 1 and out["B"].precision is None and out["B"].recall is None


def test_meta_features_take_the_first_of_equal_times(spark):
    t = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=k) for k in range(4)]
    vol = spark.createDataFrame([("A", t[0], 2, 0.2), ("A", t[0], 1, 0.1), ("A", t[1], 3, None), ("A", t[2], 4, 0.4), ("A", t[3], 5, 0.5)], "symbol string, time timestamp_ntz, seq long, vol double")
    auto = spark.createDataFrame([("A", x, 0.3) for x in t[:3]], "symbol string, time timestamp_ntz, autocorr double")
    ev = spark.createDataFrame([("A", x, 1) for x in t], "symbol string, t0 timestamp_ntz, side int")
    out = {r.t0: (r.vol, r.autocorr, r.side) for r in labels.meta_features(vol, auto, ev).collect()}
    assert out == {t[0]: (0.1, 0.3, 1), t[2]: (0.4, 0.3, 1)}


def test_weekly_counts_by_hand(spark):
    days = ["2024-01-01", "2024-01-07", "2024-01-08", "2024-01-24", "2024-01-25", "2024-01-26"]
    bars = spark.createDataFrame([("A", dt.datetime.fromisoformat(d)) for d in days], "symbol string, time timestamp_ntz")
    out = [(str(r.week), r.n, round(r.scaled, 6)) for r in sessions.weekly_bar_counts(bars).orderBy("week").collect()]
    assert out == [("2024-01-07", 2, 0.666667), ("2024-01-14", 1, 0.333333), ("2024-01-21", 0, 0.0), ("2024-01-28", 3, 1.0)]


def test_a_fit_reads_the_rows_of_its_fold_alone(spark, data):
    table = cv.fold_table(data, cv.purged_kfold(data, 3))
    files = lambda d: {r[0] for r in d.select(F.input_file_name()).distinct().collect()}
    parts = [files(table.where((F.col("_fold") == i) & (F.col("_role") == r))) for i in range(3) for r in ("train", "test")]
    assert sum(map(len, parts)) == len(set().union(*parts)) and table.count() == cv.purged_kfold(data, 3).count()
    assert dict(table.dtypes)["_fold"] == "int" and dict(table.dtypes)["_role"] == "string"
