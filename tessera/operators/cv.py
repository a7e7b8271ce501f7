"""Purged cross-validation, scoring, feature importance and hyper-parameter search.

Fold membership is data (a ``(fold, row, role)`` table built with positions, a constant-size
fold table and equi/range filters); models are MLlib estimators fitted per fold with
``weightCol``.  Fits are distributed jobs, a few of them at the same time, and read one table of all folds.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.plans.sequence import POS, cumulative, join_keys, shift, with_pos
from tessera.session import cut_lineage


# --------------------------------------------------------------------------- M1
def purge_train(train: DataFrame, test_times: DataFrame) -> DataFrame:
    """Drop training intervals [t0, t1] that start in, end in or envelop any test interval [start, end]
    (i.e. that overlap it), whatever the number of test intervals.

    An interval overlaps as many tests as start by its end, less those that end before its start: a sweep over
    the starts and ends counts both, so no pair is formed and nothing is broadcast."""
    held = cut_lineage(train.withColumn("_row", F.monotonically_increasing_id()))
    none = F.lit(None).cast("long")
    test = test_times.select(F.col("start").alias("_s"), F.col("end").alias("_e")).where("_s is not null and _e is not null")
    mark = lambda df, t, k, starts, ends, row: df.select(F.col(t).alias("_t"), F.lit(k).alias("_k"), F.lit(starts).alias("_ds"), F.lit(ends).alias("_de"), row.alias("_row"))
    events = mark(test, "_s", 0, 1, 0, none)  # at one time: starts, interval ends, interval starts, ends
    for part in (mark(held, "t1", 1, 0, 0, F.col("_row")), mark(held, "t0", 2, 0, 0, F.col("_row")), mark(test, "_e", 3, 0, 1, none)):
        events = events.unionByName(part)
    swept = cumulative(events, [], ["_t", "_k"], {"_starts": ("sum", "_ds"), "_ends": ("sum", "_de")})
    overlap = F.sum(F.when(F.col("_k") == 1, F.col("_starts")).otherwise(-F.col("_ends")))
    clear = swept.where("_row is not null").groupBy("_row").agg(overlap.alias("_n")).where("_n <= 0")
    return held.join(clear.select("_row"), "_row", "left_semi").drop("_row")


# --------------------------------------------------------------------------- M2
def embargo_times(times: DataFrame, pct: float, time_col: str = "time") -> DataFrame:
    """For each time, the time ``int(n·pct)`` rows later (the last time for the tail)."""
    d = with_pos(times.select(time_col).distinct(), [], [time_col])
    n = d.count()  # one number: the step depends on the sample size
    step = int(n * pct)
    nxt = d.select((F.col(POS) - step).alias(POS), F.col(time_col).alias("embargo"))
    last = d.agg(F.max(time_col).alias("_last")).first()["_last"]  # one value
    return (d.join(nxt, POS, "left")
             .select(time_col, F.coalesce(F.col("embargo"), F.lit(last)).alias("embargo")))


# --------------------------------------------------------------------------- M3
def purged_kfold(events: DataFrame, n_splits: int, pct_embargo: float = 0.0,
                 order: Sequence[str] = ("t0", "symbol")) -> DataFrame:
    """(fold, role, row) table of the purged k-fold: contiguous test blocks of sizes as
    ``np.array_split``; training rows are those with t1 <= first test t0, plus those from position
    searchsorted(max test t1) + embargo on.  events: t0, t1 and the ``order`` columns."""
    d = with_pos(events, [], list(order))
    n = d.count()
    q, r = divmod(n, n_splits)
    big = r * (q + 1)
    fold = F.when(F.col(POS) < big, F.floor(F.col(POS) / (q + 1))).otherwise(
        F.lit(r) + F.floor((F.col(POS) - big) / max(q, 1))).cast("int")
    d = d.withColumn("_test_fold", fold)
    # one row per fold (k values) comes back to the driver; the rest stays distributed
    fs = d.groupBy("_test_fold").agg(F.min(F.struct(POS, "t0")).alias("_first"),
                                     F.max("t1").alias("_max_t1")).collect()
    fs = sorted(fs, key=lambda r: r["_test_fold"])
    # maxT1Idx = number of rows whose t0 is before the test's last t1: k counts in one pass
    counts = d.agg(*[F.count_if(F.col("t0") < F.lit(r["_max_t1"])).alias(f"c{r['_test_fold']}") for r in fs]).first()
    mbrg = int(n * pct_embargo)
    spec = F.array(*[F.struct(F.lit(r["_test_fold"]).alias("fold"), F.lit(r["_first"]["t0"]).alias("_t0s"),
                              F.lit(counts[f"c{r['_test_fold']}"]).cast("long").alias("_mi")) for r in fs])
    j = d.withColumn("_f", F.explode(spec)).select("*", "_f.*").drop("_f")  # k candidate roles per row
    role = (F.when(F.col("_test_fold") == F.col("fold"), F.lit("test"))
             .when(F.col("t1") <= F.col("_t0s"), F.lit("train"))
             .when((F.col("_mi") < n) & (F.col(POS) >= F.col("_mi") + mbrg), F.lit("train")))
    return j.withColumn("role", role).where(F.col("role").isNotNull()).drop("_test_fold", "_t0s", "_mi")


# --------------------------------------------------------------------------- models and scores
SCORINGS = ("neg_log_loss", "accuracy", "f1")


def balanced(data: DataFrame, label="label", weight="w") -> DataFrame:
    """Weights times n / (classes · n_class), from one small aggregate."""
    counts = {r[label]: r["count"] for r in data.groupBy(label).count().collect()}  # one row per class
    n = sum(counts.values())
    factor = F.lit(None).cast("double")
    for c, k in counts.items():
        factor = F.when(F.col(label) == c, F.lit(n / (len(counts) * k))).otherwise(factor)
    return data.withColumn(weight, F.col(weight) * factor)


def forest(features: Sequence[str], label="label", weight="w", num_trees=100, max_depth=5, seed=7, subsampling=1.0,
           feature_subset="1", impurity="entropy", min_weight_leaf: float = 0.0) -> Pipeline:
    """Bagged trees that look at ``feature_subset`` features for each split.  Null features are an error: rows
    are never left out of training or scoring."""
    if not 0 < subsampling <= 1:
        raise ValueError(f"sample share {subsampling} is not in (0, 1]")
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    rf = RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol=weight, numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, subsamplingRate=subsampling, minWeightFractionPerNode=min_weight_leaf,
                                featureSubsetStrategy=feature_subset, impurity=impurity)
    return Pipeline(stages=[va, rf])


def fit_forest(data: DataFrame, features: Sequence[str], label="label", weight="w", ensemble: str = "forest", **model_args):
    """``bagging``: class weights are balanced; ``forest``: as they are (both draw one feature a split by default)."""
    if ensemble not in ("forest", "bagging"):
        raise ValueError(f"ensemble {ensemble!r} is neither 'forest' nor 'bagging'")
    return forest(features, label, weight, **model_args).fit(balanced(data, label, weight) if ensemble == "bagging" else data)


def score(pred: DataFrame, scoring: str, label="label", weight="w") -> float:
    """Weighted neg-log-loss or accuracy, or (unweighted classes 0/1) f1 of class 1, of a prediction frame."""
    if scoring not in SCORINGS:
        raise ValueError(f"scoring {scoring!r} is none of {SCORINGS}")
    if scoring == "f1":
        tp, fp, fn = pred.agg(*[F.coalesce(F.sum(F.when(c, F.col(weight))), F.lit(0.0)) for c in
                                ((F.col("prediction") == 1) & (F.col(label) == 1), (F.col("prediction") == 1) & (F.col(label) != 1), (F.col("prediction") != 1) & (F.col(label) == 1))]).first()
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    metric = "logLoss" if scoring == "neg_log_loss" else "accuracy"
    value = MulticlassClassificationEvaluator(labelCol=label, weightCol=weight, metricName=metric).evaluate(pred)
    return -value if scoring == "neg_log_loss" else value


#: Fits that run at the same time; each is a series of Spark jobs, and most are small.
PARALLELISM = 4


def together(spark, jobs: Sequence, parallelism: int = PARALLELISM) -> list:
    """Results of ``jobs`` (functions) in their order, some of them running at the same time."""
    if min(parallelism, len(jobs)) < 2:
        return [job() for job in jobs]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)


def fold_table(data: DataFrame, folds: DataFrame, key="row_id") -> DataFrame:
    """``data`` once for each fold that a row has a role in (``_fold``, ``_role``), written once for all fits.  The
    rows of a fold and role are kept apart: a fit, which reads its rows several times, reads no others."""
    return cut_lineage(data.join(folds.select(key, F.col("fold").alias("_fold"), F.col("role").alias("_role")), key), ["_fold", "_role"])


def cv_scores(data: DataFrame, folds: DataFrame, features: Sequence[str], scoring="neg_log_loss",
              key="row_id", label="label", weight="w", fit=None, table: DataFrame | None = None, parallelism: int = PARALLELISM,
              **model_args) -> list[tuple[int, float, object, DataFrame]]:
    """M4: fit on each fold's purged training rows, score its test rows.  ``fit(rows)`` makes a model; by
    default ``fit_forest`` with ``model_args``.  Folds are fitted at the same time; ``table`` is their
    ``fold_table``, if there is one already."""
    fit = fit or (lambda rows: fit_forest(rows, features, label, weight, **model_args))
    table = fold_table(data, folds, key) if table is None else table

    def one(i):
        rows = lambda role: table.where((F.col("_fold") == i) & (F.col("_role") == role)).drop("_fold", "_role")
        model, te = fit(rows("train")), rows("test")
        return i, score(model.transform(te), scoring, label, weight), model, te

    k = table.agg(F.max("_fold")).first()[0] + 1
    return together(data.sparkSession, [functools.partial(one, i) for i in range(k)], parallelism)


def cv_score_table(spark, scores) -> DataFrame:
    return spark.createDataFrame([(i, float(s)) for i, s, _, _ in scores], "fold int, score double")


def _mean_std(rows: DataFrame) -> DataFrame:
    """Mean and standard error of ``imp`` by feature."""
    return rows.groupBy("feature").agg(F.avg("imp").alias("mean"), (F.stddev_samp("imp") / F.sqrt(F.count("imp"))).alias("std"))


# --------------------------------------------------------------------------- M5
def importance_mdi(spark, model, features: Sequence[str]) -> DataFrame:
    """Mean decrease impurity: per-tree importances (0 -> null, a feature the tree never split on
    does not count), mean and standard error across trees, normalised by Σ mean."""
    rows = [(f, float(tree.featureImportances[j]) or None) for tree in model.stages[-1].trees
            for j, f in enumerate(features)]  # trees x features: small
    a = _mean_std(spark.createDataFrame(rows, "feature string, imp double"))
    tot = F.sum("mean").over(W.partitionBy())  # one row per feature
    return a.select("feature", (F.col("mean") / tot).alias("mean"), (F.col("std") / tot).alias("std"))


# --------------------------------------------------------------------------- M6
def permute_column(df: DataFrame, col: str, key="row_id", seed=0) -> DataFrame:
    """Shuffle one column among the rows: rank rows by a seeded hash and by their key (both
    two-level positions, no single-task sort) and pair the two rankings by an equi-join."""
    n = df.count()
    blocks = max(1, n // (1 << 17))  # ranges of the hash with about 2^17 rows each
    a = with_pos(df, [], [key])
    h = df.select(key, F.col(col).alias("_perm")).withColumn("_h", F.xxhash64(key, F.lit(seed)))
    part = F.floor((F.col("_h") / F.lit(2.0 ** 64) + 0.5) * blocks)
    b = with_pos(h, [], ["_h", key], block=part)
    return a.join(b.select(POS, "_perm"), POS).drop(col, POS).withColumnRenamed("_perm", col)


def importance_mda(spark, data, folds, features, scoring="neg_log_loss", key="row_id", label="label", weight="w",
                   seed=0, **model_args) -> tuple[DataFrame, float]:
    """Mean decrease accuracy: per fold, the score after permuting one feature in the test rows,
    relative to -score_perm (log-loss) or 1 - score_perm; mean and standard error over folds."""
    base = cv_scores(data, folds, features, scoring, key, label, weight, **model_args)

    def one(i, s0, model, te, f):
        s1 = score(model.transform(permute_column(te, f, key, seed + i)), scoring, label, weight)
        room = -s1 if scoring == "neg_log_loss" else 1.0 - s1
        return f, float((s0 - s1) / room) if room else None

    rows = together(spark, [functools.partial(one, *fold, f) for fold in base for f in features])
    return _mean_std(spark.createDataFrame(rows, "feature string, imp double")), sum(s for _, s, _, _ in base) / len(base)


# --------------------------------------------------------------------------- M7
def importance_sfi(spark, data, folds, features, scoring="neg_log_loss", **kw) -> DataFrame:
    """Single-feature importance: the purged CV score of a model on each feature alone."""
    table = fold_table(data, folds, kw.get("key", "row_id"))
    one = lambda f: [(f, float(s)) for _, s, _, _ in cv_scores(data, folds, [f], scoring, table=table, parallelism=1, **kw)]
    rows = [r for found in together(spark, [functools.partial(one, f) for f in features]) for r in found]
    return _mean_std(spark.createDataFrame(rows, "feature string, imp double"))


# --------------------------------------------------------------------------- M8
def orthogonal_features(df: DataFrame, features: Sequence[str], var_thres: float = 0.95, out="pc") -> DataFrame:
    """Standardise, project on the principal components that first reach ``var_thres`` of the variance
    (inclusive): ``out`` is an array.  Components point so that their largest loading is positive."""
    va = VectorAssembler(inputCols=list(features), outputCol="_v")
    sc = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True)
    assembled = va.transform(df)
    z = sc.fit(assembled).transform(assembled)
    model = PCA(k=len(features), inputCol="_z", outputCol="_p").fit(z)
    k, reached = 0, 0.0
    while k < len(features) and reached < var_thres - 1e-12:
        reached += float(model.explainedVariance[k])
        k += 1
    loadings = model.pc.toArray()
    zs = vector_to_array("_z")
    comps = []
    for c in range(k):
        col = loadings[:, c]
        col = col if col[abs(col).argmax()] > 0 else -col
        comps.append(sum((zs[i] * F.lit(float(x)) for i, x in enumerate(col)), F.lit(0.0)))
    return z.withColumn(out, F.array(*comps)).drop("_v", "_z")


# --------------------------------------------------------------------------- M9
def feature_importance(spark, data, folds, features, method: str = "SFI", scoring: str = "accuracy", ensemble: str = "bagging",
                       num_trees: int = 100, **model_args) -> tuple[DataFrame, float]:
    """(importance, mean purged out-of-sample score) by MDI, MDA or SFI, of bagged trees or a forest."""
    kw = dict(num_trees=num_trees, ensemble=ensemble, **model_args)
    if method == "MDA":
        return importance_mda(spark, data, folds, features, scoring, **kw)
    oos = [s for _, s, _, _ in cv_scores(data, folds, features, scoring, **kw)]
    if method == "MDI":
        imp = importance_mdi(spark, fit_forest(data, features, **kw), features)
    elif method == "SFI":
        imp = importance_sfi(spark, data, folds, features, scoring, **kw)
    else:
        raise ValueError(f"method {method!r} is none of MDI, MDA, SFI")
    return imp, sum(oos) / len(oos)


# --------------------------------------------------------------------------- M10 / M11
def family_importance(imp: DataFrame) -> DataFrame:
    """Importance summed per feature family (first character of the name)."""
    return imp.groupBy(F.substring("feature", 1, 1).alias("family")).agg(F.sum("mean").alias("mean"))


def sliced_importance(data: DataFrame, slice_of, slices: int, importance) -> DataFrame:
    """Mean over ``slices`` slices (``slice_of``: a column from 0) of the importances ``importance(rows)`` finds in
    each, beside that of the whole: (feature, sliced_mean, whole_mean).  A slice is fitted like the whole, by
    distributed jobs; slices are a parameter, not the data's keys."""
    rows = [data.where(slice_of == k) for k in range(slices)] + [data]
    *ones, whole = together(data.sparkSession, [functools.partial(importance, r) for r in rows])
    parts = functools.reduce(DataFrame.unionByName, [one.select("feature", "mean") for one in ones])
    whole = whole.select("feature", F.col("mean").alias("whole_mean"))
    return parts.groupBy("feature").agg(F.avg("mean").alias("sliced_mean")).join(whole, "feature")


# --------------------------------------------------------------------------- M12
def roc_points(scored: DataFrame, keys: Sequence[str], label="label", score="score") -> DataFrame:
    """ROC points per key: for each distinct score, from the highest, the shares of negatives and of positives
    scored at least so (keys, score, fpr, tpr)."""
    keys = list(keys)
    c = scored.groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_q"))
    c = cumulative(c.withColumn("_down", -F.col(score)), keys, ["_down"], {"_cp": ("sum", "_p"), "_cq": ("sum", "_q")}, block=F.floor(F.col("_down") * 256))
    tot = c.groupBy(*keys).agg(F.max("_cp").alias("_tp"), F.max("_cq").alias("_tq"))
    return join_keys(c, tot, keys).select(*keys, score, F.try_divide("_cq", "_tq").alias("fpr"), F.try_divide("_cp", "_tp").alias("tpr"))


def roc_curve(points: DataFrame, keys: Sequence[str], grid: int = 100) -> DataFrame:
    """(keys, i, fpr, tpr): the ROC read at ``grid`` evenly spaced false-positive rates, linear between points, 0 at
    rate 0, and (keys, i = -1, tpr) the area below the points."""
    keys = list(keys)
    first = points.groupBy(*keys).agg(F.lit(float("inf")).alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    p = first.unionByName(points).withColumn("_down", -F.col("score"))
    p = shift(p, keys, ["_down"], {"fpr": "_f2", "tpr": "_t2"}, -1)
    area = p.groupBy(*keys).agg(F.sum((F.col("_f2") - F.col("fpr")) * (F.col("_t2") + F.col("tpr")) / 2).alias("tpr"))
    steps = F.lit(float(grid - 1))
    # the rates from this point to the next one; the last point holds rate 1
    low = F.ceil(F.col("fpr") * steps - 1e-9)
    high = F.when(F.col("_f2").isNull(), F.lit(grid - 1)).otherwise(F.ceil(F.col("_f2") * steps - 1e-9) - 1)
    at = p.where(high >= low).withColumn("i", F.explode(F.sequence(low, high)))
    x = F.col("i") / steps
    rise = F.coalesce(F.try_divide((x - F.col("fpr")) * (F.col("_t2") - F.col("tpr")), F.col("_f2") - F.col("fpr")), F.lit(0.0))
    curve = at.select(*keys, F.col("i").cast("int").alias("i"), x.alias("fpr"), F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.col("tpr") + rise).alias("tpr"))
    return curve.unionByName(area.select(*keys, F.lit(-1).alias("i"), F.lit(None).cast("double").alias("fpr"), "tpr"))


def fold_predictions(scores, label="label") -> DataFrame:
    """(fold, label, prediction, score): the test rows of ``cv_scores``, score = probability of class 1."""
    out = None
    for i, _, model, te in scores:
        p = model.transform(te).select(F.lit(i).alias("fold"), F.col(label).alias("label"), "prediction", vector_to_array("probability")[1].alias("score"))
        out = p if out is None else out.unionByName(p)
    return out


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Per fold: rows, accuracy, precision and recall of class 1, and the area under its ROC."""
    hit = (F.col("prediction") == 1) & (F.col("label") == 1)
    one = lambda c: F.sum(c.cast("double"))
    m = predictions.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
                                        F.try_divide(one(hit), one(F.col("prediction") == 1)).alias("precision"), F.try_divide(one(hit), one(F.col("label") == 1)).alias("recall"))
    auc = roc_curve(roc_points(predictions, ["fold"]), ["fold"]).where("i < 0").select("fold", F.col("tpr").alias("auc"))
    return m.join(auc, "fold", "left")


def mean_roc(predictions: DataFrame, grid: int = 100) -> DataFrame:
    """The folds' ROC curves averaged: (i, fpr, tpr, std), and in row i = -1 the area below the mean curve and the
    standard deviation of the folds' areas."""
    c = roc_curve(roc_points(predictions, ["fold"]), ["fold"], grid).groupBy("i").agg(F.max("fpr").alias("fpr"), F.avg("tpr").alias("tpr"), F.stddev_pop("tpr").alias("std"))
    c = cut_lineage(c.withColumn("tpr", F.when(F.col("i") == grid - 1, F.lit(1.0)).otherwise(F.col("tpr"))))
    order = W.orderBy("i")  # a row for each rate of the grid
    piece = F.when(F.col("i") >= 0, (F.lead("tpr").over(order) + F.col("tpr")) / (2.0 * (grid - 1)))
    whole = c.withColumn("_a", piece).agg(F.sum("_a").alias("tpr"), F.max(F.when(F.col("i") < 0, F.col("std"))).alias("std"))
    return c.where("i >= 0").select("i", "fpr", "tpr", "std").unionByName(whole.select(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("fpr"), "tpr", "std"))


# --------------------------------------------------------------------------- M13 / M14 / M15
def grid_points(params: dict[str, Sequence]) -> list[dict]:
    """Every combination of the values."""
    return [dict(zip(params, v)) for v in itertools.product(*params.values())]


def random_points(params: dict, n: int, seed: int = 0) -> list[dict]:
    """``n`` draws: a value is a sequence to choose from, or a function of a random generator."""
    rnd = random.Random(seed)
    return [{k: v(rnd) if callable(v) else rnd.choice(list(v)) for k, v in params.items()} for _ in range(n)]


class Bagged:
    """Models fitted on samples of the rows; the class of the highest mean probability."""

    def __init__(self, models):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for k, m in enumerate(self.models):
            p = m.transform(out)
            out = p.select(*out.columns, vector_to_array("probability").alias(f"_b{k}"))
        n = len(self.models)
        mean = F.transform(F.col("_b0"), lambda _, i: sum((F.get(F.col(f"_b{k}"), i) for k in range(n)), F.lit(0.0)) / n)
        out = out.withColumn("_mean", mean).withColumns({"probability": array_to_vector("_mean"), "rawPrediction": array_to_vector("_mean"),
                                                         "prediction": (F.array_position("_mean", F.array_max("_mean")) - 1).cast("double")})
        return out.drop("_mean", *[f"_b{k}" for k in range(n)])


def search(spark, data, folds, features, points: Sequence[dict], scoring: str | None = None, label="label", weight="w",
           bagging: tuple[int, float] | None = None, **kw) -> tuple[DataFrame, object]:
    """Purged CV search: (table, best model).  The table has every point's mean and std of fold scores; the
    best point is fitted again on all rows, on ``bagging`` = (models, sample share) bags of them if given.
    Scoring defaults to f1 for labels {0, 1}, else neg-log-loss."""
    if scoring is None:
        classes = {r[0] for r in data.select(label).distinct().limit(3).collect()}
        scoring = "f1" if classes == {0, 1} else "neg_log_loss"
    table = fold_table(data, folds, kw.get("key", "row_id"))

    def one(gi, params):
        sc = [s for _, s, _, _ in cv_scores(data, folds, features, scoring, label=label, weight=weight, table=table, parallelism=1, **{**kw, **params})]
        mean = sum(sc) / len(sc)
        return gi, str(params), float(mean), float((sum((x - mean) ** 2 for x in sc) / len(sc)) ** 0.5)

    rows = together(spark, [functools.partial(one, gi, params) for gi, params in enumerate(points)])
    best = points[max(range(len(rows)), key=lambda g: (rows[g][2], -g))]
    fit = lambda d: fit_forest(d, features, label, weight, **{**kw, **best})
    model = Bagged([fit(data.sample(fraction=bagging[1], seed=k)) for k in range(bagging[0])]) if bagging else fit(data)
    return spark.createDataFrame(rows, "point int, params string, mean_score double, std_score double"), model


def log_uniform(a: float, b: float):
    """A draw of a·(b/a)^u, u uniform on [0, 1), for ``random_points``."""
    return lambda rnd: a * (b / a) ** rnd.random()


def is_sharpe(found: DataFrame) -> DataFrame:
    """abs(mean)/std of the fold scores of the best point."""
    best = found.orderBy(F.desc("mean_score"), "point").limit(1)
    return best.select("point", "params", F.try_divide(F.abs("mean_score"), F.col("std_score")).alias("is_sharpe"))


# --------------------------------------------------------------------------- M16 / M17
def chronological_split(data: DataFrame, test_share: float = 0.3, order: Sequence[str] = ("t0", "symbol")):
    """First (1 - test_share) of the rows in time order train, the rest test."""
    d = with_pos(data, [], list(order))
    n = d.count()
    cut = int(math.floor(n * (1 - test_share)))
    return d.where(F.col(POS) < cut).drop(POS), d.where(F.col(POS) >= cut).drop(POS)


def holdout_metrics(model, test: DataFrame, label="label") -> DataFrame:
    """Rows, accuracy, precision and recall of class 1 of a model on held-out rows."""
    p = model.transform(test)
    hit, one = (F.col("prediction") == 1) & (F.col(label) == 1), lambda c: F.sum(c.cast("double"))
    return p.agg(F.count(F.lit(1)).alias("test_rows"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"),
                 F.try_divide(one(hit), one(F.col("prediction") == 1)).alias("precision"), F.try_divide(one(hit), one(F.col(label) == 1)).alias("recall"))


def bagged_one_vs_rest(train: DataFrame, features, label="label", weight="w", subsampling=0.5, seed=7, num_trees=100, max_depth=5):
    """One-vs-rest over bagged entropy trees with balanced class weights, whose sample share is the mean
    uniqueness (in (0, 1])."""
    va, rf = forest(features, label, weight, num_trees=num_trees, max_depth=max_depth, seed=seed, subsampling=subsampling).getStages()
    ovr = OneVsRest(classifier=rf, featuresCol="_features", labelCol=label, weightCol=weight)
    return Pipeline(stages=[va, ovr]).fit(balanced(train, label, weight))
