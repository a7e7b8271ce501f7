"""Null keys and values, hot blocks, long weights, losses of everything, high levels: results are whole and exact."""
import datetime as dt
import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.operators import allocation, bars, breaks, cv, entropy, filters, fracdiff, labels, sessions, sizing, stats
from tessera.plans import ewm as E
from tessera.plans.sequence import exact_quantiles, fill, shift, with_pos
from tessera.sources import trades as S


def series(spark, values, symbol="A", name="close"):
    d = [(symbol, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(d, f"symbol string, time timestamp_ntz, seq long, {name} double")


# ------------------------------------------------------------- fractional differences
def test_weights_are_not_cut_off():
    w = fracdiff.weights_ffd(0.1, 1e-6)
    assert len(w) == 33_056 and abs(w[-1]) >= 1e-6 > abs(fracdiff.weights(0.1, len(w) + 1)[-1])
    with pytest.raises(ValueError):
        fracdiff.weights_ffd(-0.7, 1e-5, max_width=1 << 14)
    k = np.arange(1, 40)
    loop = [1.0]
    for i in k:
        loop.append(loop[-1] * (i - 1 - 0.4) / i)
    assert np.allclose(fracdiff.weights(0.4, 40), loop) and np.allclose(fracdiff.weights(0.4, 10, 30), loop[30:40])


@pytest.mark.parametrize("chunk_rows", [7, 1 << 16])
def test_fractional_differences_by_chunks(spark, chunk_rows):
    x = np.random.default_rng(0).normal(size=60).cumsum() + 1e4
    s = series(spark, x)
    w = fracdiff.weights_ffd(0.4, 0.05)
    got = fracdiff.frac_diff_ffd(s, 0.4, 0.05, chunk_rows=chunk_rows).orderBy("seq").toPandas()
    assert np.allclose(got.ffd, np.convolve(x, w, "valid")) and list(got.seq) == list(range(len(w) - 1, 60))
    whole = np.convolve(x, fracdiff.weights(0.4, 60))[:60]
    got = fracdiff.frac_diff_expanding(s, 0.4, 0.2, chunk_rows=chunk_rows).orderBy("seq").toPandas()
    tail = np.cumsum(np.abs(fracdiff.weights(0.4, 60))[::-1])
    skip = int((tail / tail[-1] > 0.2).sum())
    assert skip > 0 and list(got.seq) == list(range(skip, 60)) and np.allclose(got.fd, whole[skip:])


@pytest.mark.parametrize("d,n,thres", [(0.4, 500, 0.01), (0.9, 64, 0.3), (1.3, 200, 0.05), (0.0, 5, 0.1), (1.0, 9, 0.2)])
def test_expanding_skip(d, n, thres):
    tail = np.cumsum(np.abs(fracdiff.weights(d, n))[::-1])
    assert fracdiff.expanding_skip(d, n, thres) == int((tail / tail[-1] > thres).sum())


@pytest.mark.parametrize("level", [0.0, 1e6])
def test_adf_and_min_ffd_against_lstsq(spark, level):
    x = level + np.random.default_rng(3).normal(size=300).cumsum()

    def slow(f):
        y, l1, dl = f[2:] - f[1:-1], f[1:-1], f[1:-1] - f[:-2]
        z = np.stack([l1 - l1.mean(), dl - dl.mean()], axis=1)
        b, *_ = np.linalg.lstsq(z, y - y.mean(), rcond=None)
        rss = ((y - y.mean() - z @ b) ** 2).sum()
        return b[0] / math.sqrt(rss / (len(y) - 3) * np.linalg.inv(z.T @ z)[0, 0])

    r = fracdiff.adf(series(spark, x, name="x")).first()
    assert r.nobs == 298 and abs(r.adf_stat - slow(x)) < 1e-6
    out = {r.d: r.adf_stat for r in fracdiff.min_ffd(series(spark, x), [0.0, 0.5, 1.0], 0.05, chunk_rows=37).collect()}
    for d in out:
        assert abs(out[d] - slow(np.convolve(x, fracdiff.weights_ffd(d, 0.05), "valid"))) < 1e-5


def test_betas_at_a_high_level(spark):
    rng = np.random.default_rng(1)
    x1, x2 = 1e6 + rng.normal(size=80), rng.normal(size=80)
    y = 3 + 0.5 * x1 - 2 * x2 + rng.normal(size=80)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "y": y, "a": x1, "b": x2, "const": 1.0}))
    r = breaks.betas(df, "y", ["a", "b", "const"]).first()
    X = np.stack([x1 - 1e6, x2, np.ones(80)], axis=1)
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    s2 = ((y - X @ b) ** 2).sum() / 77
    cov = s2 * np.linalg.inv(X.T @ X)
    shift_ = np.array([[1, 0, 0], [0, 1, 0], [-1e6, 0, 1]])  # back from the shifted regressor
    assert np.allclose([r.b_a, r.b_b, r.b_const], shift_ @ b, rtol=1e-7)
    assert np.allclose([r.var_a, r.var_b, r.var_const], np.diag(shift_ @ cov @ shift_.T), rtol=1e-6)


# ------------------------------------------------------------- null keys, nulls, single days
def test_null_keys_keep_their_rows(spark):
    t = series(spark, [1, 2, None, 4], symbol=None)
    assert sorted(r._pos for r in with_pos(t, ["symbol"], ["time"]).collect()) == [0, 1, 2, 3]
    assert [r.p for r in shift(t, ["symbol"], ["time"], {"close": "p"}).orderBy("time").collect()] == [None, 1.0, 2.0, None]
    assert [r.f for r in fill(t, ["symbol"], ["time"], {"close": "f"}).orderBy("time").collect()] == [1.0, 2.0, 2.0, 4.0]
    tr = spark.createDataFrame([(None, dt.datetime(2024, 1, 2, 10, i), i, 10.0, 2.0) for i in range(10)], "symbol string, ts timestamp_ntz, seq long, price double, size double")
    assert bars.tick_bars(tr, 3).count() == 3 and bars.dollar_bars(tr, 50.0).count() == 3


@pytest.mark.parametrize("level", [0.0, 1e5, 1e8])
def test_ewm_over_long_null_runs(spark, level):
    rng = np.random.default_rng(2)
    x = level + 0.01 * rng.normal(size=2500)
    x[:3] = np.nan
    x[600:1000] = np.nan  # longer than a chunk of alpha 0.5
    x[1300:1303] = np.nan
    got = E.ewm(series(spark, [None if math.isnan(v) else v for v in x]), ["symbol"], ["time"], "close", out_mean="m", out_std="s", alpha=0.5).orderBy("time").toPandas()
    want = pd.Series(x).ewm(alpha=0.5)
    assert np.allclose(got.m.astype(float), want.mean(), rtol=0, atol=1e-12 * max(level, 1) + 1e-9, equal_nan=True)
    sd = want.std()
    assert np.allclose(got.s.astype(float)[sd.notna()], sd[sd.notna()], rtol=0, atol=1e-6)


def test_single_day_symbols_have_daily_bars(spark):
    tr = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 10) + dt.timedelta(seconds=i), i, 10.0, 1.0) for i in range(100)], "symbol string, ts timestamp_ntz, seq long, price double, size double")
    out = bars.daily_dollar_bars(tr, divisor=10.0).orderBy("group_id").toPandas()
    assert list(out["count"]) == [10] * 10


def test_zero_prices_are_kept(spark):
    tr = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 10, i), i, 0.0 if i == 2 else 10.0, 1.0) for i in range(6)], "symbol string, ts timestamp_ntz, seq long, price double, size double")
    out = bars.daily_dollar_bars(tr, divisor=1.0).collect()
    assert sum(r["count"] for r in out) == 6 and any(r.log_range is None for r in out)
    assert bars.dollar_bars(tr, 30.0).orderBy("bar").first().ticks == 4


@pytest.mark.parametrize("long_bars", [False, True])
@pytest.mark.parametrize("chunk_rows", [5, 1 << 16])
@pytest.mark.parametrize("threshold", [30.0, 400.0])
def test_bars_and_cusum_of_one_crowded_hour(spark, chunk_rows, threshold, long_bars):
    """Ten chunks of one symbol and hour equal the loop, and no group holds more rows than a chunk."""
    rng = np.random.default_rng(4)
    n = 50 if chunk_rows < 1 << 16 else 500
    price, size = rng.uniform(1, 9, n).round(3), rng.integers(1, 5, n).astype(float)
    t0 = dt.datetime(2024, 1, 2, 10)
    tr = spark.createDataFrame([("A", t0 + dt.timedelta(milliseconds=i), i, float(p), float(s)) for i, (p, s) in enumerate(zip(price, size))], "symbol string, ts timestamp_ntz, seq long, price double, size double")
    from tessera.plans.segment import threshold_bars
    got = threshold_bars(tr, ["symbol"], F.col("price") * F.col("size"), threshold, chunk_rows=chunk_rows, long_bars=long_bars).orderBy("bar").collect()
    want, cum, ticks = [], 0.0, []
    for i in range(n):
        cum += price[i] * size[i]
        ticks.append(i)
        if cum >= threshold:
            want.append(ticks)
            cum, ticks = 0.0, []
    assert [r.ticks for r in got] == [len(w) for w in want]
    for r, w in zip(got, want):
        assert r.close == price[w[-1]] and r.open == price[w[0]] and r.last_seq == w[-1]
        assert (r.price_std is None and len(w) == 1) or math.isclose(r.price_std, price[w].std(ddof=1), rel_tol=1e-9)
    close = tr.select("symbol", F.col("ts").alias("time"), "seq", F.col("price").alias("close"))
    got = [(r.time, r.side) for r in filters.cusum_events(close, 6.0, chunk_rows=chunk_rows).orderBy("time").collect()]
    hit, _, _ = filters._cusum_day(np.diff(price), 6.0, 0.0, 0.0)
    assert got == [(t0 + dt.timedelta(milliseconds=int(i) + 1), int(hit[i])) for i in np.flatnonzero(hit)]


# ------------------------------------------------------------- statistics
def test_equity_after_a_total_loss(spark):
    eq = lambda r: [x.equity for x in stats.equity_curve(series(spark, r, name="ret")).orderBy("time").collect()]
    assert np.allclose(eq([0.1, -1.0, 0.1]), [1.1, 0, 0])
    assert np.allclose(eq([0.1, -1.5, 0.1, -1.5, None, 0.2]), np.cumprod([1.1, -0.5, 1.1, -0.5, 1, 1.2]))


def test_holding_period_by_chunks(spark):
    rng = np.random.default_rng(6)
    p = rng.integers(-3, 4, 80).cumsum() % 7 - 3.0
    d = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(i * 5)), i, float(v)) for i, v in enumerate(p)]
    df = spark.createDataFrame(d, "symbol string, time timestamp_ntz, seq long, position double")
    entry, cost, weight = 0.0, 0.0, 0.0
    days = [i * 5 / 24 for i in range(80)]
    for t, before, now in zip(days[1:], p, p[1:]):
        if (now - before) * before < 0:
            closed = abs(before) if now * before < 0 else abs(now - before)
            cost, weight = cost + closed * (t - entry), weight + closed
            entry = t if now * before < 0 else entry
        elif now:
            entry = (entry * before + t * (now - before)) / now
    for chunk_rows in (6, 1 << 16):
        assert math.isclose(stats.holding_period(df, chunk_rows=chunk_rows).first().holding_days, cost / weight, rel_tol=1e-9)


def test_exact_quantiles(spark):
    x = np.random.default_rng(7).normal(size=1003)
    d = series(spark, list(x) + [None, 5.0, 5.0], symbol=None, name="v")
    got = exact_quantiles(d, ["symbol"], "v", [0.0, 0.1, 0.5, 0.95, 1.0], "q").first()
    assert got.symbol is None and np.allclose(got.q, np.quantile(np.append(x, [5.0, 5.0]), [0, 0.1, 0.5, 0.95, 1]))


def test_strategy_risk_needs(spark):
    d = series(spark, [0.02] * 60 + [-0.02] * 40, name="ret")
    r = stats.strategy_risk(d, 2.0).first()
    assert math.isclose(r.p, 0.6) and r.sens_p > 0 and r.sens_freq > 0 and r.sens_pt > 0 and r.sens_sl > 0
    q = 4.0 / r.freq
    assert math.isclose((r.min_precision + r.sl / (r.pt - r.sl)) ** 2, q * r.min_precision * (1 - r.min_precision), rel_tol=1e-6)


def test_concurrent_bets_count_zero_as_long_and_look_back(spark):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    s = spark.createDataFrame([("A", day(0), None, 0.0), ("A", day(40), day(41), -1.0)], "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, side double")
    far = {r.time: (r.long, r.short) for r in sizing.concurrent_bets(s).collect()}
    near = {r.time: (r.long, r.short) for r in sizing.concurrent_bets(s, lookback_days=25).collect()}
    assert far[day(40)] == (1, 1) and near[day(40)] == (0, 1) and near[day(0)] == (1, 0)


def test_mixture_sizes_per_key(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(c), 0) for k, off in (("A", 5), ("B", 50)) for c in np.concatenate([rng.normal(off, 2, 200), rng.normal(-off, 2, 200)]).round()]
    out = sizing.size_from_mixture(spark.createDataFrame(rows, "symbol string, long long, short long")).toPandas()
    assert (np.sign(out["size"]) == np.sign(out.c)).all() and (out["size"].abs() <= 1).all()
    assert abs(out[(out.symbol == "A") & (out.c == 5)]["size"].mean() - 0.5) < 0.15 and abs(out[(out.symbol == "B") & (out.c == 50)]["size"].mean() - 0.5) < 0.15


# ------------------------------------------------------------- labels
def test_rare_labels_per_key(spark):
    rows = [("A", b) for b in [1] * 50 + [-1] * 48 + [0] * 2] + [("B", b) for b in [1] * 5 + [0] * 4 + [-1] * 4] + [("C", b) for b in [1] * 97 + [2] + [3] + [4]] + [(None, 1)]
    got = labels.drop_rare_labels(spark.createDataFrame(rows, "symbol string, bin int"), keys=["symbol"]).groupBy("symbol", "bin").count().collect()
    assert {(r.symbol, r.bin): r["count"] for r in got} == {("A", 1): 50, ("A", -1): 48, ("B", 1): 5, ("B", 0): 4, ("B", -1): 4, ("C", 1): 97, ("C", 4): 1, (None, 1): 1}


def test_first_touch_against_all_ticks(spark):
    rng = np.random.default_rng(9)
    n = 600
    px = 100 * np.exp(rng.normal(0, 0.004, n).cumsum())
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i) for i in range(n)]
    close = spark.createDataFrame([("A", t, float(p)) for t, p in zip(times, px)], "symbol string, time timestamp_ntz, close double")
    ev = [("A", times[i], times[min(i + 150, n - 1)] if i % 3 else None, 0.01 + 0.01 * (i % 4), (-1.0) ** i) for i in range(0, 500, 11)]
    e = spark.createDataFrame(ev, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, trgt double, side double")
    got = {r.t0: (r.pt, r.sl) for r in labels.triple_barrier(close, e, [1.0, 0.7]).collect()}
    for _, t0, t1, trgt, side in ev:
        i = times.index(t0)
        path = [(t, (p / px[i] - 1) * side) for t, p in zip(times[i:], px[i:]) if t <= (t1 or times[-1])]
        assert got[t0] == (next((t for t, r in path if r > trgt), None), next((t for t, r in path if r < -0.7 * trgt), None))


def test_barrier_mesh_paths(spark):
    close = series(spark, [10, 11, 12, 9, 10, 10])
    starts = close.where("seq in (0, 4)").select("symbol", "time")
    whole = labels.barrier_mesh(close, starts, [0.5], [10.0], max_hp=3).collect()
    part = labels.barrier_mesh(close, starts, [0.1], [10.0], max_hp=3, whole_paths=False).collect()
    assert [r.n for r in whole] == [1] and [r.n for r in part] == [1]


# ------------------------------------------------------------- models
@pytest.fixture(scope="module")
def model_data(spark):
    rng = np.random.default_rng(10)
    n = 240
    y = rng.integers(0, 2, n)
    t0 = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(i)) for i in range(n)]
    pdf = pd.DataFrame({"row_id": np.arange(n), "symbol": "A", "t0": t0, "t1": [t + dt.timedelta(hours=2) for t in t0], "I_x": y + rng.normal(0, 0.5, n), "N_x": rng.normal(size=n), "label": y.astype(float), "w": rng.uniform(0.5, 1, n)})
    data = spark.createDataFrame(pdf, "row_id long, symbol string, t0 timestamp_ntz, t1 timestamp_ntz, I_x double, N_x double, label double, w double").cache()
    return data, cv.purged_kfold(data, 3).cache()


def test_models_refuse_what_they_would_have_hidden(spark, model_data):
    data, _ = model_data
    with pytest.raises(ValueError):
        cv.score(data, "roc")
    with pytest.raises(ValueError):
        cv.forest(["I_x"], subsampling=0.0)
    with pytest.raises(Exception, match="(?i)null"):
        cv.fit_forest(data.withColumn("I_x", F.when(F.col("row_id") > 5, F.col("I_x"))), ["I_x", "N_x"], num_trees=2)


def test_search_scores_f1_refits_and_bags(spark, model_data):
    data, folds = model_data
    points = cv.grid_points({"max_depth": [1, 3], "num_trees": [5]})
    table, model = cv.search(spark, data, folds, ["I_x", "N_x"], points)
    assert table.count() == 2 and all(0 < r.mean_score <= 1 for r in table.collect())
    assert cv.score(model.transform(data), "accuracy") > 0.7
    _, bag = cv.search(spark, data, folds, ["I_x", "N_x"], points[:1], bagging=(3, 0.7))
    p = bag.transform(data)
    assert len(bag.models) == 3 and cv.score(p, "accuracy") > 0.7 and p.count() == 240 and cv.score(p, "neg_log_loss") < 0
    draws = cv.random_points({"a": [1, 2], "b": cv.log_uniform(0.01, 100)}, 50, seed=3)
    assert all(d["a"] in (1, 2) and 0.01 <= d["b"] <= 100 for d in draws) and sum(d["b"] < 1 for d in draws) > 12


def test_roc_and_metrics_against_loops(spark, model_data):
    rng = np.random.default_rng(12)
    rows = [(f, float(y), float(s > 0.5), float(s)) for f in (0, 1) for y, s in zip(rng.integers(0, 2, 90), rng.uniform(size=90).round(1 + f))]
    p = spark.createDataFrame(rows, "fold int, label double, prediction double, score double")
    curves = cv.roc_curve(cv.roc_points(p, ["fold"]), ["fold"]).toPandas()
    grid, mean = np.linspace(0, 1, 100), []
    for f in (0, 1):
        y, s = (np.array([r[k] for r in rows if r[0] == f]) for k in (1, 3))
        cut = sorted(set(s), reverse=True)
        fpr, tpr = [0] + [((s >= c) & (y == 0)).sum() / (y == 0).sum() for c in cut], [0] + [((s >= c) & (y == 1)).sum() / (y == 1).sum() for c in cut]
        want = np.interp(grid, fpr, tpr)
        want[0] = 0
        mean.append(want)
        own = curves[curves.fold == f].sort_values("i")
        assert np.allclose(own[own.i >= 0].tpr, want) and np.isclose(own[own.i < 0].tpr.iloc[0], np.trapezoid(tpr, fpr))
    m = cv.mean_roc(p).toPandas().sort_values("i")
    avg = np.mean(mean, axis=0)
    avg[-1] = 1
    assert np.allclose(m[m.i >= 0].tpr, avg) and np.isclose(m[m.i < 0].tpr.iloc[0], np.trapezoid(avg, grid))
    auc = {r.fold: r for r in cv.fold_metrics(p).collect()}
    assert set(auc) == {0, 1} and all(r.rows == 90 and 0 <= r.auc <= 1 for r in auc.values())


def test_importances_find_the_signal(spark, model_data):
    data, folds = model_data
    for method, ensemble in (("MDI", "forest"), ("MDA", "bagging"), ("SFI", "forest")):
        imp, oos = cv.feature_importance(spark, data, folds, ["I_x", "N_x"], method, num_trees=8, ensemble=ensemble)
        r = {x.feature: x.mean for x in imp.collect()}
        assert r["I_x"] > r["N_x"] and 0.5 < oos <= 1
    with pytest.raises(ValueError):
        cv.feature_importance(spark, data, folds, ["I_x"], "OOB", num_trees=2)


def test_principal_components_have_fixed_signs(spark, model_data):
    data, _ = model_data
    d = data.select("I_x", "N_x", (F.col("I_x") * -2 + F.col("N_x") / 10).alias("R_x"))
    p = np.array([r.pc for r in cv.orthogonal_features(d, ["I_x", "N_x", "R_x"], 1.0).collect()])
    q = np.array([r.pc for r in cv.orthogonal_features(d.repartition(3), ["I_x", "N_x", "R_x"], 0.6).collect()])
    c = np.cov(p.T)
    assert np.allclose(c, np.diag(np.diag(c)), atol=1e-9) and np.isclose(np.trace(c), 3)
    assert q.shape[1] < 3 and np.allclose(sorted(q[:, 0]), sorted(p[:, 0]))


def test_purge_by_sweep_against_pairs(spark):
    rng = np.random.default_rng(13)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(h))
    tr = [(i, at(a), at(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 200, 120), rng.integers(0, 9, 120)))]
    te = [(at(a), at(a + b)) for a, b in zip(rng.integers(0, 200, 15), rng.integers(0, 5, 15))]
    got = cv.purge_train(spark.createDataFrame(tr, "id long, t0 timestamp_ntz, t1 timestamp_ntz"), spark.createDataFrame(te, "start timestamp_ntz, end timestamp_ntz"))
    assert sorted(r.id for r in got.collect()) == [i for i, a, b in tr if not any(a <= e and b >= s for s, e in te)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------- entropy, allocation
def test_expanding_entropy_against_loop(spark):
    msg = "".join(np.random.default_rng(14).choice(list("ab"), 60))
    df = spark.createDataFrame([("A", i, c) for i, c in enumerate(msg)], "symbol string, bar long, code string")

    def length(i, n):
        return 1 + max((k for k in range(1, n + 1) if any(msg[j:j + k] == msg[i:i + k] for j in range(i - n, i))), default=0)

    r = entropy.kontoyiannis(df, None).first()
    assert r.points == 30 and math.isclose(r.h, np.mean([math.log2(i + 1) / length(i, i) for i in range(1, 31)]))
    for chunk_rows in (10, 1 << 14):
        r = entropy.kontoyiannis(df, 8, chunk_rows=chunk_rows).first()
        assert r.points == 45 and math.isclose(r.h, np.mean([math.log2(9) / length(i, 8) for i in range(8, 53)]))


def test_constant_series_do_not_end_a_query(spark):
    flat = series(spark, [5.0] * 30, name="ret")
    assert {r.code for r in entropy.sigma_code(flat).collect()} == {"0"}
    assert stats.stats_sheet(flat).count() == 1 and stats.probabilistic_sharpe(flat).first().sr is None


def test_rebalance_with_another_asset_name(spark):
    rng = np.random.default_rng(15)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), a, float(rng.normal(0, 0.01))) for i in range(40) for a in "XYZ"]
    a = spark.createDataFrame(rows, "date date, asset string, ret double")
    one = allocation.rolling_rebalance(a, 20, 5).orderBy("win").toPandas()
    two = allocation.rolling_rebalance(a.toDF("day", "name", "r"), 20, 5, "day", "name", "r").orderBy("win").toPandas()
    assert np.allclose(one.drop(columns="win"), two.drop(columns="win")) and len(one) == 4
    assert np.allclose(one.total_ivp, one.cum_ivp.cumprod()) and np.allclose(np.exp(one.log_total_hrp), one.cum_hrp.cumprod())


def test_risk_shares(spark):
    c = np.array([[4.0, 1.0], [1.0, 2.0]])
    cov = spark.createDataFrame([(a, b, float(c[i, j]), 0.0) for i, a in enumerate("AB") for j, b in enumerate("AB")], "a string, b string, cov double, corr double")
    for share in (None, [0.5, 0.5], [1.0, 0.0]):
        w = np.array([r.weight for r in allocation.pca_weights(cov, risk_dist=share).orderBy("asset").collect()])
        assert np.isclose(w @ c @ w, 1.0)
        v = np.linalg.eigh(c)[1]
        parts = [(w @ v[:, k]) ** 2 * np.linalg.eigh(c)[0][k] for k in (1, 0)]
        assert np.allclose(parts, share or [0.0, 1.0])
    with pytest.raises(ValueError, match="risk shares"):
        try:
            allocation.pca_weights(cov, risk_dist=[1.0]).collect()
        except Exception as e:
            raise ValueError(str(e)) from None


# ------------------------------------------------------------- sources
@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_epochs_in_any_session_zone(spark, zone):
    rng = np.random.default_rng(16)
    ns = [1577975400123456789, 1577975400000000999, 0, -1, 1710054000000000000, 1730613600123456000] + rng.integers(10**18, 2 * 10**18, 300).tolist()
    df = spark.createDataFrame([(int(x),) for x in ns], "ns long")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    c = F.col("ns")
    for r in df.select("ns", text(S.sip_to_utc(c)).alias("utc"), text(S.sip_to_ny(c)).alias("ny"), F.unix_micros(S.sip_to_ts(c)).alias("us"), S.ny_to_sip(S.sip_to_ny(c)).alias("back")).collect():
        us = r.ns // 1000
        utc = pd.Timestamp(us, unit="us", tz="UTC")
        assert r.us == us and r.utc == utc.strftime("%Y-%m-%d %H:%M:%S.%f") and r.ny == utc.tz_convert("America/New_York").strftime("%Y-%m-%d %H:%M:%S.%f")
        if utc.tz_convert("America/New_York").strftime("%m-%d %H") != "11-03 01":  # the hour that comes twice
            assert r.back == us * 1000


def test_ticker_from_the_path(spark):
    root = tempfile.mkdtemp(prefix="tessera-raw-")
    ns = int(dt.datetime(2024, 1, 2, 15, tzinfo=dt.timezone.utc).timestamp()) * 10**9
    for ticker, n in (("AAPL", 3), ("BRK.B", 2)):
        spark.createDataFrame([(ns, 10.0 + i, i + 1) for i in range(n)], "sip_timestamp long, price double, size int").coalesce(1).write.parquet(f"{root}/{ticker}/2024")
    out = S.read_trade_parquets(spark, root).collect()
    assert sorted(r.symbol for r in out) == ["AAPL"] * 3 + ["BRK.B"] * 2
    assert len({(r.symbol, r.seq) for r in out}) == 5  # ties have an order of their own
    by_seq = sorted((r for r in out if r.symbol == "AAPL"), key=lambda r: r.seq)
    assert [r.price for r in by_seq] == [10.0, 11.0, 12.0]


def test_ingest_fails_when_it_cannot_look(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="tessera-ingest-")
    assert S.ingested(spark, f"{root}/nothing").count() == 0
    with open(f"{root}/broken", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception) as e:
        S.ingested(spark, f"{root}/broken").collect()
    assert not isinstance(e.value, AnalysisException) or e.value.getCondition() != "PATH_NOT_FOUND"


def test_csv_times_and_sink(spark, zone):
    root = tempfile.mkdtemp(prefix="tessera-csv-")
    with open(f"{root}/ticks.csv", "w") as f:
        f.write("date,time,price,volume\n1/2/2024,9:30:00,1.5,2\n01/02/2024,09:30:00.1,1.6,3\n1/2/2024,9:30:00.123456,1.7,0\n1/3/2024,16:0:1.120,1.8,5\n")
    t = S.read_tick_csv(spark, f"{root}/ticks.csv")
    got = [(str(r.datetime), r.price) for r in t.orderBy("datetime").collect()]
    assert got == [("2024-01-02 09:30:00", 1.5), ("2024-01-02 09:30:00.100000", 1.6), ("2024-01-03 16:00:01.120000", 1.8)]
    S.write_tick_csv(t, f"{root}/clean")
    assert [(str(r.datetime), r.price) for r in S.read_clean_csv(spark, f"{root}/clean").orderBy("datetime").collect()] == got
    assert S.read_tick_csv(spark, f"{root}/ticks.csv", "2024-01-03").count() == 1


def test_time_barriers():
    half = dt.timedelta(minutes=30)
    b = sessions.time_barriers(half)
    assert len(b) == 14 and b[0] == 34_200_000_000 and b[-1] == 57_600_000_000
    for bad in (dt.timedelta(minutes=40), dt.timedelta(hours=6, minutes=30)):
        with pytest.raises(ValueError):
            sessions.time_barriers(bad)


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from tessera import session

    class Context:
        master, applicationId = "spark://host:7077", "a"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
