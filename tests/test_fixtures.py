"""Small hand-worked cases (FIXTURES.md section 3)."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 2, 10, 0)


def at(i):
    return T0 + dt.timedelta(days=int(i))


def series(spark, values, sym="A"):
    return spark.createDataFrame([(sym, at(i), i, float(v)) for i, v in enumerate(values)],
                                 "symbol string, time timestamp_ntz, seq long, close double")


def test_f1_cusum(spark):
    from tessera.operators.filters import cusum_events
    ev = cusum_events(series(spark, [0, 1, 2.5, 1.0, -1.2]), 2.0).orderBy("time").collect()
    assert [(r.time, r.side) for r in ev] == [(at(2), 1), (at(4), -1)]


def test_f2_returns(spark):
    from tessera.operators.filters import bar_returns
    r = bar_returns(series(spark, [100, 125])).collect()[0].ret
    assert abs(r - 0.2) < 1e-12
    r = bar_returns(series(spark, [100, 125]), base="previous").collect()[0].ret
    assert abs(r - 0.25) < 1e-12


def test_l1_l2_l3(spark):
    from tessera.operators.labels import get_bins, get_events
    close = series(spark, [100, 101, 99, 102, 98])
    seeds = spark.createDataFrame([("A", at(0))], "symbol string, t0 timestamp_ntz")
    t1 = spark.createDataFrame([("A", at(0), at(4))], "symbol string, t0 timestamp_ntz, t1 timestamp_ntz")
    for trgt, t1_exp, ret_exp, bin_exp in [(0.015, at(3), 0.02, 1), (0.05, at(4), -0.02, 0)]:
        tr = close.select("symbol", "time", F.lit(trgt).alias("trgt"))
        ev = get_events(close, seeds, [1, 1], tr, 0.0, t1=t1)
        row = ev.collect()[0]
        assert row.t1 == t1_exp
        b = get_bins(close, ev, t1=t1).collect()[0]
        assert abs(b.ret - ret_exp) < 1e-12 and b.bin == bin_exp


def test_w1_w2_w8(spark):
    from tessera.operators.weights import avg_uniqueness, num_concurrent, time_decay
    close = series(spark, [1, 1, 1, 1])
    ev = spark.createDataFrame([("A", at(0), at(2)), ("A", at(1), at(3))], "symbol string, t0 timestamp_ntz, t1 timestamp_ntz")
    c = [r.c for r in num_concurrent(close, ev).orderBy("time").collect()]
    assert c == [1, 2, 2, 1]
    u = [r.tw for r in avg_uniqueness(close, ev).orderBy("t0").collect()]
    assert np.allclose(u, [2 / 3, 2 / 3])
    tw = spark.createDataFrame([("A", at(0), 0.5), ("A", at(1), 0.5)], "symbol string, t0 timestamp_ntz, tw double")
    d = [r.decay for r in time_decay(tw, 0.0).orderBy("t0").collect()]
    assert np.allclose(d, [0.5, 1.0])


def test_d2_d3(spark):
    from tessera.operators.fracdiff import frac_diff_ffd, weights
    assert np.allclose(weights(0.5, 4), [1, -0.5, -0.125, -0.0625])
    out = [r.ffd for r in frac_diff_ffd(series(spark, [1, 4, 9]), 1.0, 0.01).orderBy("time").collect()]
    assert out == [3.0, 5.0]


def test_m1_m2_m3(spark):
    from tessera.operators.cv import embargo_times, purge_train, purged_kfold
    tr = spark.createDataFrame([(at(a), at(b)) for a, b in [(0, 1), (2, 3), (4, 5), (1, 6)]], "t0 timestamp_ntz, t1 timestamp_ntz")
    tt = spark.createDataFrame([(at(2), at(4))], "start timestamp_ntz, end timestamp_ntz")
    assert [r.t0 for r in purge_train(tr, tt).collect()] == [at(0)]
    times = spark.createDataFrame([(at(i),) for i in range(10)], "time timestamp_ntz")
    e = {r.time: r.embargo for r in embargo_times(times, 0.25).collect()}
    assert e[at(0)] == at(2) and e[at(8)] == at(9) and e[at(9)] == at(9)
    ev = spark.createDataFrame([("A", at(i), at(i + 1)) for i in range(6)], "symbol string, t0 timestamp_ntz, t1 timestamp_ntz")
    k = purged_kfold(ev, 3).collect()
    got = {(r.fold, r.role): sorted(int((r.t0 - T0).days) for x in [r]) for r in k}
    roles = {}
    for r in k:
        roles.setdefault((r.fold, r.role), []).append((r.t0 - T0).days)
    assert sorted(roles[(0, "test")]) == [0, 1] and sorted(roles[(0, "train")]) == [2, 3, 4, 5]
    assert sorted(roles[(1, "test")]) == [2, 3] and sorted(roles[(1, "train")]) == [0, 1, 4, 5]
    assert sorted(roles[(2, "test")]) == [4, 5] and sorted(roles[(2, "train")]) == [0, 1, 2, 3]
    del got
    ev10 = spark.createDataFrame([("A", at(i), at(i)) for i in range(10)], "symbol string, t0 timestamp_ntz, t1 timestamp_ntz")
    sizes = {}
    for r in purged_kfold(ev10, 3).where("role = 'test'").collect():
        sizes[r.fold] = sizes.get(r.fold, 0) + 1
    assert [sizes[i] for i in range(3)] == [4, 3, 3]


def test_z1_z2(spark):
    from tessera.operators.sizing import avg_active_signals, discrete_signal
    s = spark.createDataFrame([("A", at(0), at(2), 1.0), ("A", at(1), at(3), -0.5)],
                              "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, signal double")
    got = {r.time: r.signal for r in avg_active_signals(s).collect()}
    assert np.allclose([got[at(i)] for i in range(4)], [1.0, 0.25, -0.5, 0.0])
    v = spark.createDataFrame([(x,) for x in [0.25, 0.75, 0.6, 1.4]], "s double")
    assert [r[0] for r in v.select(discrete_signal(F.col("s"), 0.5)).collect()] == [0.0, 1.0, 0.5, 1.0]


def test_k1_k2_k3_k4(spark):
    from tessera.operators.stats import bets_timing, drawdowns, hhi, holding_period
    p = spark.createDataFrame([("A", at(i), i, float(v)) for i, v in enumerate([1, 1, 0, -1, 1])],
                              "symbol string, time timestamp_ntz, seq long, position double")
    assert sorted(r.seq for r in bets_timing(p).collect()) == [2, 4]
    p2 = spark.createDataFrame([("A", at(i), i, float(v)) for i, v in enumerate([0, 1, 2, 1])],
                               "symbol string, time timestamp_ntz, seq long, position double")
    assert abs(holding_period(p2).collect()[0].holding_days - 1.5) < 1e-12
    r = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("A", 2.0)], "symbol string, ret double")
    assert abs(hhi(r).collect()[0].hhi_pos - 0.0625) < 1e-12
    eq = spark.createDataFrame([("A", at(i), i, float(v)) for i, v in enumerate([1, 1.2, 0.9, 1.3, 1.0, 1.1])],
                               "symbol string, time timestamp_ntz, seq long, equity double")
    dd = drawdowns(eq).orderBy("time").collect()
    assert np.allclose([x.dd for x in dd], [0.25, 1 - 1.0 / 1.3])
    assert abs(dd[0].tuw - 2 / 365.2425) < 1e-12


def test_a3_a5(spark):
    from tessera.operators.allocation import hrp_numpy, ivp_numpy
    cov = np.array([[1.0, 0.3], [0.3, 4.0]])
    corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    assert np.allclose(ivp_numpy(cov), [0.8, 0.2])
    assert np.allclose(hrp_numpy(cov, corr), [0.8, 0.2])


def test_n1_n2_n3(spark):
    from tessera.operators.entropy import lempel_ziv, plug_in_entropy, pmf
    codes = spark.createDataFrame([("A", i, c) for i, c in enumerate("ababa")], "symbol string, bar long, code string")
    p = {r.word: r.p for r in pmf(codes, 2).collect()}
    assert np.allclose([p["ab"], p["ba"]], [2 / 3, 1 / 3])
    h = plug_in_entropy(codes, 2).collect()[0].entropy
    assert abs(h - 0.4591479170272448) < 1e-9
    lz = spark.createDataFrame([("A", i, c) for i, c in enumerate("aababc")], "symbol string, bar long, code string")
    assert lempel_ziv(lz).collect()[0].lz_size == 3


def test_p1_p3_s4(spark):
    from datetime import timedelta

    from tessera.operators.sessions import regular_session, split_intervals
    from tessera.sources.trades import sip_to_ny
    ny = [dt.datetime(2024, 1, 2, 9, 29, 59, 999999), dt.datetime(2024, 1, 2, 9, 30), dt.datetime(2024, 1, 2, 16, 0),
          dt.datetime(2024, 1, 2, 16, 0, 0, 1)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ny)], "i int, ny timestamp_ntz")
    assert sorted(r.i for r in regular_session(d, "ny").collect()) == [1, 2]
    d2 = spark.createDataFrame([(0, dt.datetime(2024, 1, 2, 10, 0))], "i int, ny timestamp_ntz")
    assert sorted(r.interval_id for r in split_intervals(d2, "ny", timedelta(minutes=30)).collect()) == [0, 1]
    v = spark.range(1).select(sip_to_ny(F.lit(1577975400123456789)).alias("t")).collect()[0].t
    assert v.replace(tzinfo=None) == dt.datetime(2020, 1, 2, 9, 30, 0, 123456)
