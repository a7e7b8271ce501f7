"""Searches by the multi-level index against plain scans."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.labels import triple_barrier, vertical_barrier
from tessera.plans.pathindex import locate, path_index

T0 = dt.datetime(2010, 1, 1)


def series(spark, n, step, symbols=("A", None), seed=1, crowd=None):
    """Random walks, ``step`` apart; ``crowd`` rows in the middle are a microsecond apart."""
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        px = 100 * np.exp(rng.normal(0, 0.004, n).cumsum())
        t = T0
        for i in range(n):
            t += dt.timedelta(microseconds=1) if crowd and crowd[0] <= i < crowd[1] else step
            out.append((s, t, float(px[i])))
    return out, spark.createDataFrame(out, "symbol string, time timestamp_ntz, close double")


def slow(rows, events, pt, sl):
    out = {}
    for s, t0, t1, trgt, side in events:
        path = [(t, p) for k, t, p in rows if k == s and t >= t0 and (t1 is None or t <= t1)]
        whole = [p for k, t, p in rows if k == s and t == t0]
        up = dn = None
        if whole:
            for t, p in path:
                r = (p / whole[0] - 1) * side
                up = up or (t if pt and r > pt * trgt else None)
                dn = dn or (t if sl and r < -sl * trgt else None)
        out[s, t0] = (up, dn)
    return out


EVENTS = "symbol string, t0 timestamp_ntz, t1 timestamp_ntz, trgt double, side double"


@pytest.mark.parametrize("fan", [2, 3, 32])
@pytest.mark.parametrize("pt,sl", [(1.0, 1.0), (0.0, 2.0), (3.0, 0.0)])
def test_touches(spark, fan, pt, sl):
    rows, close = series(spark, 300, dt.timedelta(minutes=7), crowd=(100, 180))
    rng = np.random.default_rng(fan)
    events = []
    for s in ("A", None):
        own = [r for r in rows if r[0] == s]
        for i in rng.choice(300, 25, replace=False).tolist():
            t1 = None if i % 3 == 0 else own[min(299, i + int(rng.integers(0, 60)))][1]
            events.append((s, own[i][1], t1, float(rng.choice([0.001, 0.01, 0.05, -0.01])), float(rng.choice([1.0, -1.0]))))
        events.append((s, own[3][1] + dt.timedelta(seconds=1), None, 0.01, 1.0))  # no close at t0
    events.append(("Q", T0, None, 0.01, 1.0))  # no series
    index = path_index(close, ["symbol"], "time", "close", fan=fan)
    assert len(index.levels) == {2: 9, 3: 6, 32: 2}[fan]
    out = triple_barrier(close, spark.createDataFrame(events, EVENTS), [pt, sl], index=index)
    assert {(r.symbol, r.t0): (r.pt, r.sl) for r in out.collect()} == slow(rows, events, pt, sl)


def test_targets_at_one_start(spark):
    """Three ticks at each time give three targets: an event has a row for each of them, not for each pair of them."""
    rows, close = series(spark, 120, dt.timedelta(minutes=7), symbols=("A",))
    close = close.crossJoin(spark.range(3).withColumnRenamed("id", "_copy")).drop("_copy")
    trgt = [(s, t, [0.05, 0.002, 0.03][k], t + dt.timedelta(hours=2)) for s, t, _ in rows[:100:10] for k in range(3)]
    trgt += [("A", rows[5][1], None, rows[15][1]), ("A", rows[5][1], 0.01, rows[15][1])]
    ev = spark.createDataFrame([(s, t, t1, g, 1.0) for s, t, g, t1 in trgt], EVENTS)
    out = triple_barrier(close, ev, [1.0, 1.0]).collect()
    smallest = slow(rows, [(s, t, t1, 0.01 if t == rows[5][1] else 0.002, 1.0) for s, t, g, t1 in trgt], 1.0, 1.0)
    assert sorted((r.t0, r.trgt or 0.0) for r in out) == sorted((t, g or 0.0) for _, t, g, _ in trgt)
    assert {(r.symbol, r.t0, r.pt, r.sl) for r in out} == {(*k, *v) for k, v in smallest.items()}


def test_ten_years_of_open_paths(spark):
    """Two hundred open events over ten years of daily rows: blocks are read, not hours."""
    rows, close = series(spark, 3650, dt.timedelta(days=1), symbols=("A",))
    events = [("A", rows[i][1], None, 0.3, 1.0) for i in range(0, 3600, 18)]
    index = path_index(close, ["symbol"], "time", "close")
    out = triple_barrier(close, spark.createDataFrame(events, EVENTS), [1.0, 1.0], index=index)
    px, times = np.array([r[2] for r in rows]), [r[1] for r in rows]
    for r in out.collect():
        i = times.index(r.t0)
        ret = px[i:] / px[i] - 1
        for got, hit in ((r.pt, ret > 0.3), (r.sl, ret < -0.3)):
            assert got == (times[i + int(hit.argmax())] if hit.any() else None)
    # a search reads three blocks of `fan` items on each of log(rows) levels
    assert len(index.levels) == 3 and max(r.n for r in index.levels[0].select(F.size("_items").alias("n")).collect()) == index.fan


def test_locate(spark):
    rows, close = series(spark, 200, dt.timedelta(hours=5))
    index = path_index(close, ["symbol"], "time", "close", fan=4)
    at = [("A", rows[k][1] + dt.timedelta(minutes=m)) for k in (0, 1, 57, 64, 199) for m in (-1, 0, 1)] + [(None, T0), ("Q", T0), ("A", None)]
    out = locate(index, spark.createDataFrame(at, "symbol string, t timestamp_ntz"), F.col("t"), {"pos": "p", "time": "pt", "value": "v"})
    for r in out.collect():
        own = [x for x in rows if x[0] == r.symbol]
        later = [(i, x) for i, x in enumerate(own) if r.t is not None and x[1] >= r.t]
        want = (later[0][0], later[0][1][1], later[0][1][2]) if later else (None, None, None)
        assert (r.p, r.pt, r.v) == want


def test_vertical_barriers_and_empty_series(spark):
    rows, close = series(spark, 60, dt.timedelta(hours=7), symbols=("A",))
    ev = spark.createDataFrame([("A", r[1]) for r in rows], "symbol string, t0 timestamp_ntz")
    for r in vertical_barrier(close, ev, 2).collect():
        assert r.t1 == min((x[1] for x in rows if x[1] >= r.t0 + dt.timedelta(days=2)), default=None)
    assert vertical_barrier(close.limit(0), ev, 2).where("t1 is null").count() == 60
    out = triple_barrier(close.limit(0), ev.withColumns({"t1": F.lit(None).cast("timestamp_ntz"), "trgt": F.lit(0.1)}), [1.0, 1.0])
    assert out.where("pt is null and sl is null").count() == 60
