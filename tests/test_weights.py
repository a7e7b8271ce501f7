"""The indicator matrix in pairs and in runs, and the draws of the sequential bootstrap, against loops."""

import datetime as dt
import time
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.operators import weights

BASE = dt.datetime(2024, 1, 2, 10)


def at(minutes):
    return BASE + dt.timedelta(minutes=float(minutes))


@pytest.fixture(scope="module")
def series(spark):
    """Closes (one time of A twice), and events: short, long, open, without closes, past the end, one twice."""
    rnd = np.random.default_rng(3)
    close, events = [], []
    for key, n in (("A", 700), (None, 90)):
        when = np.sort(rnd.choice(20000, n, replace=False)) / 7
        close += [(key, at(t), float(i)) for i, t in enumerate(when)]
        for t in when[rnd.choice(n, n // 5, replace=False)]:
            reach = rnd.choice([0.0, 3.0, 40.0, 900.0])
            events.append((key, at(t), at(t + rnd.random() * reach) if rnd.random() < 0.95 else None))
    close.append(("A", close[333][1], -1.0))
    events += [("A", at(5000), at(6000)), ("A", at(7), at(3)), ("B", at(1), None)]
    events.append(events[5])
    return (spark.createDataFrame(close, "symbol string, time timestamp_ntz, close double"),
            spark.createDataFrame(events, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz"), close, events)


def pairs(close, events):
    out = []
    for key, t0, t1 in events:
        own = [t for k, t, _ in close if k == key]
        out += [(key, t0, t) for t in own if t0 <= t <= (t1 or max(own))]
    return out


def listed(rows):
    return sorted([tuple(r) for r in rows], key=str)


def test_matrix_in_pairs(series):
    c, e, close, events = series
    assert listed(weights.indicator_matrix(c, e).collect()) == listed(pairs(close, events))


def test_pairs_are_dealt_by_their_number(spark):
    """Three thousand events over a thousand closes each: the input is small, the pairs are 3 million and stand in several tasks."""
    when = F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz")
    close = spark.range(20_000).select(F.lit("A").alias("symbol"), when.alias("time"))
    e = spark.range(3_000).withColumn("id", F.col("id") * 6).select(F.lit("A").alias("symbol"), when.alias("t0"), (when + F.expr("INTERVAL 999 SECONDS")).alias("t1"))
    ind = weights.indicator_matrix(close, e).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in ind) == 3_000_000
    assert len(ind) > 1 and max(r.n for r in ind) < 2_500_000


def test_uniqueness_from_runs(series):
    c, e, close, events = series
    ones = pairs(close, events)
    column, row = {}, {}
    for key, _, t in ones:
        column[key, t] = column.get((key, t), 0) + 1
    for key, t0, t in ones:
        row.setdefault((key, t0), []).append(1 / column[key, t])
    for form in (True, False):
        found = weights.avg_uniqueness_from_indicator(weights.indicator_matrix(c, e, runs=form)).collect()
        assert {(r.symbol, r.t0): r.avg_uniqueness for r in found} == pytest.approx({k: np.mean(v) for k, v in row.items()}, abs=1e-12)
        assert len(found) == len(row)


def by_loop(members, n_bars, rng, length=None):
    """The draws, every event's uniqueness computed again before each."""
    n = len(members)
    cov, drawn = np.zeros(n_bars), []
    mean = lambda sample: (lambda k: np.mean([np.mean(1 / k[members[i]]) for i in sample]))(sum(np.bincount(members[i], minlength=n_bars) for i in sample))
    for _ in range(length or n):
        u = np.array([(1 / (cov[m] + 1)).mean() for m in members])
        drawn.append(int(rng.choice(n, p=u / u.sum())))
        cov[members[drawn[-1]]] += 1
    return drawn, mean(rng.integers(0, n, size=length or n)), mean(drawn)


def test_draws_are_those_of_the_loop(series):
    c, e, close, events = series
    e = e.dropDuplicates(["symbol", "t0"])
    c = c.where("close >= 0")
    kept = [(r.symbol, r.t0, r.t1) for r in e.collect()]
    ones = pairs([x for x in close if x[2] >= 0], kept)
    for form in (True, False):
        out = weights.sequential_bootstrap(weights.indicator_matrix(c, e, runs=form), replicates=2, seed=5).collect()
        for key in ("A", None):
            ev = sorted({t0 for k, t0, _ in ones if k == key})
            bars = sorted({t for k, _, t in ones if k == key})
            members = [np.array([bars.index(t) for k, t0, t in ones if k == key and t0 == x]) for x in ev]
            for rep in range(2):
                rng = np.random.default_rng([5, rep, zlib.crc32(str(key).encode())])
                drawn, std, seq = by_loop(members, len(bars), rng)
                mine = sorted([r for r in out if r.symbol == key and r.replicate == rep], key=lambda r: r.draw)
                assert [r.t0 for r in mine] == [ev[i] for i in drawn]
                assert (mine[0].std_uniq, mine[0].seq_uniq) == pytest.approx((std, seq), abs=1e-12)


def test_draws_with_gaps_in_a_row(spark):
    """An event whose ones are not consecutive has several runs."""
    rnd = np.random.default_rng(8)
    members = [np.flatnonzero(rnd.random(60) < 0.3) for _ in range(30)]
    ind = spark.createDataFrame([("A", at(1000 + i), at(int(b))) for i, m in enumerate(members) for b in m], "symbol string, t0 timestamp_ntz, time timestamp_ntz")
    out = sorted(weights.sequential_bootstrap(ind, seed=2, sample_length=80).collect(), key=lambda r: r.draw)
    bars = {int(b): k for k, b in enumerate(sorted({int(b) for m in members for b in m}))}
    drawn, std, seq = by_loop([np.array([bars[int(b)] for b in m]) for m in members], len(bars), np.random.default_rng([2, 0, zlib.crc32(b"A")]), 80)
    assert [r.t0 for r in out] == [at(1000 + i) for i in drawn]
    assert (out[0].std_uniq, out[0].seq_uniq) == pytest.approx((std, seq), abs=1e-12)


def test_draws_of_many_events():
    """40,000 events: to compute all uniqueness again at each draw would take hours."""
    rnd = np.random.default_rng(1)
    n = 40_000
    first = np.sort(rnd.choice(400_000, n, replace=False))
    last = first + np.where(rnd.random(n) < 0.05, 5000, 10)
    began = time.time()
    d = weights._Draws(np.arange(n), first, last, n)
    drawn = d.sequential(n, np.random.default_rng(0))
    assert time.time() - began < 60
    assert len(np.unique(drawn)) > 0.5 * n and 0 < d.mean_uniqueness(drawn) < 1
