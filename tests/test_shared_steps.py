"""Work that several queries share is done once."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators.filters import rolling_autocorr
from tessera.plans import ewm as E
from tessera.plans.sequence import halo_chunks
from tessera.plans.timejoin import overlap_counts

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_running_sums_of_ewm_are_computed_once(spark):
    d = spark.range(10).select(F.lit("A").alias("symbol"), F.col("id").alias("_pos"), F.col("id").cast("double").alias("x"))
    p = plan(E.ewm(d, ["symbol"], ["_pos"], "x", out_std="s", span=3))
    assert sum("Window [" in line and "sum(" in line for line in p.splitlines()) == 1


def test_label_inputs_are_written(spark):
    ticks, crossings, targets, barriers, events, _ = registry.label_inputs(spark, DATA)
    for df in (ticks, crossings, targets, barriers, events):
        assert not any(word in plan(df) for word in ("Window", "Join", "Aggregate", "get_json_object"))


def test_autocorrelation_is_dealt_in_small_chunks(spark):
    """100,000 rows of a key are more than one group of the rolling window."""
    start = dt.datetime(2024, 1, 2)
    d = spark.range(100_000).select(F.lit("A").alias("symbol"), (F.lit(start) + F.make_dt_interval(secs=F.col("id"))).alias("time"), F.col("id").alias("seq"), F.rand(1).alias("ret"))
    assert "1048576" not in plan(rolling_autocorr(d, 20))
    assert rolling_autocorr(d, 20).where("autocorr is not null").count() == pytest.approx(100_000, abs=3)


def test_autocorrelation_has_no_sliding_frame_and_keeps_its_values(spark):
    """Nulls are skipped, a run of equal values has no correlation."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    x[40:80] = 0.25
    start = dt.datetime(2024, 1, 2)
    rows = [("A" if i % 3 else None, start + dt.timedelta(minutes=i), i, None if i in (100, 101, 200) else float(v)) for i, v in enumerate(x)]
    found = rolling_autocorr(spark.createDataFrame(rows, "symbol string, time timestamp_ntz, seq long, ret double"), 6)
    assert "corr(" not in plan(found)
    got = {r.seq: r.autocorr for r in found.collect()}
    for key in ("A", None):
        own = [r for r in rows if r[0] == key]
        r = pd.Series([np.nan if v[3] is None else v[3] for v in own])
        lag = r.shift(1)
        for k, row in enumerate(own):
            frame = slice(max(0, k - 5), k + 1)
            both = pd.DataFrame({"a": r[frame], "b": lag[frame]}).dropna()
            flat = len(both) < 2 or both.a.nunique() == 1 or both.b.nunique() == 1
            assert got[row[2]] is None if flat else got[row[2]] == pytest.approx(np.corrcoef(both.a, both.b)[0, 1], abs=1e-9)
    assert len(got) == 300


def test_halo_copies_are_made_in_one_pass(spark):
    d = spark.range(50).select(F.lit("A").alias("symbol"), F.col("id").alias("_pos"))
    cut = halo_chunks(d, ["symbol"], ["_pos"], before=2, after=3, chunk_rows=4, has_pos=True)
    assert "Union" not in plan(cut)
    got = sorted((r._chunk, r._halo, r._pos) for r in cut.collect())
    want = [(c, not c * 4 <= p < c * 4 + 4, p) for c in range(-1, 14) for p in range(50) if c * 4 - 2 <= p < c * 4 + 7 and (c >= 0)]
    assert got == sorted(want)


def test_counts_of_intervals_alive_sum_no_decimals(spark):
    t = dt.datetime(2024, 1, 2)
    iv = spark.createDataFrame([("A", t, t + dt.timedelta(hours=2)), ("A", t + dt.timedelta(hours=1), None)], "symbol string, t0 timestamp_ntz, t1 timestamp_ntz")
    times = spark.createDataFrame([("A", t + dt.timedelta(hours=h)) for h in range(4)], "symbol string, time timestamp_ntz")
    found = overlap_counts(iv, ["symbol"], "t0", "t1", times, "time")
    assert "decimal" not in plan(found)
    assert [(r.alive, r.alive_sum) for r in found.orderBy("time").collect()] == [(1, 1.0), (2, 2.0), (2, 2.0), (1, 1.0)]

