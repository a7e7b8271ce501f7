"""Bet sizing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.functions.normal import norm_cdf
from tessera.plans.sequence import join_keys
from tessera.plans.timejoin import overlap_counts
from tessera.session import cut_lineage


# --------------------------------------------------------------------------- Z1
def avg_active_signals(signals: DataFrame, keys=("symbol",), start="t0", end="t1", value="signal") -> DataFrame:
    """At every distinct start or end time, the mean signal of those active (start <= t < end,
    or end unknown); 0 when none is active.  A sweep, not a loop over times."""
    keys = list(keys)
    signals = cut_lineage(signals.select(*keys, start, end, value))  # four branches read it
    times = (signals.select(*keys, F.col(start).alias("time"))
             .unionByName(signals.where(F.col(end).isNotNull()).select(*keys, F.col(end).alias("time"))).distinct())
    c = overlap_counts(signals, keys, start, end, times, "time", value=value, end_inclusive=False)
    return c.select(*keys, "time", F.when(F.col("alive") > 0, F.col("alive_sum") / F.col("alive"))
                    .otherwise(F.lit(0.0)).alias("signal"))


# --------------------------------------------------------------------------- Z2
def discrete_signal(signal: Column, step: float) -> Column:
    """Round half-to-even to a multiple of ``step``, then cap to [-1, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.bround(signal / step, 0) * step))


# --------------------------------------------------------------------------- Z3
def signal_from_probability(events: DataFrame, step: float, num_classes: int = 2, keys=("symbol",),
                            prob="prob", pred="pred", side: str | None = None) -> DataFrame:
    """z = (p - 1/k)/sqrt(p(1-p)); size = pred·(2Φ(z) - 1) (·side for meta-labels); averaged
    over active bets (Z1) and discretised (Z2).  events: keys, t0, t1, prob, pred[, side]."""
    keys = list(keys)
    p = F.col(prob)
    z = (p - 1.0 / num_classes) / F.sqrt(p * (1.0 - p))
    s0 = F.col(pred) * (2 * norm_cdf(z) - 1)
    if side:
        s0 = s0 * F.col(side)
    sig = events.withColumn("signal", s0)
    act = avg_active_signals(sig, keys)
    return act.withColumn("signal", discrete_signal(F.col("signal"), step))


# --------------------------------------------------------------------------- Z4
def bet_size(x: Column, w: Column | float) -> Column:
    return x / F.sqrt(w + x * x)


def calibrate_w(x: float, m: float) -> float:
    """w such that a divergence x gives bet size m."""
    return x ** 2 * (m ** -2 - 1)


def inv_price(f: Column, w: Column | float, m: Column) -> Column:
    return f - m * F.sqrt(w / (1 - m * m))


def sigmoid_sizing(forecasts: DataFrame, w: float, max_pos: int, keys=("symbol",),
                   order: Sequence[str] = ("time", "seq"), forecast="forecast", price="price") -> DataFrame:
    """Target position int(bet_size(f - p, w)·max_pos), its breakeven limit price against the
    previous target position (mean inverse price over the unit steps between them) and the
    bet size.  The reference passes (w, f - p) swapped into bet_size; we use (f - p, w)."""
    from tessera.plans.sequence import shift
    keys = list(keys)
    d = forecasts.withColumn("size", bet_size(F.col(forecast) - F.col(price), F.lit(w)))
    d = d.withColumn("target_pos", (F.col("size") * max_pos).cast("int"))
    d = shift(d, keys, list(order), {"target_pos": "pos"}, 1)
    d = d.withColumn("pos", F.coalesce("pos", F.lit(0)))
    sgn = F.when(F.col("target_pos") >= F.col("pos"), 1).otherwise(-1)
    lo = F.abs(F.col("pos") + sgn)
    hi = F.abs(F.col("target_pos") + 1)
    # the inverse price of a step is the forecast less a number of the step alone: their sums up to each step are constants
    m = np.arange(max_pos) / max_pos
    sums = F.lit(np.concatenate(([0.0], np.cumsum(m * np.sqrt(w / (1 - m * m))))).tolist())
    total = F.when(hi > lo, (hi - lo) * F.col(forecast) - (F.get(sums, hi) - F.get(sums, lo))).otherwise(F.lit(0.0))
    return d.withColumn("limit_price", F.when(F.col("target_pos") != F.col("pos"),
                                              total / (F.col("target_pos") - F.col("pos"))))


# --------------------------------------------------------------------------- Z5 / Z6
def concurrent_bets(signals: DataFrame, keys=("symbol",), start="t0", end="t1", side="side",
                    dates: DataFrame | None = None, time_col="time", lookback_days: int | None = None) -> DataFrame:
    """Long (side >= 0) and short bets alive at each date (start <= date <= end, end included; open bets stay
    alive).  Dates default to the signals' start times.  With ``lookback_days`` only bets started at most so many
    days before a date count for it (the reference looks back 25)."""
    keys = list(keys)
    if lookback_days is not None:
        last = F.col(start) + F.expr(f"INTERVAL {int(lookback_days)} DAYS")
        signals = signals.withColumn(end, F.least(F.coalesce(F.col(end), last), last))
    signals = cut_lineage(signals.select(*keys, start, end, side))  # three branches read it
    probes = dates if dates is not None else signals.select(*keys, F.col(start).alias(time_col)).distinct()
    sides = signals.withColumn("_long", F.col(side) >= 0)
    lng = overlap_counts(sides.where("_long"), keys, start, end, probes, time_col, end_inclusive=True)
    sht = overlap_counts(sides.where(~F.col("_long")), keys, start, end, probes, time_col, end_inclusive=True)
    both = join_keys(probes, lng.select(*keys, time_col, F.col("alive").alias("long")), [*keys, time_col], "left")
    both = join_keys(both, sht.select(*keys, time_col, F.col("alive").alias("short")), [*keys, time_col], "left")
    return both.fillna(0, ["long", "short"])


def size_from_concurrency(conc: DataFrame, keys=("symbol",)) -> DataFrame:
    """long/max(long) - short/max(short) per key (the maxima are one aggregate per key)."""
    keys = list(keys)
    conc = cut_lineage(conc)
    mx = conc.groupBy(*keys).agg(F.max("long").alias("_ml"), F.max("short").alias("_ms"))
    d = join_keys(conc, mx, keys)
    lp = F.when(F.col("_ml") > 0, F.col("long") / F.col("_ml")).otherwise(F.lit(0.0))
    sp = F.when(F.col("_ms") > 0, F.col("short") / F.col("_ms")).otherwise(F.lit(0.0))
    return d.withColumn("size", lp - sp).drop("_ml", "_ms")


# --------------------------------------------------------------------------- Z7
def fit_two_normals(x: np.ndarray, n: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, standard deviations) of a mixture of two normals, by EM on values ``x`` that occur ``n``
    times, from the halves below and above the mean."""
    total, mean = n.sum(), (x * n).sum() / n.sum()
    spread = max(float(np.sqrt((n * (x - mean) ** 2).sum() / total)), 1e-6)
    w, mu, sd = np.array([0.5, 0.5]), np.array([mean - spread, mean + spread]), np.array([spread, spread])
    for _ in range(rounds):
        logs = np.log(w) - np.log(sd) - 0.5 * ((x[:, None] - mu) / sd) ** 2
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        share *= n[:, None] / share.sum(axis=1, keepdims=True)
        mass = np.maximum(share.sum(axis=0), 1e-12)
        new = (share * x[:, None]).sum(axis=0) / mass
        sd = np.maximum(np.sqrt((share * (x[:, None] - new) ** 2).sum(axis=0) / mass), 1e-3 * spread)
        w, moved, mu = mass / mass.sum(), np.abs(new - mu).max(), new
        if moved < 1e-9 * spread:
            break
    return w, mu, sd


def size_from_mixture(conc: DataFrame, keys=("symbol",)) -> DataFrame:
    """Fit a two-component normal mixture to each key's c = long - short and size each bet by the mixture's
    CDF around 0: (F(c)-F(0))/(1-F(0)) for c >= 0, else (F(c)-F(0))/F(0).  The fit reads the counts of the
    values of c (whole numbers: a row per key and value); the CDF is exact (Φ of each component)."""
    keys = list(keys)
    d = conc.withColumn("c", (F.col("long") - F.col("short")).cast("double"))
    counts = d.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("_n"))
    names = ["_w0", "_w1", "_m0", "_m1", "_s0", "_s1"]
    schema = T.StructType([counts.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in names])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        parts = np.concatenate(fit_two_normals(pdf["c"].to_numpy(float), pdf["_n"].to_numpy(float)))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **dict(zip(names, parts))}])[schema.names]

    d = join_keys(d, counts.groupBy(*keys).applyInPandas(fit, schema), keys)

    def cdf(x: Column) -> Column:
        return sum((F.col(f"_w{k}") * norm_cdf((x - F.col(f"_m{k}")) / F.col(f"_s{k}")) for k in (0, 1)), F.lit(0.0))

    f0, fc = cdf(F.lit(0.0)), cdf(F.col("c"))
    size = F.when(F.col("c") >= 0, F.try_divide(fc - f0, 1 - f0)).otherwise(F.try_divide(fc - f0, f0))
    return d.withColumn("size", size).drop(*names)
