"""Operators on awkward series: empty, one row, null and repeated values, duplicate times, a null symbol.  The
result does not depend on how the rows are partitioned, and a null symbol is a symbol like any other."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from tessera.operators import allocation, bars, breaks, entropy, filters, fracdiff, labels, sessions, sizing, stats, weights
from tessera.plans import ewm as E

TRADES = "symbol string, ts timestamp_ntz, seq long, price double, size double"
SERIES = ("time", "seq")


def rows():
    rng = np.random.default_rng(21)
    t0 = dt.datetime(2024, 1, 2, 9, 40)
    out = []
    walks = {s: (50 + rng.normal(0, 0.4, 70).cumsum().round(2), rng.integers(1, 9, 70)) for s in ("A", "B")}
    for s in ("A", "B", None):
        px, size = walks[s or "A"]
        for i in range(70):
            # two rows share each fifth time; days 1 and 2; equal prices; one price of 0
            t = t0 + dt.timedelta(days=i // 40, minutes=13 * (i - (i % 5 == 4)))
            out.append((s, t, i, 0.0 if s == "B" and i == 33 else float(px[i - (i % 7 == 3)]), float(size[i])))
    return out + [("ONE", t0, 0, 7.0, 1.0), ("NULL", t0, 0, None, 1.0), ("NULL", t0 + dt.timedelta(hours=1), 1, 3.0, 2.0), ("NULL", t0 + dt.timedelta(hours=2), 2, None, None)]


def close(t):
    return t.select("symbol", F.col("ts").alias("time"), "seq", F.col("price").alias("close"))


def returns(t):
    return filters.bar_returns(close(t), order=SERIES, base="previous").select("symbol", "time", "seq", "ret")


def codes(t):
    return t.select("symbol", F.col("seq").alias("bar"), F.when(F.col("price") > 50, "1").otherwise("0").alias("code"))


def events(t):
    return t.where("seq % 6 = 0").select("symbol", F.col("ts").alias("t0"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("t1")).distinct()


def unique_times(t):
    return close(t).groupBy("symbol", "time").agg(F.min("seq").alias("seq"), F.min_by("close", "seq").alias("close"))


def positions(t):
    return t.select("symbol", F.col("ts").alias("time"), "seq", (F.col("size") - 4).alias("position"))


def signals(t):
    return events(t).withColumns({"signal": F.lit(0.5).cast("decimal(12,6)"), "side": F.lit(1.0)})


OPERATORS = {
    "tick_bars": lambda t: bars.tick_bars(t, 7),
    "dollar_bars": lambda t: bars.dollar_bars(t.where("price is not null"), 900.0, chunk_rows=16),
    "long_bars": lambda t: bars.dollar_bars(t.where("price is not null"), 9000.0, chunk_rows=16, long_bars=True),
    "daily_dollar_bars": lambda t: bars.daily_dollar_bars(t.where("price is not null"), divisor=10.0),
    "tick_rule": bars.tick_rule,
    "imbalance_bars": lambda t: bars.imbalance_bars(t.where("price is not null"), 3.0),
    "cusum": lambda t: filters.cusum_events(close(t).where("close is not null"), 0.7, chunk_rows=16),
    "bar_returns": returns,
    "bollinger": lambda t: filters.bollinger(bars.tick_bars(t, 3), 1.5, 5, order=("time",)),
    "ma_crossings": lambda t: filters.ma_crossings(close(t), 5),
    "rolling_autocorr": lambda t: filters.rolling_autocorr(returns(t), 6),
    "autocorr": lambda t: filters.autocorr(returns(t), (0, 1, 4), form="acf"),
    "jarque_bera": lambda t: filters.jarque_bera(returns(t)),
    "daily_vol": lambda t: filters.daily_vol(close(t)),
    "ewm": lambda t: E.ewm(close(t), ["symbol"], list(SERIES), "close", out_mean="m", out_std="s", span=3),
    "frac_diff_ffd": lambda t: fracdiff.frac_diff_ffd(close(t), 0.4, 0.05, chunk_rows=16),
    "frac_diff_expanding": lambda t: fracdiff.frac_diff_expanding(close(t), 0.4, 0.2, chunk_rows=16),
    "min_ffd": lambda t: fracdiff.min_ffd(close(t), [0.0, 0.5], 0.05, chunk_rows=16),
    "adf": lambda t: fracdiff.adf(close(t).withColumnRenamed("close", "x")),
    "lagged": lambda t: breaks.lagged(close(t), ["close"], 3),
    "bsadf": lambda t: breaks.bsadf(close(t), "close", 12),
    "vertical_barrier": lambda t: labels.vertical_barrier(unique_times(t), events(t).select("symbol", "t0"), 1),
    "triple_barrier": lambda t: labels.triple_barrier(unique_times(t), events(t).withColumn("trgt", F.lit(0.01)), [1.0, 1.0]),
    "num_concurrent": lambda t: weights.num_concurrent(unique_times(t), events(t)),
    "avg_uniqueness": lambda t: weights.avg_uniqueness(unique_times(t), events(t)),
    "return_weights": lambda t: weights.return_weights(unique_times(t), events(t)),
    "avg_active_signals": lambda t: sizing.avg_active_signals(signals(t)),
    "concurrent_bets": lambda t: sizing.concurrent_bets(signals(t)),
    "mixture": lambda t: sizing.size_from_mixture(sizing.concurrent_bets(signals(t))),
    "bets_timing": lambda t: stats.bets_timing(positions(t)),
    "holding_period": lambda t: stats.holding_period(positions(t), chunk_rows=16),
    "equity_curve": lambda t: stats.equity_curve(returns(t)),
    "drawdowns": lambda t: stats.drawdowns(stats.equity_curve(returns(t).where("ret is not null"))),
    "stats_sheet": lambda t: stats.stats_sheet(returns(t).where("ret is not null")),
    "quantile_code": lambda t: entropy.quantile_code(returns(t).where("ret is not null"), 4),
    "sigma_code": lambda t: entropy.sigma_code(returns(t).where("ret is not null")),
    "pmf": lambda t: entropy.pmf(codes(t), 2),
    "lempel_ziv": lambda t: entropy.lempel_ziv(codes(t)),
    "kontoyiannis": lambda t: entropy.kontoyiannis(codes(t), 5, chunk_rows=16),
    "ar1": lambda t: entropy.ar1(close(t), 0.5, order=SERIES, value="close"),
}


def plain(rows):
    def one(v):
        return None if isinstance(v, float) and np.isnan(v) else round(v, 7) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple((c, one(r[c])) for c in sorted(r.__fields__)) for r in rows), key=str)


def values(df):
    return plain(df.collect())


@pytest.fixture(scope="module")
def trades(spark):
    return spark.createDataFrame(rows(), TRADES).cache()


MORE = {
    "weekly_bar_counts": lambda t: sessions.weekly_bar_counts(close(t)),
    "indicator_matrix": lambda t: weights.indicator_matrix(unique_times(t), events(t)),
    "avg_uniqueness_from_indicator": lambda t: weights.avg_uniqueness_from_indicator(weights.indicator_matrix(unique_times(t), events(t))),
    "time_decay": lambda t: weights.time_decay(weights.avg_uniqueness(unique_times(t), events(t)), 0.5),
    "weighted_training_table": lambda t: weights.weighted_training_table(events(t), events(t).select("symbol", "t0", F.lit(2.0).alias("w")), events(t).select("symbol", "t0", F.lit(1).alias("bin"))),
    "get_events": lambda t: labels.get_events(unique_times(t), events(t).select("symbol", "t0"), [1.0, 1.0], unique_times(t).select("symbol", "time", F.lit(0.01).alias("trgt")), 0.0,
                                              t1=events(t), side=events(t).select("symbol", "t0", F.lit(-1.0).alias("side"))),
    "get_bins": lambda t: labels.get_bins(unique_times(t), events(t), t1=events(t).where("t1 < '2024-01-02 15:00:00'")),
    "meta_features": lambda t: labels.meta_features(close(t).withColumnRenamed("close", "vol"), unique_times(t).select("symbol", "time", F.lit(0.3).alias("autocorr")), events(t).withColumn("side", F.lit(1))),
    "primary_scores": lambda t: labels.primary_scores(events(t).withColumn("side", F.lit(1)), events(t).withColumn("bin", F.lit(1))),
    "barrier_mesh": lambda t: labels.barrier_mesh(unique_times(t), unique_times(t).where("seq % 9 = 0").select("symbol", "time"), [0.5, 1.0], [0.5, 1.0], max_hp=20),
    "engle_granger": lambda t: fracdiff.engle_granger(close(t).select("symbol", "time", "seq", F.col("close").alias("y"), F.sin("seq").alias("x"))),
    "covariance": lambda t: allocation.covariance(unique_times(t).select("symbol", F.col("time").alias("date"), F.lit("x").alias("asset"), F.col("close").alias("ret")), keys=("symbol",)),
    "cluster_variance": lambda t: allocation.cluster_variance(allocation.covariance(two_assets(t), keys=("symbol",)), two_assets(t).select("symbol", F.lit("c").alias("cluster"), "asset").distinct(), keys=("symbol",)),
}


def two_assets(t):
    u = unique_times(t).select("symbol", F.col("time").alias("date"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("asset"), "close", "seq")
    return u.select("symbol", "date", "asset", F.when(F.col("asset") == "x", F.col("close")).otherwise(F.col("close") * F.sin("seq")).alias("ret"))


@pytest.mark.parametrize("name", [*OPERATORS, *MORE])
def test_awkward_series(spark, trades, name):
    run = {**OPERATORS, **MORE}[name]
    out = run(trades.coalesce(1)).collect()
    one, many = plain(out), values(run(trades.repartition(7, "seq")))
    assert one == many and one
    assert run(trades.limit(0)).count() == 0
    # the series without a name is A's
    own = lambda key: plain([Row(**{c: v for c, v in r.asDict().items() if c != "symbol"}) for r in out if r["symbol"] == key])
    assert own("A") == own(None) and own("A")
