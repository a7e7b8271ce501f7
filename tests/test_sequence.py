import numpy as np
import pandas as pd

from tessera.plans import ewm as E
from tessera.plans.sequence import cumulative, fill, shift, with_pos


def frame(spark, n=3000, keys=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 20 * 86400, n)), unit="s")
        x = rng.normal(size=n)
        x[rng.random(n) < 0.05] = np.nan
        for i in range(n):
            rows.append((f"k{k}", t[i].to_pydatetime(), i, None if np.isnan(x[i]) else float(x[i])))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, x double"), rows


def test_positions_shift_cumulative_fill(spark):
    df, rows = frame(spark)
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "seq", "x"]).sort_values(["symbol", "ts", "seq"])
    got = with_pos(df, ["symbol"], ["ts", "seq"]).toPandas().sort_values(["symbol", "ts", "seq"])
    assert (got.groupby("symbol")["_pos"].apply(lambda s: (s.values == np.arange(len(s))).all())).all()
    s = shift(df, ["symbol"], ["ts", "seq"], {"x": "lx"}, 1).toPandas().sort_values(["symbol", "ts", "seq"])
    exp = pdf.groupby("symbol")["x"].shift(1)
    assert np.allclose(s.lx.to_numpy(), exp.to_numpy(), equal_nan=True)
    s2 = shift(df, ["symbol"], ["ts", "seq"], {"x": "l3"}, -3).toPandas().sort_values(["symbol", "ts", "seq"])
    assert np.allclose(s2.l3.to_numpy(), pdf.groupby("symbol")["x"].shift(-3).to_numpy(), equal_nan=True)
    c = cumulative(df, ["symbol"], ["ts", "seq"], {"cs": ("sum", "x"), "mx": ("max", "x")}).toPandas() \
        .sort_values(["symbol", "ts", "seq"])
    assert np.allclose(c.cs.to_numpy(), pdf.groupby("symbol")["x"].apply(lambda s: s.fillna(0).cumsum()).to_numpy())
    f = fill(df, ["symbol"], ["ts", "seq"], {"x": "fx"}).toPandas().sort_values(["symbol", "ts", "seq"])
    assert np.allclose(f.fx.to_numpy(), pdf.groupby("symbol")["x"].ffill().to_numpy(), equal_nan=True)


def test_ewm_matches_pandas_across_chunks(spark):
    df, rows = frame(spark, n=2500, keys=2, seed=1)
    pdf = pd.DataFrame(rows, columns=["symbol", "ts", "seq", "x"]).sort_values(["symbol", "ts", "seq"])
    for alpha in [0.5, 0.05]:  # alpha .5 -> chunks of 432 rows: several carries
        got = E.ewm(df, ["symbol"], ["ts", "seq"], "x", out_mean="m", out_std="s", alpha=alpha).toPandas() \
            .sort_values(["symbol", "ts", "seq"])
        em = pdf.groupby("symbol")["x"].transform(lambda s: s.ewm(alpha=alpha).mean())
        es = pdf.groupby("symbol")["x"].transform(lambda s: s.ewm(alpha=alpha).std())
        assert np.allclose(got.m.to_numpy(), em.to_numpy(), atol=1e-9, equal_nan=True)
        assert np.allclose(got.s.to_numpy(), es.to_numpy(), atol=1e-9, equal_nan=True)
