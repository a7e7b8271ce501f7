"""Structural breaks (X1-X4): OLS betas, lagged design matrices and the backward-expanding
supremum ADF, all from moment sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.functions.ols import centred_aggs, moment_aggs, ols_exprs
from tessera.plans.sequence import POS, cumulative, join_keys, shift, with_pos
from tessera.session import cut_lineage


# --------------------------------------------------------------------------- X1
def betas(df: DataFrame, y: str, xs: Sequence[str], keys=("symbol",)) -> DataFrame:
    """OLS coefficients and their variances (σ²·(XᵀX)⁻¹ diagonal) per key, from one aggregate.  With a column
    ``const`` among ``xs`` the sums are taken about the means, and its coefficient is what the means leave."""
    keys, free = list(keys), [x for x in xs if x != "const"]
    k = len(free)
    if k == len(xs):
        m = df.groupBy(*keys).agg(*[F.sum(F.expr(e)).alias(n) for n, e in moment_aggs(free, y)])
        ex = ols_exprs(k)
    else:
        m = df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in centred_aggs(free, y)], *[F.avg(x).alias(f"_u{i}") for i, x in enumerate(free)], F.avg(y).alias("_uy"))
        ex = ols_exprs(k, used=k + 1)
    cols = []
    for name in xs:
        if name in free:
            i = free.index(name)
            cols += [F.expr(ex[f"beta_{i}"]).alias(f"b_{name}"), F.expr(ex[f"var_{i}"]).alias(f"var_{name}")]
        else:
            spread = " + ".join(f"_u{i} * _u{j} * {ex[f'inv_{i}_{j}']}" for i in range(k) for j in range(k))
            cols += [F.expr("_uy - (" + " + ".join(f"{ex[f'beta_{i}']} * _u{i}" for i in range(k)) + ")").alias("b_const"),
                     F.expr(f"{ex['s2']} * (1.0 / m_n + {spread})").alias("var_const")]
    return m.select(*keys, *cols)


# --------------------------------------------------------------------------- X2
def lagged(df: DataFrame, cols: Sequence[str], lags, keys=("symbol",), order: Sequence[str] = ("time", "seq")) -> DataFrame:
    """Columns ``{c}_{k}`` = c lagged k rows for each k in ``lags`` (an int n means 0..n)."""
    keys = list(keys)
    ks = list(range(lags + 1)) if isinstance(lags, int) else [int(x) for x in lags]
    d = with_pos(df, keys, list(order))
    for k in ks:
        if k == 0:
            for c in cols:
                d = d.withColumn(f"{c}_0", F.col(c))
        else:
            d = shift(d, keys, list(order), {c: f"{c}_{k}" for c in cols}, k)
    return d.drop(POS)


# --------------------------------------------------------------------------- X3
def adf_design(series: DataFrame, value: str, lags: int = 1, constant: str = "c", keys=("symbol",),
               order: Sequence[str] = ("time", "seq")) -> DataFrame:
    """y = Δx_t; regressors: x_{t-1}, Δx_{t-1..t-lags}, then 1 (unless 'nc'), trend t ('ct',
    'ctt'), t² ('ctt'), where t counts the design rows from 0.  Rows with missing lags dropped."""
    keys = list(keys)
    d = with_pos(series.select(*keys, *order, value), keys, list(order))
    d = shift(d, keys, list(order), {value: "_lvl"}, 1)
    d = d.withColumn("y", F.col(value) - F.col("_lvl"))
    for k in range(1, lags + 1):
        d = shift(d, keys, list(order), {"y": f"dx_{k}"}, k)
    d = d.where(F.col("_lvl").isNotNull())
    for k in range(1, lags + 1):
        d = d.where(F.col(f"dx_{k}").isNotNull())
    # trend counts design rows: position minus the first usable position (lags + 1)
    d = d.withColumn("level", F.col("_lvl"))
    if constant != "nc":
        d = d.withColumn("const", F.lit(1.0))
        if constant.startswith("ct"):
            d = d.withColumn("trend", (F.col(POS) - F.lit(lags + 1)).cast("double"))
        if constant == "ctt":
            d = d.withColumn("trend2", F.col("trend") * F.col("trend"))
    return d.drop("_lvl")


def design_columns(lags: int, constant: str) -> list[str]:
    cols = ["level"] + [f"dx_{k}" for k in range(1, lags + 1)]
    if constant != "nc":
        cols.append("const")
        if constant.startswith("ct"):
            cols.append("trend")
        if constant == "ctt":
            cols.append("trend2")
    return cols


# --------------------------------------------------------------------------- X4
def bsadf(series: DataFrame, value: str, min_sl: int, constant: str = "c", lags: int = 1, keys=("symbol",),
          order: Sequence[str] = ("time", "seq")) -> DataFrame:
    """Backward-expanding supremum ADF at the last observation of each key: for every start
    point the ADF t-statistic of the level coefficient on rows [start, end]; the maximum over
    starts 0 .. rows + lags - min_sl.  The regression moments of [start, end] are suffix sums
    (accumulated from the end, so nothing is subtracted), one pass for all start points."""
    keys = list(keys)
    d = cut_lineage(adf_design(series, value, lags, constant, keys, order))
    xs = design_columns(lags, constant)
    k = len(xs)
    # with a constant the level may be shifted: about its mean the sums keep their digits
    n_rows = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.avg("level").alias("_mean"))
    # design row index = POS - (lags + 1); _rpos counts design rows from the end (0 = last row)
    d = join_keys(d, n_rows, keys).withColumn("_rpos", F.col("_rows") - 1 - (F.col(POS) - F.lit(lags + 1))).drop(POS)
    if constant != "nc":
        d = d.withColumn("level", F.col("level") - F.col("_mean"))
    aggs = moment_aggs(xs, "y")
    for name, e in aggs:
        d = d.withColumn(f"_c_{name}", F.expr(e))
    d = cumulative(d, keys, ["_rpos"], {name: ("sum", f"_c_{name}") for name, _ in aggs})
    # start index counted from the first design row: start = rows - 1 - _rpos
    d = d.withColumn("_start", F.col("_rows") - 1 - F.col("_rpos"))
    d = d.where(F.col("_start") <= F.col("_rows") + lags - min_sl)
    ex = ols_exprs(k)
    d = d.withColumn("_adf", F.expr(ex["t_0"]))
    last = series.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    res = d.groupBy(*keys).agg(F.max("_adf").alias("bsadf"), F.count(F.lit(1)).alias("starts"))
    return join_keys(res, last, keys).select(*keys, F.col(f"_last.{order[0]}").alias("time"), "bsadf", "starts")
