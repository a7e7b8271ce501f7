"""Fractional differentiation and stationarity tests.

Differences are convolutions of a key's series with fixed weights.  They are computed chunk by chunk: each
(key, position chunk) is one bounded Arrow group that also holds the rows before it which its weights reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.functions.ols import adf_crit_5pct_sql, centred_aggs, moment_aggs, ols_exprs
from tessera.plans.sequence import CHUNK, HALO, POS, fill, halo_chunks, join_keys, shift, with_pos
from tessera.session import cut_lineage

#: Rows of a chunk; wider weights make longer chunks.
CHUNK_ROWS = 1 << 16
#: Weights beyond this number are refused, not cut off.
MAX_WIDTH = 1 << 24


# --------------------------------------------------------------------------- D1 / D2
def weights(d: float, size: int, start: int = 0) -> np.ndarray:
    """Weights of lags start .. start + size - 1 in the expansion of (1 - B)^d: the product over j = 1..k of
    (j - 1 - d) / j."""
    lags = np.arange(start + 1, start + size, dtype=float)
    return weight_at(d, start) * np.concatenate(([1.0], np.cumprod((lags - 1.0 - d) / lags)))[:size]


def weight_at(d: float, lag: int) -> float:
    """One weight, by the ratio of gamma functions for far lags."""
    k = max(0, math.floor(d) + 2)
    near = float(np.prod([(j - 1.0 - d) / j for j in range(1, min(lag, k) + 1)]))
    if lag <= k or near == 0.0:
        return near
    return near * math.exp(math.lgamma(lag - d) - math.lgamma(k - d) + math.lgamma(k + 1) - math.lgamma(lag + 1))


def weights_ffd(d: float, thres: float, max_width: int = MAX_WIDTH) -> np.ndarray:
    """Weights up to the first whose size is below ``thres``, that one left out.  A sequence that stays above
    it for ``max_width`` lags (d < 0 with a small threshold) raises ValueError: give a larger threshold."""
    size = 1024
    while True:
        w = weights(d, size)
        below = np.flatnonzero(np.abs(w) < thres)
        if len(below):
            return w[:below[0]]
        if size > max_width:
            raise ValueError(f"weights of d={d} stay above {thres} for {max_width} lags")
        size *= 4


def weight_table(spark, d: float, thres: float) -> DataFrame:
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(weights_ffd(d, thres))], "lag int, w double")


def valid_convolution(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """sum_k w_k x_{t-k} for every t that has all its lags; FFT where both are long."""
    if len(x) < len(w):
        return np.zeros(0)
    if min(len(x), len(w)) < 256:
        return np.convolve(x, w, "valid")
    size = 1 << (len(x) + len(w) - 2).bit_length()
    level = x.mean()  # transforms lose digits to a high level
    y = np.fft.irfft(np.fft.rfft(x - level, size) * np.fft.rfft(w, size), size)
    return y[len(w) - 1:len(x)] + level * w.sum()


def _filled(series: DataFrame, keys: list[str], order: Sequence[str], value: str) -> DataFrame:
    """``_xf``: the forward-filled value; rows before the first value are dropped."""
    return fill(series, keys, list(order), {value: "_xf"}, "forward").where(F.col("_xf").isNotNull())


# --------------------------------------------------------------------------- D3
def frac_diff_ffd(series: DataFrame, d: float, thres: float = 1e-5, keys=("symbol",),
                  order: Sequence[str] = ("time", "seq"), value: str = "close", out: str = "ffd",
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Fixed-width fractional difference Σ_k w_k·x_{t-k} (k = 0..width) on the forward-filled
    series; rows before the first full window and rows whose own value is not finite are dropped."""
    keys = list(keys)
    w = weights_ffd(d, thres)
    width = len(w) - 1
    h = halo_chunks(_filled(series, keys, order, value), keys, list(order), before=width, chunk_rows=max(chunk_rows, width))
    kept = T.StructType([h.schema[c] for c in series.columns] + [T.StructField(out, T.DoubleType())])

    def conv(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        y = valid_convolution(table.column("_xf").cast(pa.float64()).to_numpy(), w)
        table = table.slice(table.num_rows - len(y))
        own = table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        keep = pa.array(~table.column(HALO).to_numpy(zero_copy_only=False).astype(bool) & np.isfinite(own))
        return table.append_column(out, pa.array(y)).select(kept.names).filter(keep)

    return h.groupBy(*keys, CHUNK).applyInArrow(conv, kept)


# --------------------------------------------------------------------------- D4
def expanding_skip(d: float, n: int, thres: float) -> int:
    """Rows left out of an expanding difference of n rows: lags K whose tail sum_{k >= K} |w_k| is over
    ``thres`` of the whole.  From lag floor(d) + 1 on the weights have one sign, and sums of weights are
    ratios of gamma functions, so the tail needs no pass over n weights."""
    near = max(0, math.floor(d) + 1)
    first = weights(d, min(n, near + 1))
    upto = np.concatenate(([0.0], np.cumsum(np.abs(first))))

    def total(k: int) -> float:  # sum of |w| over lags below k
        if k < len(upto):
            return float(upto[k])
        # sum over lags below m of the weights of d is the weight of d - 1 at lag m - 1
        return float(upto[-1]) + abs(weight_at(d - 1, k - 1) - weight_at(d - 1, len(upto) - 2))

    whole, lo, hi = total(n), 0, n
    while lo < hi:  # the first lag whose tail is not over
        mid = (lo + hi) // 2
        if whole - total(mid) > thres * whole:
            lo = mid + 1
        else:
            hi = mid
    return lo


def frac_diff_expanding(series: DataFrame, d: float, thres: float = 0.01, keys=("symbol",),
                        order: Sequence[str] = ("time", "seq"), value: str = "close", out: str = "fd",
                        chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Expanding-window fractional difference Σ_{k<=i} w_k·x_{i-k} with weights sized to the key's length;
    the first ``expanding_skip`` rows are dropped.

    Every row depends on the key's whole history, so this is a convolution by overlap-add: a chunk of
    positions is transformed against the weights of each later chunk's lags and sends it its part, and the
    parts of a chunk are added up as they arrive.  Tasks hold a few chunks; the work is chunks² / 2 transforms
    for a key by definition (the fixed width, D3, is linear)."""
    keys = list(keys)
    d0 = cut_lineage(with_pos(_filled(series, keys, order, value).select(*keys, *order, F.col(value).alias("_orig"), "_xf"), keys, list(order)))
    sizes = d0.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chunked = d0.withColumn(CHUNK, F.floor(F.col(POS) / chunk_rows).cast("long"))
    key_fields = [d0.schema[c] for c in keys]
    parts = T.StructType(key_fields + [T.StructField(CHUNK, T.LongType()), T.StructField("_part", T.ArrayType(T.DoubleType()))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by(POS)
        x, n, own = table.column("_xf").cast(pa.float64()).to_numpy(), table.column("_n")[0].as_py(), table.column(CHUNK)[0].as_py()
        for to in range(own, -(-n // chunk_rows)):
            rows = min(chunk_rows, n - to * chunk_rows)
            lag = (to - own) * chunk_rows
            # lags lag - len(x) + 1 .. lag + rows - 1; those below 0 have weight 0
            low = max(0, lag - len(x) + 1)
            w = np.concatenate((np.zeros(max(0, len(x) - 1 - lag)), weights(d, lag + rows - low, low)))
            part = valid_convolution(w, x)
            yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().slice(0, 1) for k in keys), pa.array([to]), pa.array([part.tolist()], pa.list_(pa.float64()))], parts.names)

    sent = join_keys(chunked, sizes, keys).groupBy(*keys, CHUNK).applyInArrow(send, parts)
    placed = sent.select(*keys, CHUNK, F.posexplode("_part").alias("_i", "_p")).groupBy(*keys, CHUNK, "_i").agg(F.sum("_p").alias(out))
    placed = placed.withColumn(POS, F.col(CHUNK) * chunk_rows + F.col("_i")).select(*keys, POS, out)
    skips = F.udf(lambda n: expanding_skip(d, n, thres), "long")
    skip = sizes.select(*keys, skips("_n").alias("_skip"))
    res = join_keys(join_keys(d0, placed, [*keys, POS]), skip, keys)
    return res.where((F.col(POS) >= F.col("_skip")) & F.col("_orig").isNotNull() & ~F.isnan("_orig")).select(*keys, *order, out)


# --------------------------------------------------------------------------- D5
def adf_moments(series: DataFrame, keys=("symbol",), order: Sequence[str] = ("time", "seq"), value: str = "x",
                regression: str = "c") -> DataFrame:
    """Per key, the moment sums of the one-lag Dickey-Fuller regression
    Δx_t = β·x_{t-1} + γ·Δx_{t-1} (+ α), t >= 2; about the means with a constant."""
    keys = list(keys)
    s = shift(series.select(*keys, *order, value), keys, list(order), {value: "_l1"}, 1, keep_pos=True)
    s = shift(s, keys, list(order), {value: "_l2"}, 2)
    s = s.withColumn("_y", F.col(value) - F.col("_l1")).withColumn("_dl", F.col("_l1") - F.col("_l2"))
    s = s.where(F.col("_l2").isNotNull())
    xs = ["_l1", "_dl"]
    sums = [F.expr(e).alias(n) for n, e in centred_aggs(xs, "_y")] if regression == "c" else [F.sum(F.expr(e)).alias(n) for n, e in moment_aggs(xs, "_y")]
    return s.groupBy(*keys).agg(*sums)


def _adf_exprs(regression: str) -> dict[str, str]:
    return ols_exprs(2, used=3 if regression == "c" else 2)


def adf(series: DataFrame, keys=("symbol",), order: Sequence[str] = ("time", "seq"), value: str = "x",
        regression: str = "c") -> DataFrame:
    """ADF statistic with one lag and a constant (autolag off), the observation count and the
    5% critical value; ``passes`` = statistic <= critical value.  p-values are not built."""
    # the series is read by two lags and the positions: materialise it once
    m = adf_moments(cut_lineage(series.select(*keys, *order, value)), keys, order, value, regression)
    return m.select(*keys, F.expr(_adf_exprs(regression)["t_0"]).alias("adf_stat"), F.col("m_n").alias("nobs"),
                    F.expr(adf_crit_5pct_sql(regression, "m_n")).alias("crit_5pct")) \
            .withColumn("passes", F.col("adf_stat") <= F.col("crit_5pct"))


# --------------------------------------------------------------------------- D6
def min_ffd(series: DataFrame, d_values: Sequence[float], thres: float = 0.01, keys=("symbol",),
            order: Sequence[str] = ("time", "seq"), value: str = "close", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """ADF statistic of the fixed-width fractional difference for every d of the grid, and the
    smallest d whose statistic passes the 5% critical value.

    Each (key, chunk) group holds the rows its widest weights reach and emits, for each d, the count, the
    means and the centred products of its regression rows; these (chunks x grid rows) are merged about the
    common mean.  Inputs are taken finite after the forward fill."""
    keys = list(keys)
    grid = [(float(dv), weights_ffd(float(dv), thres)) for dv in d_values]
    reach = max(len(w) for _, w in grid) + 1  # ffd at t, t-1 and t-2 for the one-lag regression
    h = halo_chunks(_filled(series, keys, order, value).select(*keys, *order, "_xf"), keys, list(order), before=reach, chunk_rows=max(chunk_rows, reach))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    key_fields = [h.schema[c] for c in keys]
    cols = ["d", "n", *(f"s{i}" for i in range(3)), *(f"c{i}{j}" for i, j in pairs)]
    schema = T.StructType(key_fields + [T.StructField(c, T.DoubleType()) for c in cols])

    def moments(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        x, pos = table.column("_xf").cast(pa.float64()).to_numpy(), table.column(POS).to_numpy()
        own = ~table.column(HALO).to_numpy(zero_copy_only=False).astype(bool)
        rows = []
        for dv, w in grid:
            f = valid_convolution(x, w)
            if len(f) < 3:
                continue
            use = own[-len(f) + 2:] & (pos[-len(f) + 2:] >= len(w) + 1)
            z = np.stack((f[1:-1], f[1:-1] - f[:-2], f[2:] - f[1:-1]))[:, use]
            if z.shape[1]:
                mean = z.mean(axis=1)
                c = (z - mean[:, None]) @ (z - mean[:, None]).T
                rows.append((dv, float(z.shape[1]), *(mean * z.shape[1]), *(c[i, j] for i, j in pairs)))
        data = list(zip(*rows)) if rows else [[] for _ in cols]
        first = [table.column(k).combine_chunks().take(pa.array([0] * len(rows), pa.int64())) for k in keys]
        return pa.table([*first, *(pa.array(list(c), pa.float64()) for c in data)], schema.names)

    part = h.groupBy(*keys, CHUNK).applyInArrow(moments, schema)
    # total centred products: the parts' own, and those of the parts' means about the common mean
    part = part.withColumns({f"u{i}": F.col(f"s{i}") / F.col("n") for i in range(3)})
    whole = part.groupBy(*keys, "d").agg(F.sum("n").alias("n"), *[(F.sum(f"s{i}") / F.sum("n")).alias(f"g{i}") for i in range(3)])
    both = join_keys(part.withColumnRenamed("n", "n_part"), whole, [*keys, "d"])
    between = lambda i, j: F.col("n_part") * (F.col(f"u{i}") - F.col(f"g{i}")) * (F.col(f"u{j}") - F.col(f"g{j}"))
    total = {(i, j): F.sum(F.col(f"c{i}{j}") + between(i, j)) for i, j in pairs}
    m = both.groupBy(*keys, "d").agg(total[0, 0].alias("m_xx_0_0"), total[0, 1].alias("m_xx_0_1"), total[1, 1].alias("m_xx_1_1"), total[0, 2].alias("m_xy_0"),
                                     total[1, 2].alias("m_xy_1"), total[2, 2].alias("m_yy"), F.first("n").cast("long").alias("m_n"))
    res = m.select(*keys, "d", F.expr(_adf_exprs("c")["t_0"]).alias("adf_stat"), F.col("m_n").alias("nobs"),
                   F.expr(adf_crit_5pct_sql("c", "m_n")).alias("crit_5pct"))
    res = cut_lineage(res.withColumn("passes", F.col("adf_stat") <= F.col("crit_5pct")))
    best = res.where("passes").groupBy(*keys).agg(F.min("d").alias("min_d"))
    return join_keys(res, best, keys, "left")


# --------------------------------------------------------------------------- D7 / D8 / D9
def correlation(a: DataFrame, keys=("symbol",), x="x", y="y") -> DataFrame:
    return a.groupBy(*keys).agg(F.corr(x, y).alias("corr"))


def engle_granger(a: DataFrame, keys=("symbol",), order: Sequence[str] = ("time", "seq"), y="y", x="x") -> DataFrame:
    """Engle-Granger statistic: residuals of y on x (with constant), then the one-lag DF
    regression on the residuals without constant."""
    keys = list(keys)
    a = cut_lineage(a.select(*keys, *order, y, x))
    fit = a.groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    r = join_keys(a, fit, keys).withColumn("_e", F.col(y) - F.col("_a") - F.col("_b") * F.col(x))
    out = adf(r.select(*keys, *order, "_e"), keys, order, "_e", regression="n")
    return out.withColumnRenamed("adf_stat", "eg_stat")


def r_squared(a: DataFrame, keys=("symbol",), x="x", y="y") -> DataFrame:
    return a.groupBy(*keys).agg(F.regr_r2(y, x).alias("r2"), F.regr_slope(y, x).alias("slope"),
                                F.regr_intercept(y, x).alias("intercept"))

