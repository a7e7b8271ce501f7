"""Returns, bands and event filters.

Series inputs are ``(keys..., time, seq, close)`` style DataFrames; every ordered frame goes
through the two-level helpers of :mod:`tessera.plans.sequence`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tessera.plans import ewm as E
from tessera.plans.sequence import CHUNK, HALO, POS, chunk_window, halo_chunks, join_keys, shift, with_pos
from tessera.plans.timejoin import asof


def _rolling(df: DataFrame, keys, order, n: int) -> tuple[DataFrame, W]:
    d = halo_chunks(df, keys, order, before=n - 1)
    w = W.partitionBy(*keys, CHUNK).orderBy(POS).rowsBetween(-(n - 1), 0)
    return d, w


def _done(d: DataFrame, keep_pos=False) -> DataFrame:
    d = d.where(~F.col(HALO)).drop(HALO, CHUNK)
    return d if keep_pos else d.drop(POS)


# --------------------------------------------------------------------------- F1
def _cusum_day(x: np.ndarray, h: float, pos: float, neg: float):
    hit = np.zeros(len(x), dtype=np.int32)
    for i in range(len(x)):
        pos = max(0.0, pos + x[i])
        neg = min(0.0, neg + x[i])
        if neg < -h:
            neg = 0.0
            hit[i] = -1
        elif pos > h:
            pos = 0.0
            hit[i] = 1
    return hit, pos, neg


def cusum_events(series: DataFrame, h: float, keys: Sequence[str] = ("symbol",), time_col: str = "time",
                 value: str = "close", seq: str | None = "seq", chunk_rows: int = 1 << 16) -> DataFrame:
    """Symmetric CUSUM filter on first differences of ``value``: sPos = max(0, sPos+Δ),
    sNeg = min(0, sNeg+Δ); an event when sNeg < -h (tested first) or sPos > h, and only the
    tripped side resets.  Duplicate times keep their first row.

    Both accumulators stay within [-h, h] between steps, so they never trip together: each side is
    an independent clamped accumulator whose day is summarised by a transfer table over its entry
    state (``clamped_transfer``: a live interval plus the concrete states that clamps and resets
    collapse into, usually one row).  Pass 1 builds the tables per (key, chunk of positions), pass 2 walks the
    chunks of each key over those small tables, pass 3 rescans each (key, chunk) from its true entry
    state and emits the events -- no task ever holds more than ``chunk_rows`` rows."""
    from tessera.plans.segment import clamped_transfer, transfer_apply

    keys = list(keys)
    order = [time_col] + ([seq] if seq else [])
    # a group has one time; whole numbers are compared without a sort (a null stands before them)
    at = F.coalesce(F.col(seq), F.lit(-(1 << 63))) if seq and dict(series.dtypes)[seq] == "bigint" else F.struct(*order)
    first = series.groupBy(*keys, time_col).agg(F.min_by(value, at).alias("_x"))
    d = halo_chunks(first, keys, [time_col], before=1, chunk_rows=chunk_rows).withColumn("_prev", F.lag("_x").over(chunk_window(keys)))
    d = d.where(~F.col(HALO) & F.col("_prev").isNotNull())
    d = d.select(*keys, time_col, (F.col("_x") - F.col("_prev")).alias("_dx"), F.col(CHUNK).alias("_part"))
    key_fields = [f for f in d.schema.fields if f.name in keys]
    hh = float(h)

    # pass 1: transfer tables of both sides per (key, chunk)
    tschema = T.StructType(key_fields + [
        T.StructField("_part", T.LongType()), T.StructField("side", T.IntegerType()),
        T.StructField("lo", T.DoubleType()), T.StructField("lo_closed", T.BooleanType()),
        T.StructField("hi", T.DoubleType()), T.StructField("hi_closed", T.BooleanType()),
        T.StructField("live", T.BooleanType()), T.StructField("v", T.DoubleType())])

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time_col, kind="stable")["_dx"].to_numpy(dtype=np.float64)
        rows = [(1, *r) for r in clamped_transfer(x, hh)] + [(-1, *r) for r in clamped_transfer(-x, hh)]
        out = pd.DataFrame(rows, columns=["side", "lo", "lo_closed", "hi", "hi_closed", "live", "v"])
        for k in keys + ["_part"]:
            out[k] = pdf[k].iloc[0]
        return out[[f.name for f in tschema.fields]]

    tabs = d.groupBy(*keys, "_part").applyInPandas(tables, tschema)

    # pass 2: entry states per chunk, walking the (small) tables of each key in order
    eschema = T.StructType(key_fields + [T.StructField("_part", T.LongType()),
                                         T.StructField("_pos0", T.DoubleType()), T.StructField("_neg0", T.DoubleType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pos, negu = 0.0, 0.0
        for part, g in pdf.groupby("_part", sort=True):
            out.append((part, pos, -negu))
            rp = [tuple(r) for r in g[g.side == 1][["lo", "lo_closed", "hi", "hi_closed", "live", "v"]].itertuples(index=False)]
            rn = [tuple(r) for r in g[g.side == -1][["lo", "lo_closed", "hi", "hi_closed", "live", "v"]].itertuples(index=False)]
            pos, negu = transfer_apply(rp, pos), transfer_apply(rn, negu)
        res = pd.DataFrame(out, columns=["_part", "_pos0", "_neg0"])
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[f.name for f in eschema.fields]]

    entries = tabs.groupBy(*keys).applyInPandas(walk, eschema)

    # pass 3: events per (key, chunk) from the true entry state
    schema = T.StructType(key_fields + [T.StructField(time_col, d.schema[time_col].dataType),
                                        T.StructField("side", T.IntegerType())])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time_col, kind="stable")
        hit, _, _ = _cusum_day(pdf["_dx"].to_numpy(dtype=np.float64), hh,
                               float(pdf["_pos0"].iloc[0]), float(pdf["_neg0"].iloc[0]))
        m = hit != 0
        out = pd.DataFrame({time_col: pdf[time_col].to_numpy()[m], "side": hit[m]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[f.name for f in schema.fields]]

    return join_keys(d, entries, [*keys, "_part"]).groupBy(*keys, "_part").applyInPandas(scan, schema)


# --------------------------------------------------------------------------- F2 / F3
def bar_returns(bars: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("time", "seq"),
                close: str = "close", base: str = "current", out: str = "ret") -> DataFrame:
    """Close-to-close change divided by the current close (``base='current'``, as in the
    reference) or by the previous close (``base='previous'``); the first row has no return."""
    keys = list(keys)
    d = shift(bars, keys, list(order), {close: "_prev_close"}, 1)
    den = F.col(close) if base == "current" else F.col("_prev_close")
    return d.withColumn(out, F.try_divide(F.col(close) - F.col("_prev_close"), den)).where(F.col("_prev_close").isNotNull()) \
            .drop("_prev_close")


def flipped_returns(bars: DataFrame, keys=("symbol",), order=("time", "seq"), close="close", time_col="time",
                    out="ret") -> DataFrame:
    """Simple returns on the previous close with the sign flipped in odd calendar years."""
    d = bar_returns(bars, keys, order, close, base="previous", out=out)
    return d.withColumn(out, F.when(F.year(time_col) % 2 == 1, -F.col(out)).otherwise(F.col(out)))


# --------------------------------------------------------------------------- F4 / F5
def bollinger(bars: DataFrame, alpha: float, window: int = 20, min_periods: int | None = None,
              keys=("symbol",), order=("time", "seq"), close="close", first_std_zero: bool = False) -> DataFrame:
    """Moving average and bands ma ± alpha·std over ``window`` rows.  F4: window 20, null until
    20 rows.  F5: window 30, min_periods 1, the very first std set to 0."""
    keys = list(keys)
    mp = window if min_periods is None else min_periods
    d, w = _rolling(bars, keys, list(order), window)
    n = F.count(close).over(w)
    ma = F.when(n >= mp, F.avg(close).over(w))
    sd = F.when(n >= mp, F.stddev_samp(close).over(w))
    if first_std_zero:
        sd = F.when(F.col(POS) == 0, F.lit(0.0)).otherwise(sd)
    d = d.withColumn("ma", ma).withColumn("_sd", sd)
    d = (d.withColumn("b_upper", F.col("ma") + alpha * F.col("_sd"))
          .withColumn("b_lower", F.col("ma") - alpha * F.col("_sd")).drop("_sd"))
    return _done(d)


# --------------------------------------------------------------------------- F6 / F7
def band_breakouts(banded: DataFrame, direction: str = "up") -> DataFrame:
    if direction == "up":
        return banded.where((F.col("open") < F.col("b_upper")) & (F.col("close") > F.col("b_upper")))
    return banded.where((F.col("open") > F.col("b_lower")) & (F.col("close") < F.col("b_lower")))


def count_breakouts(banded: DataFrame, keys=("symbol",)) -> DataFrame:
    up = (F.col("open") < F.col("b_upper")) & (F.col("close") > F.col("b_upper"))
    down = (F.col("open") > F.col("b_lower")) & (F.col("close") < F.col("b_lower"))
    return banded.groupBy(*keys).agg(F.count_if(up | down).alias("num_intersect"))


# --------------------------------------------------------------------------- F8 / F9
def ma_crossings(bars: DataFrame, window: int = 30, keys=("symbol",), order=("time", "seq"), close="close",
                 flag: str = "before") -> DataFrame:
    """Rows where close crosses its moving average (min_periods 1).  ``flag='before'`` marks the
    row *before* the cross, as the reference does (it looks one row ahead); ``'after'`` marks the
    row where the cross is seen.  Output adds ``side`` = +1 (up) / -1 (down); up wins a tie."""
    keys = list(keys)
    d, w = _rolling(bars, keys, list(order), window)
    d = _done(d.withColumn("ma", F.avg(close).over(w)), keep_pos=True)
    k = -1 if flag == "before" else 1
    d = shift(d, keys, list(order), {close: "_c2", "ma": "_m2"}, k)
    below, above = F.col(close) < F.col("ma"), F.col(close) > F.col("ma")
    nb, na = F.col("_c2") < F.col("_m2"), F.col("_c2") > F.col("_m2")
    if flag == "before":
        up, down = below & na, above & nb
    else:
        up, down = nb & above, na & below
    d = d.withColumn("side", F.when(up, F.lit(1)).when(down, F.lit(-1)))
    return d.where(F.col("side").isNotNull()).drop("_c2", "_m2", POS)


def side_series(up: DataFrame, down: DataFrame, keys=("symbol",), time_col="time") -> DataFrame:
    """(keys, time, side) over the times of two sets of signals, +1 where ``up`` has one, else -1."""
    keys = list(keys)
    both = up.select(*keys, time_col, F.lit(1).alias("side")).unionByName(down.select(*keys, time_col, F.lit(-1).alias("side")))
    return both.groupBy(*keys, time_col).agg(F.max("side").alias("side"))


# --------------------------------------------------------------------------- F10 / F11 / F12
def rolling_autocorr(returns: DataFrame, window: int = 20, keys=("symbol",), order=("time", "seq"),
                     ret="ret", out="autocorr") -> DataFrame:
    """corr(r, r lagged one row) over the last ``window`` rows, min_periods 1 (pairs with a
    missing lag are skipped); NaN from constant windows becomes null."""
    keys = list(keys)
    rows = max(1 << 16, window)
    # one row more than the frame: the oldest pair's lag
    d = halo_chunks(returns, keys, list(order), before=window, chunk_rows=rows)
    d = d.withColumns({"_x": F.col(ret).cast("double"), "_has": F.col(ret).isNotNull()})
    kept = [c for c in returns.columns if c != out]
    schema = T.StructType([d.schema[c] for c in kept] + [T.StructField(out, T.DoubleType())])

    def chunk(t: pa.Table) -> pa.Table:
        t = t.sort_by(POS)
        c = _rolling_corr(t["_x"].to_numpy(), t["_has"].to_numpy(), window)
        t = t.select(kept + [HALO]).append_column(out, pa.array(c, mask=np.isnan(c)))
        return t.filter(pc.invert(t[HALO])).drop_columns([HALO])

    return d.groupBy(*keys, CHUNK).applyInArrow(chunk, schema)


def _rolling_corr(x: np.ndarray, has: np.ndarray, window: int) -> np.ndarray:
    """For each place the correlation of the values with those before them over its last ``window`` places (NaN without
    two pairs or without spread).  Frames are summed side by side, each from its oldest pair on about running means as
    Spark's ``corr`` does it, so that equal values have no spread at all."""
    pair = has & np.concatenate(([False], has[:-1]))
    a = np.where(pair, x, 0.0)
    b = np.where(pair, np.concatenate(([0.0], x[:-1])), 0.0)
    n, ma, mb, ab, aa, bb = np.zeros((6, len(x)))
    with np.errstate(all="ignore"):
        for back in range(min(window, len(x)) - 1, -1, -1):
            m, to = len(x) - back, slice(back, None)
            use, av, bv = pair[:m], a[:m], b[:m]
            n[to] += use
            k = np.maximum(n[to], 1.0)
            da, db = np.where(use, av - ma[to], 0.0), np.where(use, bv - mb[to], 0.0)
            ma[to] += da / k
            mb[to] += db / k
            ab[to] += da * (bv - mb[to])
            aa[to] += da * (av - ma[to])
            bb[to] += db * (bv - mb[to])
        spread = np.sqrt(aa * bb)
        return np.where((n > 1) & (spread > 0), ab / spread, np.nan)


def autocorr(returns: DataFrame, lags: Sequence[int] = (1,), keys=("symbol",), order=("time", "seq"),
             ret="ret", form: str = "pearson") -> DataFrame:
    """Autocorrelation per key and lag (0 included).  ``pearson``: corr(r, r lagged k) over the overlapping
    pairs (pandas ``autocorr``); ``acf``: Σ(x-m)(x_lag-m)/Σ(x-m)² with the global mean (the
    statsmodels form).  All lags come from one pass over chunks with the rows before them."""
    keys, lags = list(keys), [int(k) for k in lags]
    d = returns.select(*keys, *order, F.col(ret).alias("_r"))
    if form == "acf":
        d = join_keys(d, d.groupBy(*keys).agg(F.avg("_r").alias("_m")), keys).withColumn("_r", F.col("_r") - F.col("_m")).drop("_m")
    d = halo_chunks(d, keys, list(order), before=max(lags))
    w = W.partitionBy(*keys, CHUNK).orderBy(POS)
    d = d.withColumns({f"_l{k}": F.lag("_r", k).over(w) if k else F.col("_r") for k in lags}).where(~F.col(HALO))
    one = (lambda k: F.corr("_r", f"_l{k}")) if form == "pearson" else (lambda k: F.try_divide(F.sum(F.col("_r") * F.col(f"_l{k}")), F.sum(F.col("_r") * F.col("_r"))))
    found = d.groupBy(*keys).agg(F.array(*[F.struct(F.lit(k).alias("lag"), one(k).alias("autocorr")) for k in lags]).alias("_a"))
    return found.select(*keys, F.explode("_a").alias("_x")).select(*keys, "_x.autocorr", "_x.lag")


# --------------------------------------------------------------------------- F13
def jarque_bera(returns: DataFrame, keys=("symbol",), ret="ret") -> DataFrame:
    """n/6·(S² + K²/4) with population skewness and excess kurtosis."""
    return (returns.groupBy(*keys)
            .agg(F.count(ret).alias("n"), F.skewness(ret).alias("skew"), F.kurtosis(ret).alias("kurt"))
            .withColumn("jb", F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4.0)))


# --------------------------------------------------------------------------- F14
def daily_vol(close: DataFrame, span: int = 20, keys=("symbol",), time_col="time", value="close",
              seq: str = "seq") -> DataFrame:
    """For each row, the last row strictly before ``time - 1 day`` (backward as-of join), the
    return against it, then the EWM std (span 20) of those returns.  Rows without a row a day
    earlier are dropped, as in the reference."""
    keys = list(keys)
    # numbered before the as-of join, which then runs once: the rows without an earlier one are each key's first
    left = with_pos(close.select(*keys, time_col, seq, value), keys, [time_col, seq])
    j = asof(left, close.select(*keys, F.col(time_col).alias("_rt"), F.col(value).alias("_rv"), F.col(seq).alias("_rs")),
             keys, F.col(time_col) - F.expr("INTERVAL 1 DAY"), "_rt", {"_rv": "_prev_close"},
             direction="backward", inclusive=False, right_order=["_rs"])
    j = j.where(F.col("_prev_close").isNotNull()).withColumn("_r", F.try_divide(F.col(value), F.col("_prev_close")) - 1)
    return E.ewm(j, keys, [time_col, seq], "_r", out_std="vol", span=span).drop("_r", "_prev_close", POS)


# --------------------------------------------------------------------------- F15
def basic_ml_table(bars: DataFrame, keys=("symbol",), order=("time", "seq"), close="close", vol: str | None = None) -> DataFrame:
    """Previous close and volatility (the column ``vol``, if named) as features, up/down of the next close as
    label; rows that lack one are dropped.  The reference also keeps the next close among the features, which
    leaks the label; it is left out here."""
    keys = list(keys)
    d = shift(bars, keys, list(order), {close: "prev_close"}, 1, keep_pos=True)
    d = shift(d, keys, list(order), {close: "_next"}, -1)
    d = d.withColumn("label", (F.col("_next") > F.col(close)).cast("int"))
    whole = F.col("prev_close").isNotNull() & F.col("_next").isNotNull()
    return d.where(whole & F.col(vol).isNotNull() if vol else whole).drop("_next", POS)
