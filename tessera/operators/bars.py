"""Bars (B1-B15): tick, volume, dollar, daily-adaptive dollar and imbalance bars.

Inputs are trade tables ``(symbol, ts, seq, price, size)``; ``keys`` defaults to ``["symbol"]``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tessera.plans import ewm as E
from tessera.plans.segment import threshold_bars
from tessera.plans.sequence import CHUNK, HALO, KEY, POS, fill, halo_chunks, join_keys, shift, with_pos
from tessera.session import cut_lineage

ORDER = ("ts", "seq")


# --------------------------------------------------------------------------- B1
def tick_bars(trades: DataFrame, freq: int, keys: Sequence[str] = ("symbol",), order=ORDER) -> DataFrame:
    """Every ``freq`` ticks one bar.  Bar k covers positions [k·freq, (k+1)·freq) and exists only
    when (k+1)·freq < n, i.e. (n-1) div freq bars: the partial tail and, when freq divides n, the
    last full bar are not produced.  ``time`` is the bar's last tick."""
    keys = list(keys)
    d = with_pos(trades, keys, list(order)).withColumn("bar", F.floor(F.col(POS) / F.lit(freq)).cast("long"))
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    last = F.struct(*order)
    bars = d.groupBy(*keys, "bar").agg(
        F.max_by("ts", last).alias("time"), F.min_by("price", last).alias("open"),
        F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", last).alias("close"), F.sum("size").alias("volume"))
    return (join_keys(bars, n, keys).where((F.col("bar") + 1) * F.lit(freq) < F.col("_n")).drop("_n"))


# --------------------------------------------------------------------------- B2 / B3
def volume_bars(trades: DataFrame, threshold: float, keys: Sequence[str] = ("symbol",), keep_tail=False, **chunks):
    """``chunks``: ``chunk_rows`` and ``long_bars`` of ``threshold_bars``."""
    return threshold_bars(trades, keys, F.col("size"), threshold, ORDER, keep_tail=keep_tail, **chunks).drop("last_seq", "price_std")


def dollar_bars(trades: DataFrame, threshold: float, keys: Sequence[str] = ("symbol",), keep_tail=False, **chunks):
    return threshold_bars(trades, keys, F.col("price") * F.col("size"), threshold, ORDER, keep_tail=keep_tail, **chunks).drop("last_seq", "price_std")


# --------------------------------------------------------------------------- B4
def daily_dollar_volume(trades: DataFrame, keys: Sequence[str] = ("symbol",), date_col=None, span: float = 4):
    """Daily dollar volume, its EWM mean (span 4) over days, shifted one day and back-filled:
    day 1 therefore uses its own volume, and so does the only day of a key that has one."""
    keys = list(keys)
    date = date_col if date_col is not None else F.to_date("ts")
    daily = trades.groupBy(*keys, date.alias("date")).agg(F.sum(F.col("price") * F.col("size")).alias("dollar_volume"))
    daily = E.ewm(daily, keys, ["date"], "dollar_volume", out_mean="_ewm", span=span)
    # the day table has one row per key and day, so a per-key window on it is small
    w = W.partitionBy(*keys).orderBy("date")
    daily = daily.withColumn("_lag", F.lag("_ewm", 1).over(w))
    daily = daily.withColumn("daily_threshold", F.coalesce(
        F.col("_lag"), F.first("_lag", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)), F.col("_ewm")))
    return daily.select(*keys, "date", "dollar_volume", "daily_threshold")


# --------------------------------------------------------------------------- B5 / B6
def daily_dollar_bars(trades: DataFrame, keys: Sequence[str] = ("symbol",), divisor: float = 1000.0,
                      vol_span: float = 10) -> DataFrame:
    """Dollar bars whose threshold is the day's adaptive dollar volume / 1000; the running sum
    restarts with every bar and every day: threshold bars of (key, day) series, a threshold for each.
    Features: time (last tick), OHLC, volume, price_std (sample), log_range = ln(high/low) (null for a low that is
    not positive), count, and ``volatility`` = EWM mean (span 10) of price_std over the key's bars.  Tails are
    kept."""
    keys = list(keys)
    thr = daily_dollar_volume(trades, keys).select(*keys, "date", "daily_threshold")
    d = join_keys(trades.withColumn("date", F.to_date("ts")), thr, [*keys, "date"])
    bars = threshold_bars(d, [*keys, "date"], F.col("price") * F.col("size"), F.col("daily_threshold") / divisor, ORDER, keep_tail=True)
    bars = bars.select(*keys, "date", F.col("bar").alias("group_id"), F.col("end_ts").alias("time"), "last_seq", "open", "close", "high", "low", "volume", "price_std",
                       F.when(F.col("low") > 0, F.ln(F.col("high") / F.col("low"))).alias("log_range"), F.col("ticks").alias("count"))
    bars = E.ewm(bars, keys, ["time", "last_seq"], "price_std", out_mean="volatility", span=vol_span)
    return bars.drop("last_seq")


# --------------------------------------------------------------------------- B7
def tick_rule(trades: DataFrame, keys: Sequence[str] = ("symbol",), first_sign: int = 1,
              out: str = "price_diff") -> DataFrame:
    """Sign of the price change; unchanged prices carry the last sign; the first tick of a key
    takes ``first_sign`` (the reference draws it at random)."""
    keys = list(keys)
    d = shift(trades, keys, list(ORDER), {"price": "_prev_price"}, 1)
    s = F.signum(F.col("price") - F.col("_prev_price")).cast("int")
    d = d.withColumn("_s", F.when(F.col("_prev_price").isNull(), F.lit(first_sign)).otherwise(F.nullif(s, F.lit(0))))
    d = fill(d, keys, list(ORDER), {"_s": out}, "forward")
    return d.drop("_s", "_prev_price")


# --------------------------------------------------------------------------- B8-B12
def add_pbuy_psell(d: DataFrame, keys, span: float = 1000) -> DataFrame:
    d = d.withColumn("_buy", F.floor((F.col("price_diff") + 1) / 2).cast("double"))
    d = d.withColumn("_sell", F.floor((-F.col("price_diff") + 1) / 2).cast("double"))
    d = with_pos(d, keys, list(ORDER))
    d = E.ewm(d, keys, list(ORDER), "_buy", out_mean="pbuy_ewm", span=span)
    d = E.ewm(d, keys, list(ORDER), "_sell", out_mean="psell_ewm", span=span)
    return d.drop("_buy", "_sell", POS)


def add_log_dollars(d: DataFrame) -> DataFrame:
    return d.withColumn("log_dollars_exchanged", F.col("price_diff") * F.ln(F.col("size") * F.col("price")))


def add_log_dollars_ewm(d: DataFrame, keys, alpha: float = 0.01) -> DataFrame:
    """EWM of the signed log dollars separately over buy ticks and over sell ticks (the side is
    simply one more key), then both forward-filled over the merged timeline."""
    keys = list(keys)
    side = [*keys, "price_diff"]
    d = E.ewm(d, side, list(ORDER), "log_dollars_exchanged", out_mean="_side_ewm", alpha=alpha)
    d = (d.withColumn("_buy_ewm", F.when(F.col("price_diff") == 1, F.col("_side_ewm")))
          .withColumn("_sell_ewm", F.when(F.col("price_diff") == -1, F.col("_side_ewm"))))
    d = fill(d, keys, list(ORDER), {"_buy_ewm": "log_dollars_buy_exchanged_ewm",
                                   "_sell_ewm": "log_dollars_sell_exchanged_ewm"}, "forward")
    return d.drop("_side_ewm", "_buy_ewm", "_sell_ewm")


def add_expected_log_dollars(d: DataFrame) -> DataFrame:
    return d.withColumn("expected_log_dollars_exchanged",
                        F.coalesce(F.col("log_dollars_buy_exchanged_ewm"), F.lit(0.0)) * F.col("pbuy_ewm")
                        + F.coalesce(F.col("log_dollars_sell_exchanged_ewm"), F.lit(0.0)) * F.col("psell_ewm"))


def imbalance_thresholds(trades: DataFrame, keys: Sequence[str] = ("symbol",), ewm: bool = False,
                         first_sign: int = 1) -> DataFrame:
    """Tick rule, and with ``ewm`` the P(buy)/P(sell), signed log dollars, their per-side
    EWMs and the expected imbalance."""
    keys = list(keys)
    d = tick_rule(trades, keys, first_sign)
    if ewm:
        # each step is a two-level plan that reads its input twice; a reliable checkpoint between
        # steps keeps the plan linear instead of doubling the upstream work at every step
        d = cut_lineage(d)
        d = cut_lineage(add_pbuy_psell(d, keys))
        d = add_log_dollars(d)
        d = add_log_dollars_ewm(d, keys)
        d = add_expected_log_dollars(d)
    return d


# --------------------------------------------------------------------------- B13 / B14
#: What a bar carries on: expected length, signed sum, ticks, open, high, low, volume.
IMB_STATE = ("length", "total", "ticks", "open", "high", "low", "volume")


def _imbalance_chunk(price: np.ndarray, size: np.ndarray, x: np.ndarray, need: np.ndarray, state: Sequence[float]):
    """Bars that close in a run of ticks, from the state before it: (rows closing, their states, state after).

    The sum runs on in the order of the ticks, so a bar has the same sum wherever a chunk cuts it."""
    length, total, ticks, first, high, low, volume = state
    at, closed, ends = 0, [], []
    while at < len(x):
        lo, step, end = at, max(64, int(2 * length)), None
        while lo < len(x) and end is None:
            hi = min(len(x), lo + step)
            run = np.cumsum(np.concatenate(([total], x[lo:hi])))[1:]
            n = ticks + np.arange(1, hi - lo + 1)
            hit = (n > 2) & (np.abs(run) >= need[lo:hi] * length)
            k = int(hit.argmax())
            if hit[k]:
                end, total, ticks = lo + k, float(run[k]), float(n[k])
            else:
                total, ticks, lo, step = float(run[-1]), float(n[-1]), hi, 2 * step
        stop = len(x) if end is None else end + 1
        own = price[at:stop]
        first, high, low = (first, max(high, own.max()), min(low, own.min())) if np.isfinite(first) else (own[0], own.max(), own.min())
        volume = float(np.cumsum(np.concatenate(([volume], size[at:stop])))[-1])
        at = stop
        if end is not None:
            ends.append(end)
            closed.append((length, total, ticks, float(first), float(high), float(low), volume))
            length, total, ticks, first, high, low, volume = 0.1 * length + 0.9 * ticks, 0.0, 0.0, np.inf, np.inf, np.inf, 0.0
    return ends, closed, (length, total, ticks, float(first), float(high), float(low), volume)


def imbalance_bars(trades: DataFrame, bar_starting_len: float, keys: Sequence[str] = ("symbol",),
                   first_sign: int = 1, alpha: float = 0.01, daily_reset: bool = False, chunk_rows: int = 1 << 16, warm_rows: int = 1 << 12) -> DataFrame:
    """Imbalance bars.  A bar closes once it has more than 2 ticks and
    abs(Σ signed log dollars) >= (abs(expected) + 0.1·ewm_std)·bar_len; then
    bar_len <- 0.1·bar_len + 0.9·ticks.  The EWM std of the signed log dollars (first value counts as 0) and all
    other inputs are computed beforehand; a tick without log dollars (price 0) adds nothing to the sum.  The bar that is
    open at the end is the last.

    A key is cut into chunks of ``chunk_rows`` positions that run side by side.  Each begins ``warm_rows`` ticks
    early with a fresh bar: a bar that closes with the true one forgets the rest but for a tenth of the difference
    of lengths, so the state is soon the true one to the last bit.  A chunk that did not begin with the state its
    predecessor ended with runs again from that state, with all such chunks at once, until every state
    fits: then all are true, as the first is.  No task holds more than a chunk and its warm rows."""
    keys = list(keys)
    d = cut_lineage(imbalance_thresholds(trades, keys, ewm=True, first_sign=first_sign))
    d = E.ewm(d, keys, list(ORDER), "log_dollars_exchanged", out_std="_ldstd", alpha=alpha)
    gkeys = keys + (["_day"] if daily_reset else [])
    if daily_reset:
        d = d.withColumn("_day", F.to_date("ts"))
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    need = F.abs(value("expected_log_dollars_exchanged")) + 0.1 * value("_ldstd")
    d = d.select(*gkeys, "ts", "seq", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"),
                 value("log_dollars_exchanged").alias("_x"), need.alias("_need"))
    warm = halo_chunks(d, gkeys, list(ORDER), before=min(warm_rows, chunk_rows), chunk_rows=chunk_rows)
    warm = cut_lineage(warm.withColumn(KEY, F.struct(*gkeys, CHUNK)).select(KEY, POS, HALO, "ts", "price", "size", "_x", "_need"))
    ts_type = d.schema["ts"].dataType
    # a row for each bar that closes in the chunk, and one (n null) for its states
    schema = T.StructType([warm.schema[KEY], T.StructField("n", T.LongType()), T.StructField("time", ts_type), T.StructField("close", T.DoubleType()),
                           T.StructField("state", T.ArrayType(T.DoubleType())), T.StructField("entry", T.ArrayType(T.DoubleType())), T.StructField("closed", T.LongType())])
    fresh = (float(bar_starting_len), 0.0, 0.0, np.inf, np.inf, np.inf, 0.0)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        given = table.column("entry")[0].as_py() if "entry" in table.column_names else None
        halo = table.column(HALO).to_numpy()
        cols = [table.column(c).to_numpy() for c in ("price", "size", "_x", "_need")]
        entry = given or _imbalance_chunk(*(c[halo] for c in cols), fresh)[2]
        ends, closed, state = _imbalance_chunk(*(c[~halo] for c in cols), entry)
        own = table.filter(pa.array(~halo))
        # behind a key's last chunk there are warm rows alone
        at = pa.array([*ends, own.num_rows - 1], pa.int64()) if own.num_rows else pa.array([], pa.int64())
        k = len(at)
        return pa.table([own.column(KEY).take(at), pa.array([*range(len(ends)), None][:k], pa.int64()), own.column("ts").take(at), own.column("price").take(at),
                         pa.array([*closed, state][:k], pa.list_(pa.float64())), pa.array([*[None] * len(ends), list(entry)][:k], pa.list_(pa.float64())),
                         pa.array([*[None] * len(ends), len(ends)][:k], pa.int64())], schema.names)

    found = cut_lineage(warm.groupBy(KEY).applyInArrow(run, schema))
    over = W.partitionBy(*[F.col(KEY)[k] for k in gkeys]).orderBy(F.col(KEY)[CHUNK])  # one row per chunk
    while True:
        states = found.where("n is null")
        wrong = states.withColumn("ended", F.lag("state").over(over)).where("ended is not null and ended <> entry").select(F.col(KEY).alias("_again"), "ended")
        wrong = cut_lineage(wrong)
        if wrong.isEmpty():
            break
        rows = warm.where(~F.col(HALO)).join(wrong.withColumnRenamed("ended", "entry"), F.col(KEY) == F.col("_again")).drop("_again")
        again = rows.groupBy(KEY).applyInArrow(run, schema)
        found = cut_lineage(found.join(wrong, F.col(KEY) == F.col("_again"), "left_anti").unionByName(again))
    states = found.where("n is null")
    before = states.select(F.col(KEY).alias("_of"), F.coalesce(F.sum("closed").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.lead("closed").over(over).isNull().alias("_last"))
    bars = found.join(before, F.col(KEY) == F.col("_of")).where("n is not null or (_last and state[2] > 0)")
    part = lambda name: F.col("state")[IMB_STATE.index(name)]
    bars = bars.select(*[F.col(KEY)[k].alias(k) for k in gkeys], (F.col("_before") + F.coalesce("n", "closed")).alias("group"), "time", part("open").alias("open"), "close",
                       part("high").alias("high"), part("low").alias("low"), part("volume").alias("volume"), part("ticks").cast("long").alias("tick_count"))
    return bars.drop("_day") if daily_reset else bars


# --------------------------------------------------------------------------- B15
def dedupe_by_time(bars: DataFrame, keys: Sequence[str] = ("symbol",), time_col: str = "time",
                   order: Sequence[str] = ("bar",)) -> DataFrame:
    """Keep the first bar of each (key, time): a plain aggregation on (key, time), no window."""
    keys = list(keys)
    first = F.struct(*order)
    others = [c for c in bars.columns if c not in keys and c != time_col]
    return (bars.groupBy(*keys, time_col)
                .agg(F.min_by(F.struct(*others), first).alias("_r"))
                .select(*keys, time_col, "_r.*"))
