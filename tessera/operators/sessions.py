"""Sessions and time grouping (P1-P7), all plain column expressions and hash aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.plans.sequence import join_keys

NY = "America/New_York"


def ny_wall(ts: str | Column) -> Column:
    """UTC wall clock (TIMESTAMP_NTZ or TIMESTAMP) -> New York wall clock as TIMESTAMP_NTZ,
    independent of the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.convert_timezone(F.lit("UTC"), F.lit(NY), c.cast("timestamp_ntz"))


def micros_of_day(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    c = c.cast("timestamp_ntz")
    secs = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return secs.cast("long") * F.lit(1_000_000) + F.date_format(c, "SSSSSS").cast("long")


def wall_micros(ts: str | Column) -> Column:
    """Microseconds from 1970-01-01 00:00 on the same clock, independent of the session time zone."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return F.datediff(F.to_date(c), F.lit(date(1970, 1, 1))).cast("long") * F.lit(86_400_000_000) + micros_of_day(c)


def _hm_micros(hm: tuple[int, int]) -> int:
    return (hm[0] * 3600 + hm[1] * 60) * 1_000_000


# --------------------------------------------------------------------------- P1
def regular_session(df: DataFrame, wall_col: str, start=(9, 30), end=(16, 0)) -> DataFrame:
    """Keep rows whose wall-clock time is within [start, end], both ends included."""
    t = micros_of_day(wall_col)
    return df.where(t.between(_hm_micros(start), _hm_micros(end)))


# --------------------------------------------------------------------------- P2
def time_barriers(step: timedelta, start=(9, 30), stop=(16, 0)) -> list[int]:
    """Barrier offsets (microseconds of day): the session in whole steps, of which it must hold two at least."""
    first, width = _hm_micros(start), step // timedelta(microseconds=1)
    steps, rest = divmod(_hm_micros(stop) - first, width)
    if rest or steps < 2:
        raise ValueError(f"a session from {start} to {stop} does not split into two or more steps of {step}")
    return [first + k * width for k in range(steps + 1)]


# --------------------------------------------------------------------------- P3
def split_intervals(df: DataFrame, wall_col: str, step: timedelta, start=(9, 30), stop=(16, 0),
                    closed: str = "both", out: str = "interval_id") -> DataFrame:
    """Intraday interval id of each row.  Intervals are [b_i, b_{i+1}] closed on both ends, so a
    row exactly on an inner barrier is emitted twice (once per interval); ``closed='left'`` gives
    half-open intervals instead.  Pure arithmetic plus ``explode``: no join, no shuffle."""
    bars = time_barriers(step, start, stop)
    n = len(bars) - 1
    s, st = bars[0], bars[1] - bars[0]
    t = micros_of_day(wall_col)
    rel = t - F.lit(s)
    k = F.floor(rel / F.lit(st)).cast("int")
    on_barrier = (rel % F.lit(st)) == 0
    cands = F.array(k, F.when(on_barrier, k - 1)) if closed == "both" else F.array(k)
    d = df.where(t.between(bars[0], bars[-1]))
    d = d.withColumn(out, F.explode(cands)).where(F.col(out).isNotNull() & F.col(out).between(0, n - 1))
    return d


# --------------------------------------------------------------------------- P4
def by_date(df: DataFrame, wall_col: str, keys: Sequence[str] = ("symbol",)):
    return df.groupBy(*keys, F.to_date(wall_col).alias("date"))


# --------------------------------------------------------------------------- P5
def interval_close_std(bars: DataFrame, minutes: int, keys: Sequence[str] = ("symbol",),
                       time_col: str = "time") -> DataFrame:
    """Sample std of ``close`` per (key, day, intraday interval), attached to every bar of that
    interval (bars on an inner barrier appear in both intervals)."""
    keys = list(keys)
    d = split_intervals(bars.withColumn("_wall", ny_wall(time_col)), "_wall", timedelta(minutes=minutes))
    d = d.withColumn("date", F.to_date("_wall"))
    w = W.partitionBy(*keys, "date", "interval_id")
    return d.withColumn("std", F.stddev_samp("close").over(w)).drop("_wall")


# --------------------------------------------------------------------------- P6
def weekly_bar_counts(bars: DataFrame, keys: Sequence[str] = ("symbol",), time_col: str = "time") -> DataFrame:
    """Bars per calendar week (weeks end on Sunday, empty weeks between the first and last one
    count 0), min-max scaled to [0, 1] per key."""
    keys = list(keys)
    wk = F.date_add(F.date_trunc("week", F.col(time_col)).cast("date"), 6)
    counts = bars.groupBy(*keys, wk.alias("week")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy(*keys).agg(F.min("week").alias("_a"), F.max("week").alias("_b"))
    weeks = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 7 days"))).alias("week"))
    d = join_keys(weeks, counts, [*keys, "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy(*keys)  # one row per key and week: small
    lo, hi = F.min("n").over(w), F.max("n").over(w)
    return d.withColumn("scaled", F.when(hi > lo, (F.col("n") - lo) / (hi - lo)).otherwise(F.lit(0.0)))


# --------------------------------------------------------------------------- P7
def monthly_return_std(returns: DataFrame, keys: Sequence[str] = ("symbol",), time_col: str = "time",
                       ret_col: str = "ret") -> DataFrame:
    """Sample std of returns per month, then the sample std of those monthly values per key."""
    keys = list(keys)
    m = returns.groupBy(*keys, F.date_trunc("month", F.col(time_col)).alias("month")).agg(
        F.stddev_samp(ret_col).alias("month_std"))
    return m.groupBy(*keys).agg(F.stddev_samp("month_std").alias("std_of_monthly_std"),
                                F.count(F.lit(1)).alias("months"))
