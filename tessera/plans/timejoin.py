"""Joins in time (J1-J4) without Cartesian products or whole-key windows.

* as-of joins (J1 backward, J2 forward) are a union of query and data rows followed by a
  two-level forward / backward fill (hour blocks + per-block carry);
* interval joins (J3) explode each interval over the hour buckets it covers and equi-join on
  ``(keys, hour)`` before the exact ``between`` filter;
* overlap counting (J4) is a sweep: +1 at each start, -1 after each end, running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.plans.sequence import cumulative, fill, join_keys


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str | Column, right_time: str,
         cols: dict[str, str], direction: str = "backward", inclusive: bool = True,
         right_order: Sequence[str] = ()) -> DataFrame:
    """For each left row, values of the last right row with time <= (or <) ``left_time``
    (backward) or the first one with time >= (or >) it (forward).  ``left_time`` may be an
    expression (e.g. ``ts - interval 1 day``).  ``right_order`` breaks ties among right rows."""
    keys = list(keys)
    lt = F.col(left_time) if isinstance(left_time, str) else left_time
    # the left rows ride through the union as a payload struct: no row ids, no join back
    payload = F.struct(*[F.col(c) for c in left.columns])
    data_first = inclusive if direction == "backward" else not inclusive
    tq, td = (1, 0) if data_first else (0, 1)
    rsel = right.select(*keys, F.col(right_time).alias("_t"), *[F.col(s).alias(f"_v_{d}") for s, d in cols.items()],
                        *[F.col(c).cast("long").alias(f"_r{i}") for i, c in enumerate(right_order)],
                        F.lit(td).alias("_tie"))
    q = left.select(*keys, lt.alias("_t"),
                    *[F.lit(None).cast(rsel.schema[f"_v_{d}"].dataType).alias(f"_v_{d}") for d in cols.values()],
                    *[F.lit(None).cast("long").alias(f"_r{i}") for i, _ in enumerate(right_order)],
                    F.lit(tq).alias("_tie"), payload.alias("_p"))
    r = rsel.withColumn("_p", F.lit(None).cast(q.schema["_p"].dataType))
    u = q.unionByName(r)
    order = ["_t", "_tie", *[f"_r{i}" for i in range(len(right_order))]]
    u = fill(u, keys, order, {f"_v_{d}": d for d in cols.values()},
             "forward" if direction == "backward" else "backward")
    return u.where(F.col("_p").isNotNull()).select("_p.*", *cols.values())


def interval_join(intervals: DataFrame, points: DataFrame, keys: Sequence[str], start: str, end: str,
                  point_time: str, open_end: Column | None = None) -> DataFrame:
    """All (interval, point) pairs with start <= point_time <= end, both ends included.
    Intervals are exploded over the hours they cover and equi-joined with the points on
    ``(keys, hour)``: but for the two end hours, every pair formed is one asked for.  A null end is replaced by
    ``open_end`` (e.g. the key's last time)."""
    keys = list(keys)
    e = F.coalesce(F.col(end), open_end) if open_end is not None else F.col(end)
    iv = intervals.withColumn("_end", e).where(F.col("_end").isNotNull())
    hour = lambda c: F.date_trunc("hour", c).cast(points.schema[point_time].dataType)
    iv = iv.withColumn("_hour", F.explode(F.sequence(hour(start), hour("_end"), F.expr("INTERVAL 1 HOUR"))))
    pt = points.withColumn("_hour", hour(point_time))
    j = join_keys(iv, pt, [*keys, "_hour"])
    return j.where((F.col(point_time) >= F.col(start)) & (F.col(point_time) <= F.col("_end"))).drop("_hour", "_end")


def overlap_counts(intervals: DataFrame, keys: Sequence[str], start: str, end: str, times: DataFrame,
                   time_col: str, value: str | None = None, end_inclusive: bool = True) -> DataFrame:
    """Sweep: for each row of ``times`` the number of intervals (and Σ``value``) alive at that time.
    Alive means start <= t <= end (``end_inclusive``) or start <= t < end; a null end never closes.
    Values are accumulated as DECIMAL(38, 18): a running sum of +v / -v over a long series must not
    drift, and an exact sum makes the result independent of the order of additions."""
    keys = list(keys)
    of = lambda c: [c.cast("decimal(38,18)").alias("_dv")] if value else []
    plus = intervals.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_k"), F.lit(1).alias("_dc"), *of(F.col(value or start)))
    # an interval ending at e leaves after every time <= e (inclusive) or before e (exclusive)
    minus = intervals.where(F.col(end).isNotNull()).select(
        *keys, F.col(end).alias("_t"), F.lit(2 if end_inclusive else -1).alias("_k"),
        F.lit(-1).alias("_dc"), *of(-F.col(value).cast("decimal(38,18)") if value else F.lit(0)))
    probes = times.select(*keys, F.col(time_col).alias("_t"), F.lit(1).alias("_k"), F.lit(0).alias("_dc"), *of(F.lit(0)))
    u = plus.unionByName(minus).unionByName(probes)
    sums = {"alive": ("sum", "_dc"), **({"alive_sum": ("sum", "_dv")} if value else {})}
    u = cumulative(u, keys, ["_t", "_k"], sums)
    # without values each interval counts 1, and the sum is the count
    return u.where(F.col("_k") == 1).select(*keys, F.col("_t").alias(time_col), "alive",
                                             F.col("alive_sum" if value else "alive").cast("double").alias("alive_sum")).distinct()
