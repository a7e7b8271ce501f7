"""Triple-barrier labelling and meta-labelling.

``close`` is a series ``(keys..., time, close)`` with unique times per key; events are
``(keys..., t0, ...)``.  Barriers, vertical barriers and prices are found by ``plans.pathindex``; pass ``index`` to
build it once for several of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.plans.pathindex import FAN, PathIndex, blocks, first_touches, locate, path_index
from tessera.plans.sequence import KEY, POS, join_keys, shift, with_pos


# --------------------------------------------------------------------------- J2 / vertical barrier
def vertical_barrier(close: DataFrame, t_events: DataFrame, num_days: int, keys=("symbol",), time_col="time",
                     event_time="t0", value="close", index: PathIndex | None = None) -> DataFrame:
    """t1 = first close time at or after t0 + num_days (forward as-of); null past the end.  ``index`` is that of
    ``close``, if there is one already (``path_index``)."""
    index = index or path_index(close, keys, time_col, value)
    return locate(index, t_events, F.col(event_time) + F.expr(f"INTERVAL {int(num_days)} DAYS"), {"time": "t1"})


# --------------------------------------------------------------------------- L1
def triple_barrier(close: DataFrame, events: DataFrame, pt_sl: Sequence[float], keys=("symbol",),
                   time_col="time", value="close", index: PathIndex | None = None) -> DataFrame:
    """First stop-loss and profit-taking touch on the path [t0, t1] (t1 null: to the last close).
    Path return = (close/close[t0] - 1)·side; sl touch when below -pt_sl[1]·trgt, pt touch when
    above pt_sl[0]·trgt; a zero factor disables that barrier.  events: keys, t0, t1, trgt, side, one for each
    (keys, t0).  An event whose t0 has no close touches nothing.  Events at one t0, as targets of several ticks at that
    time give, share the earliest touch of any of them, a row for each event.

    The first touch at or after t0 is searched by ``path_index``; one behind t1 does not count."""
    keys = list(keys)
    index = index or path_index(close, keys, time_col, value)
    side = F.col("side").cast("double") if "side" in events.columns else F.lit(None).cast("double")
    asked = events.select(*keys, "t0", "t1", "trgt", F.coalesce(side, F.lit(1.0)).alias("_s"))
    # of several targets the smallest is touched first; NaN stands above all numbers and is asked for itself
    asked = asked.groupBy(*keys, "t0", "t1", "_s", F.isnan("trgt").alias("_nan")).agg(F.min("trgt").alias("trgt")).drop("_nan")
    own = locate(index, asked, F.col("t0"), {"pos": "_p", "time": "_pt", "value": "_p0"})
    asks = own.where((F.col("_pt") == F.col("t0")) & F.col("_p0").isNotNull()).drop("_pt")
    ret = lambda px: (F.try_divide(px, F.col("_p0")) - 1) * F.col("_s")
    pt_w, sl_w = float(pt_sl[0]), float(pt_sl[1])
    # the return rises with the price, or falls with it
    best = lambda lo, hi: ret(F.when(F.col("_rises"), hi).otherwise(lo))
    worst = lambda lo, hi: ret(F.when(F.col("_rises"), lo).otherwise(hi))
    asks = asks.withColumns({"_rises": F.col("_s") * F.col("_p0") >= 0, "_pt": F.lit(pt_w) * F.col("trgt"), "_sl": -F.lit(sl_w) * F.col("trgt")})
    over = lambda lo, hi: (best(lo, hi) > F.col("_pt")) if pt_w > 0 else F.lit(False)
    under = lambda lo, hi: (worst(lo, hi) < F.col("_sl")) if sl_w > 0 else F.lit(False)
    found = first_touches(index, asks, "_p", over, under, ("pt", "sl"))
    in_time = lambda c: F.min(F.when(F.col("t1").isNull() | (F.col(c) <= F.col("t1")), F.col(c))).alias(c)
    return join_keys(events, found.groupBy(*keys, "t0").agg(in_time("pt"), in_time("sl")), [*keys, "t0"], "left")


# --------------------------------------------------------------------------- L2
def get_events(close: DataFrame, t_events: DataFrame, pt_sl: Sequence[float], trgt: DataFrame, min_ret: float,
               t1: DataFrame | None = None, side: DataFrame | None = None, keys=("symbol",), time_col="time",
               value="close", index: PathIndex | None = None) -> DataFrame:
    """Events with trgt > min_ret at the seed times, their vertical barrier t1 (optional) and side
    (optional), and t1 replaced by the earliest of (t1, sl touch, pt touch).  Without side both
    barrier widths are pt_sl[0].  trgt: keys, time, trgt.  t1: keys, t0, t1.  side: keys, t0, side."""
    keys = list(keys)
    ev = join_keys(t_events.select(*keys, F.col("t0")), trgt.select(*keys, F.col(time_col).alias("t0"), "trgt"), [*keys, "t0"])
    ev = ev.where(F.col("trgt") > min_ret)
    if t1 is not None:
        ev = join_keys(ev, t1.select(*keys, "t0", "t1"), [*keys, "t0"], "left")
    else:
        ev = ev.withColumn("t1", F.lit(None).cast(close.schema[time_col].dataType))
    if side is None:
        ev = ev.withColumn("side", F.lit(1.0))
        widths = [pt_sl[0], pt_sl[0]]
    else:
        ev = join_keys(ev, side.select(*keys, "t0", "side"), [*keys, "t0"], "left")
        widths = list(pt_sl[:2])
    touched = triple_barrier(close, ev, widths, keys, time_col, value, index)
    out = touched.withColumn("t1", F.least("t1", "sl", "pt")).drop("sl", "pt")
    return out if side is not None else out.drop("side")


# --------------------------------------------------------------------------- L3
def get_bins(close: DataFrame, events: DataFrame, t1: DataFrame | None = None, keys=("symbol",),
             time_col="time", value="close", index: PathIndex | None = None) -> DataFrame:
    """ret = close at t1 / close at t0 - 1 (first close at or after each time), times side when
    given; bin = sign(ret); with side, ret <= 0 gives 0; without side, bin is 0 whenever the
    event's t1 equals any vertical-barrier time of the key."""
    keys = list(keys)
    ev = events.where(F.col("t1").isNotNull())
    index = index or path_index(close, keys, time_col, value)
    a = locate(index, locate(index, ev, F.col("t0"), {"value": "_p0"}), F.col("t1"), {"value": "_p1"})
    ret = F.try_divide(F.col("_p1"), F.col("_p0")) - 1
    has_side = "side" in events.columns
    if has_side:
        ret = ret * F.col("side")
    a = a.withColumn("ret", ret).withColumn("bin", F.signum("ret").cast("int"))
    if has_side:
        a = a.withColumn("bin", F.when(F.col("ret") <= 0, F.lit(0)).otherwise(F.col("bin")))
    elif t1 is not None:
        vb = t1.select(*keys, F.col("t1").alias("_vt")).where(F.col("_vt").isNotNull()).distinct()
        vb = vb.withColumnRenamed("_vt", "t1").withColumn("_v", F.lit(True))
        a = join_keys(a, vb, [*keys, "t1"], "left").withColumn(
            "bin", F.when(F.col("_v"), F.lit(0)).otherwise(F.col("bin"))).drop("_v")
    return a.select(*keys, "t0", "ret", "bin")


# --------------------------------------------------------------------------- L4
def drop_rare_labels(labels: DataFrame, min_pct: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Drop the rarest label of each key while its share is <= min_pct and at least 3 labels remain (ties go
    to the smallest label).  The counts (a row per key and label) decide; no round trips."""
    keys = list(keys)
    counts = labels.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"))
    # in the order of their dropping, a label goes if it and all rarer ones do: its share of what is left then
    listed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "bin"))).alias("_l"))  # the labels of a key
    step = lambda acc, x: F.struct(
        (acc["go"] & (acc["left"] >= 3) & (x["_n"] <= F.lit(min_pct) * acc["total"])).alias("go"),
        F.when(acc["go"] & (acc["left"] >= 3) & (x["_n"] <= F.lit(min_pct) * acc["total"]), acc["left"] - 1).otherwise(acc["left"]).alias("left"),
        (acc["total"] - x["_n"]).alias("total"))
    size = F.aggregate("_l", F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    start = F.struct(F.lit(True).alias("go"), F.size("_l").alias("left"), size.alias("total"))
    kept = listed.withColumn("_k", F.aggregate("_l", start, step, lambda a: a["left"]))
    stay = kept.select(*keys, F.explode(F.slice("_l", F.size("_l") - F.col("_k") + 1, F.col("_k"))).alias("_x")).select(*keys, F.col("_x.bin").alias("bin"))
    return join_keys(labels, stay, [*keys, "bin"], "left_semi")


# --------------------------------------------------------------------------- L5
def meta_features(vol: DataFrame, autocorr: DataFrame, events: DataFrame, keys=("symbol",),
                  time_col="time") -> DataFrame:
    """Inner-aligned feature table (vol, autocorr, side) on the event times, nulls dropped,
    one row per (key, time) (the first by seq when duplicated)."""
    keys = list(keys)
    v = vol.select(*keys, F.col(time_col).alias("t0"), "vol")
    a = autocorr.select(*keys, F.col(time_col).alias("t0"), "autocorr")
    s = events.select(*keys, "t0", "side")
    # the first by seq where the tables have one, else by value: always the same row
    tie = [c for c in ("seq",) if c in vol.columns]
    if tie:
        v = vol.select(*keys, F.col(time_col).alias("t0"), "vol", F.col("seq").alias("_tie"))
    else:
        v = v.withColumn("_tie", F.lit(0))
    x = join_keys(join_keys(v, a, [*keys, "t0"]), s, [*keys, "t0"]).dropna(subset=["vol", "autocorr", "side"])
    first = F.min(F.struct("_tie", "vol", "autocorr", "side")).alias("_f")
    return x.groupBy(*keys, "t0").agg(first).select(*keys, "t0", "_f.vol", "_f.autocorr", "_f.side")


# --------------------------------------------------------------------------- L6
def primary_scores(events_with_side: DataFrame, bins: DataFrame, keys=("symbol",)) -> DataFrame:
    """Accuracy, precision and recall of the primary model: predicted = (side+1)/2 against the
    meta-label bin in {0, 1}."""
    keys = list(keys)
    d = join_keys(events_with_side.select(*keys, "t0", "side"), bins.select(*keys, "t0", "bin"), [*keys, "t0"])
    pred = ((F.col("side") + 1) / 2).cast("int")
    y = F.col("bin")
    tp = F.sum(((pred == 1) & (y == 1)).cast("double"))
    return d.groupBy(*keys).agg(
        F.avg((pred == y).cast("double")).alias("accuracy"),
        F.try_divide(tp, F.sum((pred == 1).cast("double"))).alias("precision"),
        F.try_divide(tp, F.sum((y == 1).cast("double"))).alias("recall"))


# --------------------------------------------------------------------------- L7
def barrier_mesh(close: DataFrame, starts: DataFrame, r_pt: Sequence[float], r_sl: Sequence[float],
                 max_hp: int = 100, keys=("symbol",), time_col="time", value="close", seq: str = "seq", whole_paths: bool = True) -> DataFrame:
    """Sharpe ratio of exit gains for each (profit-take, stop-loss) rule on recorded price paths.
    From each start, gain cP_h = p_{t0+h} - p_{t0}; the exit is the first h with cP_h > pt,
    cP_h < -sl or h > max_hp.  Thresholds are multiples of the key's std of one-step price changes.
    A path that ends before any exit has no gain to count: with ``whole_paths`` (the reference's simulated paths
    are all whole) starts with less than max_hp + 1 steps ahead are left out; without, a start is left out only
    if its recorded path meets no barrier, and ``n`` tells how many counted.  The mesh is a constant array.  A start
    reads the blocks of prices that its path covers, ``max_hp / FAN + 2`` rows, and holds ``max_hp + 1`` gains."""
    keys = list(keys)
    c = with_pos(close.select(*keys, time_col, seq, value), keys, [time_col, seq])
    st = join_keys(starts.select(*keys, F.col(time_col)), c, [*keys, time_col]).select(*keys, F.col(POS).alias("_p0"), F.col(value).alias("_v0"))
    prices = blocks(c.select(*keys, F.col(POS).alias("_i"), F.col(value).cast("double").alias("_item")), keys, FAN)
    covered = F.sequence(F.floor((F.col("_p0") + 1) / F.lit(FAN)), F.floor((F.col("_p0") + F.lit(max_hp + 1)) / F.lit(FAN)))
    read = st.withColumn("_b", F.explode(covered)).withColumn(KEY, F.struct(*keys, "_b")).join(prices, KEY)
    path = read.groupBy(*keys, "_p0", "_v0").agg(F.array_sort(F.collect_list(F.struct("_b", "_items"))).alias("_l"))
    # the start's own block may lie before the path, so a start at the end of a key reads nothing and goes
    skip = (F.col("_p0") + 1 - F.col("_l")[0]["_b"] * FAN).cast("int")
    ahead = F.slice(F.flatten(F.transform("_l", lambda x: x["_items"])), skip + 1, max_hp + 1)
    path = path.withColumn("_ahead", ahead).withColumn("_n", F.size("_ahead")).where(F.col("_n") == max_hp + 1 if whole_paths else F.col("_n") > 0)
    steps = F.transform("_ahead", lambda x, i: F.struct((i + 1).cast("long").alias("h"), (x - F.col("_v0")).alias("cp")))
    path = path.select(*keys, "_p0", steps.alias("_path"))
    diffs = shift(c, keys, [time_col, seq], {value: "_prev"}, 1)
    sig = diffs.groupBy(*keys).agg(F.stddev_samp(F.col(value) - F.col("_prev")).alias("_sig"))
    mesh = F.array(*[F.struct(F.lit(float(a)).alias("pt"), F.lit(float(b)).alias("sl")) for a in r_pt for b in r_sl])
    m = join_keys(path, sig, keys).withColumn("_m", F.explode(mesh)).select("*", "_m.*").drop("_m")  # rules per start
    up = F.col("pt") * F.col("_sig")
    dn = F.col("sl") * F.col("_sig")
    hit = F.filter("_path", lambda s: (s["cp"] > up) | (s["cp"] < -dn) | (s["h"] > F.lit(max_hp)))
    m = m.withColumn("_exit", F.get(hit, F.lit(0))["cp"]).where("_exit is not null")
    return m.groupBy(*keys, "pt", "sl").agg(F.avg("_exit").alias("mean"), F.stddev_pop("_exit").alias("std"),
                                            F.count(F.lit(1)).alias("n")).withColumn(
        "sharpe", F.try_divide("mean", "std"))

