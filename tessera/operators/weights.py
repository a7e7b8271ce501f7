"""Sample weights (W1-W9): concurrency, uniqueness, return attribution, time decay and the
sequential bootstrap.

Concurrency is a sweep (+1 at t0, -1 after t1) and per-event averages over [t0, t1] are
differences of prefix sums looked up by equi-joins, so no event is ever expanded over its bars
except for the indicator matrix written as pairs (W3).
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tessera.plans.pathindex import blocks
from tessera.plans.sequence import KEY, POS, cumulative, join_keys, shift, with_pos
from tessera.plans.timejoin import overlap_counts
from tessera.session import cut_lineage


def _filled(events: DataFrame, close: DataFrame, keys, time_col) -> DataFrame:
    last = close.groupBy(*keys).agg(F.max(time_col).alias("_last"))  # one row per key
    return join_keys(events, last, keys, "left").withColumn("t1", F.coalesce("t1", "_last")).drop("_last")


# --------------------------------------------------------------------------- W1
def num_concurrent(close: DataFrame, events: DataFrame, keys=("symbol",), time_col="time") -> DataFrame:
    """Number of events alive at each close time (t0 <= t <= t1; open t1 runs to the last
    close), for close times between the first t0 and the last t1."""
    keys = list(keys)
    # the events feed three branches of the sweep: materialise them once
    ev = cut_lineage(_filled(events, close, keys, time_col))
    span = ev.groupBy(*keys).agg(F.min("t0").alias("_a"), F.max("t1").alias("_b"))
    probes = join_keys(close.select(*keys, time_col), span, keys).where(
        F.col(time_col).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    c = overlap_counts(ev, keys, "t0", "t1", probes, time_col, end_inclusive=True)
    return cut_lineage(c.select(*keys, time_col, F.col("alive").cast("long").alias("c")))


def _prefix_lookup(series: DataFrame, events: DataFrame, keys, time_col, value: str, seq=None):
    """Σ value and count over close times in [t0, t1] per event via prefix sums."""
    order = [time_col] + ([seq] if seq else [])
    # the prefix table is looked up twice (at t0 and at t1): materialise it once
    pre = cut_lineage(cumulative(series.select(*keys, time_col, value), keys, order,
                                 {"_cs": ("sum", value), "_cn": ("count", value)}))
    # value strictly before t0 = prefix at t0 minus the row at t0
    s0 = pre.select(*keys, F.col(time_col).alias("t0"),
                    (F.coalesce("_cs", F.lit(0.0)) - F.coalesce(F.col(value), F.lit(0.0))).alias("_s0"),
                    (F.col("_cn") - F.when(F.col(value).isNotNull(), 1).otherwise(0)).alias("_n0"))
    s1 = pre.select(*keys, F.col(time_col).alias("t1"), F.col("_cs").alias("_s1"), F.col("_cn").alias("_n1"))
    return (join_keys(join_keys(events, s0, [*keys, "t0"], "left"), s1, [*keys, "t1"], "left")
                  .withColumn("_sum", F.col("_s1") - F.col("_s0")).withColumn("_cnt", F.col("_n1") - F.col("_n0"))
                  .drop("_s0", "_s1", "_n0", "_n1"))


# --------------------------------------------------------------------------- W2
def avg_uniqueness(close: DataFrame, events: DataFrame, keys=("symbol",), time_col="time") -> DataFrame:
    """Average of 1/c over the close times of each event's [t0, t1]."""
    keys = list(keys)
    ev = _filled(events, close, keys, time_col)
    c = num_concurrent(close, events, keys, time_col).withColumn("_u", F.when(F.col("c") > 0, 1.0 / F.col("c")))
    d = _prefix_lookup(c, ev, keys, time_col, "_u")
    return d.withColumn("tw", F.col("_sum") / F.col("_cnt")).drop("_sum", "_cnt")


# --------------------------------------------------------------------------- W3 / W4
RUN = ("_first", "_last", "_first_time", "_last_time")


def indicator_matrix(close: DataFrame, events: DataFrame, keys=("symbol",), time_col="time", runs: bool = False) -> DataFrame:
    """Sparse indicator matrix: one row (keys, t0, time) per close time inside each event.

    The ones of an event are a run of consecutive close times.  With ``runs`` the matrix is written so: a row (keys, t0,
    _first, _last, _first_time, _last_time) per event, the places of its first and last close among the key's closes,
    and those of their times among its times.  W4 and W6 read both forms."""
    keys = list(keys)
    ev = cut_lineage(_filled(events, close, keys, time_col).select(*keys, "t0", "t1").where(F.col("t0") <= F.col("t1")))
    r = _event_runs(close, ev, keys, time_col)
    if runs:
        return r
    # blocks of closes: an event reads those that its run covers, and no close but two blocks' that is not its own
    r = cut_lineage(r)
    placed = with_pos(close.select(*keys, time_col).where(F.col(time_col).isNotNull()), keys, [time_col])
    bars = blocks(placed.select(*keys, F.col(POS).alias("_i"), F.col(time_col).alias("_item")), keys, MATRIX_BLOCK)
    at = lambda c: F.floor(F.col(c) / F.lit(MATRIX_BLOCK))
    # a task reads few bytes and writes many pairs: the number of tasks follows the pairs
    tasks = _pair_tasks(r.sparkSession, r.agg(F.sum(F.col("_last") - F.col("_first") + 1)).first()[0] or 0)
    r = r.withColumn("_b", F.explode(F.sequence(at("_first"), at("_last")))).withColumn(KEY, F.struct(*keys, "_b"))
    low = F.greatest(F.col("_first") - F.col("_b") * MATRIX_BLOCK, F.lit(0)).cast("int")
    high = F.least(F.col("_last") - F.col("_b") * MATRIX_BLOCK, F.lit(MATRIX_BLOCK - 1)).cast("int")
    asked = r.select(*keys, "t0", KEY, low.alias("_low"), high.alias("_high")).repartition(tasks, KEY)
    # merged: the few bytes of the runs' table say nothing of the rows it is exploded to, and those are not to be broadcast
    own = asked.hint("merge").join(bars.repartition(tasks, KEY), KEY)
    return own.select(*keys, "t0", F.explode(F.slice("_items", F.col("_low") + 1, F.col("_high") - F.col("_low") + 1)).alias(time_col))


MATRIX_BLOCK = 1024  # closes in a block


def _pair_tasks(spark: SparkSession, pairs: int) -> int:
    """Tasks for ``pairs`` rows: one for 1 million, up to the session's number; more than that for 16 million each."""
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(-(-pairs // 1_000_000), max(session, -(-pairs // 16_000_000))))


def _event_runs(close: DataFrame, ev: DataFrame, keys, time_col) -> DataFrame:
    """Runs of the intervals [t0, t1]: a sweep counts the closes and the times before each start and up to each end."""
    none = F.lit(None).cast(ev.schema["t0"].dataType)
    zero = F.lit(0).cast("long")
    bars = close.where(F.col(time_col).isNotNull()).groupBy(*keys, time_col).agg(F.count(F.lit(1)).alias("_n"))
    u = bars.select(*keys, F.col(time_col).alias("_t"), F.lit(1).alias("_k"), "_n", F.lit(1).cast("long").alias("_d"), none.alias("t0"), none.alias("t1"))
    for t, k in (("t0", 0), ("t1", 2)):
        u = u.unionByName(ev.select(*keys, F.col(t).alias("_t"), F.lit(k).alias("_k"), zero.alias("_n"), zero.alias("_d"), "t0", "t1"))
    swept = cumulative(u, keys, ["_t", "_k"], {"_rows": ("sum", "_n"), "_times": ("sum", "_d")}).where("_k <> 1")
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    r = swept.groupBy(*keys, "t0", "t1").agg(at(0, "_rows").alias("_first"), (at(2, "_rows") - 1).alias("_last"), at(0, "_times").alias("_first_time"),
                                             (at(2, "_times") - 1).alias("_last_time"), F.count_if(F.col("_k") == 0).cast("int").alias("_n"))
    r = r.where(F.col("_first") <= F.col("_last"))
    # an event that stands there twice has two rows
    return r.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*keys, "t0", *RUN)


def avg_uniqueness_from_indicator(ind: DataFrame, keys=("symbol",), time_col="time") -> DataFrame:
    """Average over each event's ones of 1 / the column's sum.  In runs the sums change only where a run begins or has
    ended: prefix sums over these places stand for the columns between them."""
    keys = list(keys)
    if not set(RUN) <= set(ind.columns):
        c = ind.groupBy(*keys, time_col).agg(F.count(F.lit(1)).alias("_c"))
        return (join_keys(ind, c, [*keys, time_col]).groupBy(*keys, "t0")
                   .agg(F.avg(1.0 / F.col("_c")).alias("avg_uniqueness")))
    ind = cut_lineage(ind.select(*keys, "t0", F.col("_first_time").alias("_a"), (F.col("_last_time") + 1).alias("_b"), (F.col("_last") - F.col("_first") + 1).alias("_n")))
    marks = ind.select(*keys, F.explode(F.array(F.struct(F.col("_a").alias("_p"), F.lit(1).alias("_d")), F.struct(F.col("_b").alias("_p"), F.lit(-1).alias("_d")))).alias("_m"))
    marks = marks.groupBy(*keys, F.col("_m._p").alias("_p")).agg(F.sum("_m._d").alias("_d"))
    c = shift(cumulative(marks, keys, ["_p"], {"_c": ("sum", "_d")}), keys, ["_p"], {"_p": "_p0", "_c": "_c0"}, 1)
    c = c.withColumn("_u", F.when(F.col("_c0") > 0, (F.col("_p") - F.col("_p0")) / F.col("_c0")).otherwise(F.lit(0.0)))
    before = cut_lineage(cumulative(c.select(*keys, "_p", "_u"), keys, ["_p"], {"_s": ("sum", "_u")}).drop("_u"))
    side = lambda p, s: before.select(*keys, F.col("_p").alias(p), F.col("_s").alias(s))
    d = join_keys(join_keys(ind, side("_a", "_s0"), [*keys, "_a"]), side("_b", "_s1"), [*keys, "_b"])
    return d.groupBy(*keys, "t0").agg((F.sum(F.col("_s1") - F.col("_s0")) / F.sum("_n")).alias("avg_uniqueness"))


# --------------------------------------------------------------------------- W5
def return_weights(close: DataFrame, events: DataFrame, keys=("symbol",), time_col="time", value="close",
                   seq="seq") -> DataFrame:
    """abs(Σ log-return / c) over each event's [t0, t1]."""
    keys = list(keys)
    ev = _filled(events, close, keys, time_col)
    lr = shift(close.select(*keys, time_col, seq, value), keys, [time_col, seq], {value: "_prev"}, 1)
    lr = lr.withColumn("_r", F.ln(F.try_divide(value, "_prev")))  # a price of 0 has no log return
    c = num_concurrent(close, events, keys, time_col)
    x = join_keys(lr, c, [*keys, time_col]).withColumn("_rc", F.when(F.col("c") > 0, F.col("_r") / F.col("c"))).select(*keys, time_col, "_rc")
    d = _prefix_lookup(x, ev, keys, time_col, "_rc")
    return d.withColumn("w", F.abs("_sum")).drop("_sum", "_cnt")


# --------------------------------------------------------------------------- W8
def time_decay(tw: DataFrame, clf_last_w: float = 1.0, keys=("symbol",), time_col="t0", value="tw") -> DataFrame:
    """Piecewise-linear decay over cumulative uniqueness: newest weight 1, oldest clf_last_w;
    a negative clf_last_w zeroes the oldest part."""
    keys = list(keys)
    d = cumulative(tw, keys, [time_col], {"_cum": ("sum", value)})
    tot = tw.groupBy(*keys).agg(F.sum(value).alias("_tot"))
    d = join_keys(d, tot, keys)
    if clf_last_w >= 0:
        slope = (1.0 - clf_last_w) / F.col("_tot")
    else:
        slope = 1.0 / ((clf_last_w + 1) * F.col("_tot"))
    const = 1.0 - slope * F.col("_tot")
    return d.withColumn("decay", F.greatest(F.lit(0.0), const + slope * F.col("_cum"))).drop("_cum", "_tot")


# --------------------------------------------------------------------------- W6 / W7
def _pair_runs(ind: DataFrame, keys, time_col) -> DataFrame:
    """(keys, t0, _first, _last): the ones of a matrix of pairs as runs of consecutive close times; an event may have several."""
    pairs = cut_lineage(ind.select(*keys, "t0", time_col).distinct())
    placed = join_keys(pairs, with_pos(pairs.select(*keys, time_col).distinct(), keys, [time_col]), [*keys, time_col])
    island = F.col(POS) - F.row_number().over(Window.partitionBy(*keys, "t0").orderBy(POS))
    return placed.withColumn("_i", island).groupBy(*keys, "t0", "_i").agg(F.min(POS).alias("_first"), F.max(POS).alias("_last")).drop("_i")


class _Draws:
    """Events of one key as runs [first, last] of bars, drawn one after the other in proportion to their average uniqueness
    among the events drawn.

    Bars between two neighbouring ends of runs are one segment: they always have the same number of drawn events.  A draw
    changes the uniqueness of the events that overlap it and of no other.  Runs stand in classes of length, by their
    starts, so that those which may overlap are one slice of each class; sums of blocks of events find a draw."""

    CLASS, BLOCK = 3, 10  # powers of two: lengths of a class, events of a block

    def __init__(self, owner: np.ndarray, first: np.ndarray, last: np.ndarray, n: int):
        ends = np.unique(np.concatenate([first, last + 1]))
        self.width = np.diff(ends).astype(np.float64)
        self.n, self.single = n, len(owner) == n
        a, b = np.searchsorted(ends, first), np.searchsorted(ends, last + 1)
        order = np.lexsort((a, owner))
        self.owner, self.a, self.b = owner[order], a[order], b[order]
        self.of = np.searchsorted(self.owner, np.arange(n + 1))  # an event's runs
        self.length = np.bincount(owner, weights=(last - first + 1).astype(np.float64), minlength=n)
        level = np.log2(np.maximum(self.b - self.a, 1)).astype(int) // self.CLASS
        self.classes = []
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            at = at[np.argsort(self.a[at], kind="stable")]
            self.classes.append((1 << self.CLASS * (int(k) + 1), self.a[at], self.b[at], self.owner[at]))

    def sequential(self, length: int, rng) -> np.ndarray:
        u, cov = np.ones(self.n), np.ones(len(self.width))  # cov: drawn events of a segment, and the one to come
        sums = np.add.reduceat(u, np.arange(0, self.n, 1 << self.BLOCK))
        drawn = np.empty(length, dtype=np.int64)
        for step in range(length):
            cdf = np.cumsum(sums)
            x = rng.random() * cdf[-1]
            k = min(int(np.searchsorted(cdf, x, side="right")), len(cdf) - 1)
            inside = np.cumsum(u[k << self.BLOCK:(k + 1) << self.BLOCK])
            i = (k << self.BLOCK) + min(int(np.searchsorted(inside, x - (cdf[k - 1] if k else 0.0), side="right")), len(inside) - 1)
            drawn[step] = i
            for run in range(self.of[i], self.of[i + 1]):
                a, b = int(self.a[run]), int(self.b[run])
                c = cov[a:b]
                change = np.zeros(b - a + 1)
                np.cumsum(self.width[a:b] * (1.0 / (c + 1.0) - 1.0 / c), out=change[1:])
                c += 1.0
                for longest, starts, stops, owners in self.classes:
                    lo, hi = np.searchsorted(starts, (a - longest + 1, b))
                    if lo == hi:
                        continue
                    own = owners[lo:hi]
                    by = (change[np.clip(stops[lo:hi], a, b) - a] - change[np.clip(starts[lo:hi], a, b) - a]) / self.length[own]
                    if self.single:
                        u[own] += by
                    else:
                        np.add.at(u, own, by)
                    np.add.at(sums, own >> self.BLOCK, by)
        return drawn

    def mean_uniqueness(self, sample: np.ndarray) -> float:
        if not len(sample):
            return float("nan")
        times = np.bincount(sample, minlength=self.n).astype(np.float64)
        edges = np.zeros(len(self.width) + 1)
        np.add.at(edges, self.a, times[self.owner])
        np.subtract.at(edges, self.b, times[self.owner])
        c = np.rint(np.cumsum(edges)[:-1])
        before = np.concatenate([[0.0], np.cumsum(np.where(c > 0, self.width / np.maximum(c, 1.0), 0.0))])
        mean = np.bincount(self.owner, weights=before[self.b] - before[self.a], minlength=self.n) / self.length
        return float(np.average(np.minimum(mean, 1.0), weights=times))


def sequential_bootstrap(ind: DataFrame, replicates: int = 1, sample_length: int | None = None, seed: int = 0,
                         keys=("symbol",), time_col="time") -> DataFrame:
    """Sequential bootstrap draws per (key, replicate): each draw picks event i with probability
    proportional to its average uniqueness given the events already drawn.  Draws inside one
    replicate are sequential; replicates and keys run in parallel (seeded per key and
    replicate).  Output: keys, replicate, draw, t0, plus the standard (uniform) bootstrap's
    mean uniqueness ``std_uniq`` and the sequential one's ``seq_uniq`` per replicate.

    ``ind`` is a matrix of pairs or of runs (``indicator_matrix``).  A task holds the runs of a key's events, and a draw
    costs as much as events overlap it (``_Draws``)."""
    keys = list(keys)
    if not set(RUN) <= set(ind.columns):
        ind = _pair_runs(ind, keys, time_col)
    d = ind.select(*keys, "t0", "_first", "_last").withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))  # one copy per replicate
    key_fields = [f for f in d.schema.fields if f.name in keys]
    ts_type = d.schema["t0"].dataType
    schema = T.StructType(key_fields + [
        T.StructField("replicate", T.IntegerType()), T.StructField("draw", T.IntegerType()),
        T.StructField("t0", ts_type), T.StructField("std_uniq", T.DoubleType()),
        T.StructField("seq_uniq", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ev = np.sort(pdf["t0"].unique())
        n_e = len(ev)
        rep = int(pdf["replicate"].iloc[0])
        key_seed = zlib.crc32("|".join(str(pdf[k].iloc[0]) for k in keys).encode())
        rng = np.random.default_rng([seed, rep, key_seed])
        length = sample_length or n_e
        draws = _Draws(np.searchsorted(ev, pdf["t0"].to_numpy()), pdf["_first"].to_numpy(), pdf["_last"].to_numpy(), n_e)
        drawn = draws.sequential(length, rng)
        std_sample = rng.integers(0, n_e, size=length)
        out = pd.DataFrame({"draw": np.arange(len(drawn), dtype=np.int32), "t0": ev[drawn]})
        out["replicate"] = rep
        out["std_uniq"] = draws.mean_uniqueness(std_sample)
        out["seq_uniq"] = draws.mean_uniqueness(drawn)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[f.name for f in schema.fields]]

    # a group is long work on few bytes: a number of partitions of its own, which is not merged by size
    return d.repartition(DRAW_PARTITIONS, *keys, "replicate").groupBy(*keys, "replicate").applyInPandas(run, schema)


DRAW_PARTITIONS = 256


# --------------------------------------------------------------------------- W9
def weighted_training_table(features: DataFrame, weights: DataFrame, labels: DataFrame,
                            on: Sequence[str] = ("symbol", "t0")) -> DataFrame:
    """features ⟕ weights ⟕ labels on (key, t0), rows with any null but in the key dropped."""
    on = list(on)
    full = join_keys(join_keys(features, weights, on, "left"), labels, on, "left")
    return full.dropna(subset=[c for c in full.columns if c not in on])
