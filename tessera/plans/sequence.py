"""Ordered-series building blocks that never put a whole key into one task.

A Spark window ``partitionBy(symbol).orderBy(ts)`` sends every row of a symbol to one task; with one
symbol holding a third of the data that task is the whole job.  Every ordered operator in this
library is therefore written *two-level*:

1. rank / accumulate inside a block (an hour, or a chunk of ``chunk_rows`` positions),
   with windows partitioned by ``(keys, block)``;
2. carry what crosses block borders through a small per-block table (one row per key and block),
   whose own window runs over at most a few thousand rows per key;
3. join the carry back on ``(keys, block)``: an equi-join whose big side is already partitioned by
   that key, so only the small side moves (AQE broadcasts it when its measured size allows).

The helpers below are the whole toolkit: global positions, halo windows (lag / lead / rolling),
two-level cumulative aggregates and two-level forward / backward fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.session import cut_lineage

POS = "_pos"
CHUNK = "_chunk"
HALO = "_halo"
BLOCK = "_blk"
KEY = "_key"
DEFAULT_CHUNK_ROWS = 1 << 20


def _cols(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def default_block(df: DataFrame, order: Sequence) -> Column:
    """Hour of the first ordering column when it is a time, year when it is a date; otherwise 2^20-wide ranges.
    Windows over (key, block) sort with spilling, so a crowded hour costs time, not memory; Python groups are
    cut by position (``chunk_rows``) and are bounded whatever the times."""
    first = order[0]
    if isinstance(first, str):
        dt = dict(df.dtypes).get(first, "")
        if dt.startswith("timestamp"):
            return F.date_trunc("hour", F.col(first))
        if dt == "date":
            return F.year(F.col(first))
        return F.floor(F.col(first) / F.lit(DEFAULT_CHUNK_ROWS))
    return F.floor(first / F.lit(DEFAULT_CHUNK_ROWS))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null, the key columns once (the left side's)."""
    r = right.select(*[F.col(c).alias(f"_jk_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for c in keys:
        e = F.col(c).eqNullSafe(F.col(f"_jk_{c}"))
        on = e if on is None else on & e
    return left.join(r, on, how).drop(*[f"_jk_{c}" for c in keys])


def _blocked(df: DataFrame, keys: Sequence[str], block: Column, name: str = BLOCK) -> DataFrame:
    """``df`` with its block and ``KEY``, a struct of the keys and the block.  Structs are never null and compare
    with null equal to null, so windows, aggregates and plain equi-joins on ``KEY`` keep rows with null keys and
    share one partitioning."""
    return df.withColumn(name, block).withColumn(KEY, F.struct(*keys, name))


def _over_blocks(keys: Sequence[str], name: str = BLOCK):
    """Window over the blocks of each key, for tables with one row per ``KEY``."""
    return W.partitionBy(*[F.col(KEY)[k] for k in keys]).orderBy(F.col(KEY)[name])


# --------------------------------------------------------------------------- positions
def with_pos(df: DataFrame, keys: Sequence[str], order: Sequence, block: Column | None = None,
             pos: str = POS) -> DataFrame:
    """Add ``pos``: the 0-based position of each row inside its key in ``order``.

    Rows are ranked inside (key, block); the per-block row counts (one row per key and block) are
    prefix-summed per key and joined back.  ``order`` must be unique within a key."""
    keys = list(keys)
    blk = block if block is not None else default_block(df, order)
    d = _blocked(df, keys, blk)
    d = d.withColumn("_rn", F.row_number().over(W.partitionBy(KEY).orderBy(*_cols(order))))
    counts = d.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    before = _over_blocks(keys).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(KEY, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (d.join(counts, KEY)
             .withColumn(pos, (F.col("_off") + F.col("_rn") - 1).cast("long"))
             .drop("_rn", "_off", BLOCK, KEY))


# --------------------------------------------------------------------------- halo windows
def halo_chunks(df: DataFrame, keys: Sequence[str], order: Sequence, before: int = 0, after: int = 0,
                chunk_rows: int = DEFAULT_CHUNK_ROWS, has_pos: bool = False) -> DataFrame:
    """Cut each key into chunks of ``chunk_rows`` positions and copy the last ``before`` rows of
    the previous chunk and the first ``after`` rows of the next one into each chunk, flagged
    ``_halo``.  A window ``partitionBy(*keys, '_chunk').orderBy('_pos')`` then sees every row it
    needs for lags, leads and rolling frames up to that reach; drop halo rows afterwards."""
    if before > chunk_rows or after > chunk_rows:
        raise ValueError("halo reach must not exceed chunk_rows")
    d = df if has_pos else with_pos(df, keys, order)
    c = F.floor(F.col(POS) / F.lit(chunk_rows)).cast("long")
    local = F.col(POS) - c * F.lit(chunk_rows)
    place = lambda at, halo: F.array(F.struct(at.alias(CHUNK), F.lit(halo).alias(HALO)))
    # a row is written for each chunk that reads it, in one pass over the rows
    places = place(c, False)
    if before > 0:
        places = F.when(local >= chunk_rows - before, F.concat(places, place(c + 1, True))).otherwise(places)
    if after > 0:
        places = F.when((local < after) & (c > 0), F.concat(places, place(c - 1, True))).otherwise(places)
    return d.withColumn("_place", F.explode(places)).select(*d.columns, F.col("_place")[CHUNK].alias(CHUNK), F.col("_place")[HALO].alias(HALO))


def chunk_window(keys: Sequence[str]):
    return W.partitionBy(*keys, CHUNK).orderBy(POS)


def shift(df: DataFrame, keys: Sequence[str], order: Sequence, cols: dict[str, str], k: int = 1,
          chunk_rows: int = DEFAULT_CHUNK_ROWS, keep_pos: bool = False) -> DataFrame:
    """``lag`` (k > 0) or ``lead`` (k < 0) of several columns within each key.

    k = ±1: window lag/lead inside (key, block); the first (last) row of a block takes the last
    (first) row of the previous (next) non-empty block from a one-row-per-block edge table.
    Other k: halo window over position chunks."""
    keys = list(keys)
    has_pos = POS in df.columns
    if abs(k) != 1 or (keep_pos and not has_pos):
        d = halo_chunks(df, keys, order, before=max(k, 0), after=max(-k, 0), chunk_rows=chunk_rows,
                        has_pos=has_pos)
        w = chunk_window(keys)
        for src, dst in cols.items():
            d = d.withColumn(dst, F.lag(src, k).over(w) if k > 0 else F.lead(src, -k).over(w))
        d = d.where(~F.col(HALO)).drop(HALO, CHUNK)
        if not keep_pos and not has_pos:
            d = d.drop(POS)
        return d
    o = _cols(order)
    d = _blocked(df, keys, default_block(df, order))
    w = W.partitionBy(KEY).orderBy(*o)
    vals = F.struct(*[F.col(src).alias(dst) for src, dst in cols.items()])
    edge = F.max_by(vals, F.struct(*o)) if k > 0 else F.min_by(vals, F.struct(*o))
    d = d.withColumn("_at_edge", (F.lag(F.lit(1)).over(w) if k > 0 else F.lead(F.lit(1)).over(w)).isNull())
    for src, dst in cols.items():
        d = d.withColumn(f"_sh_{dst}", F.lag(src, 1).over(w) if k > 0 else F.lead(src, 1).over(w))
    # the edge table is aggregated from the windowed frame, so both branches share one exchange
    edges = d.groupBy(KEY).agg(edge.alias("_edge"))
    bw = _over_blocks(keys)
    nb = edges.select(KEY, (F.lag("_edge").over(bw) if k > 0 else F.lead("_edge").over(bw)).alias("_nb"))
    for src, dst in cols.items():
        d = d.withColumnRenamed(f"_sh_{dst}", dst) if dst not in df.columns else \
            d.withColumn(dst, F.col(f"_sh_{dst}")).drop(f"_sh_{dst}")
    d = d.join(nb, KEY, "left")
    for src, dst in cols.items():
        d = d.withColumn(dst, F.when(F.col("_at_edge"), F.col(f"_nb.{dst}")).otherwise(F.col(dst)))
    return d.drop("_nb", "_at_edge", BLOCK, KEY)


# --------------------------------------------------------------------------- cumulative
def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence, aggs: dict[str, tuple[str, str]],
               chunk_rows: int = DEFAULT_CHUNK_ROWS, keep_pos: bool = False,
               exclusive: bool = False, block: Column | None = None) -> DataFrame:
    """Running aggregates (``sum``, ``max``, ``min``, ``count``) from the first row of the key to the
    current row (or the row before, when ``exclusive``): inside-block running value combined with
    the prefix over earlier blocks' totals (one row per key and block).  ``order`` should be
    unique within a key."""
    keys = list(keys)
    blk = block if block is not None else default_block(df, order)
    d = _blocked(df, keys, blk)
    frame = (W.partitionBy(KEY).orderBy(*_cols(order))
             .rowsBetween(W.unboundedPreceding, -1 if exclusive else 0))
    totals = []
    combine = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
               "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
               "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    for name, (how, col) in aggs.items():
        d = d.withColumn(f"_in_{name}", fn[how](col).over(frame))
        totals.append(fn[how](col).alias(f"_tot_{name}"))
    tot = d.groupBy(KEY).agg(*totals)
    prior = _over_blocks(keys).rowsBetween(W.unboundedPreceding, -1)
    sel = [KEY]
    for name, (how, _) in aggs.items():
        agg = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[how]
        sel.append(agg(f"_tot_{name}").over(prior).alias(f"_pre_{name}"))
    tot = tot.select(*sel)
    d = d.join(tot, KEY, "left")
    for name, (how, _) in aggs.items():
        v = combine[how](F.col(f"_pre_{name}"), F.col(f"_in_{name}"))
        if how == "sum" and not exclusive:
            v = F.when(F.col(f"_pre_{name}").isNull() & F.col(f"_in_{name}").isNull(), F.lit(None)).otherwise(v)
        d = d.withColumn(name, v).drop(f"_pre_{name}", f"_in_{name}")
    return d.drop(BLOCK, KEY)


# --------------------------------------------------------------------------- fills
def fill(df: DataFrame, keys: Sequence[str], order: Sequence, cols: dict[str, str],
         direction: str = "forward", block: Column | None = None, strict: bool = False) -> DataFrame:
    """Two-level forward fill (last non-null at or before the row) or backward fill (first non-null
    at or after).  ``strict`` excludes the current row.  Blocks as ``default_block``."""
    keys = list(keys)
    blk = block if block is not None else default_block(df, order)
    d = _blocked(df, keys, blk)
    o = _cols(order)
    fwd = direction == "forward"
    w = W.partitionBy(KEY).orderBy(*o)
    frame = (w.rowsBetween(W.unboundedPreceding, -1 if strict else 0) if fwd
             else w.rowsBetween(1 if strict else 0, W.unboundedFollowing))
    ordkey = F.struct(*o)
    aggs = []
    for src, dst in cols.items():
        d = d.withColumn(dst, (F.last if fwd else F.first)(src, ignorenulls=True).over(frame))
        pick = F.max_by if fwd else F.min_by
        aggs.append(pick(F.col(src), F.when(F.col(src).isNotNull(), ordkey)).alias(f"_b_{dst}"))
    per_block = d.groupBy(KEY).agg(*aggs)
    bw = _over_blocks(keys)
    bframe = (bw.rowsBetween(W.unboundedPreceding, -1) if fwd else bw.rowsBetween(1, W.unboundedFollowing))
    carry = per_block.select(KEY, *[
        (F.last if fwd else F.first)(f"_b_{dst}", ignorenulls=True).over(bframe).alias(f"_c_{dst}")
        for dst in cols.values()])
    d = d.join(carry, KEY, "left")
    for dst in cols.values():
        d = d.withColumn(dst, F.coalesce(F.col(dst), F.col(f"_c_{dst}"))).drop(f"_c_{dst}")
    return d.drop(BLOCK, KEY)


# --------------------------------------------------------------------------- quantiles
def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str) -> DataFrame:
    """(keys, ``out``): the linearly interpolated quantiles of the non-null values of each key.

    Values are ranked in blocks between approximate quantiles, so that no task sorts or holds a whole key; the
    rows at the positions asked for are then picked by position."""
    keys = list(keys)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    splits = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [k / 64 for k in range(1, 64)], 1000).alias("_s"))
    splits = cut_lineage(splits)  # approximate quantiles may differ when computed again, and are read twice
    d = join_keys(d, splits, keys)
    ranked = with_pos(d, keys, ["_v"], block=F.size(F.filter("_s", lambda e: e < F.col("_v"))))
    at = F.array(*[F.lit(float(p)) for p in probs])
    asked = ranked.select(*keys, POS, "_v", "_n", F.posexplode(at).alias("_i", "_p")).withColumn("_at", F.col("_p") * (F.col("_n") - 1))
    low, high = F.floor("_at"), F.ceil("_at")
    asked = asked.where((F.col(POS) == low) | (F.col(POS) == high))
    part = F.when(low == high, F.lit(1.0)).when(F.col(POS) == low, high - F.col("_at")).otherwise(F.col("_at") - low)
    q = asked.groupBy(*keys, "_i").agg(F.sum(part * F.col("_v")).alias("_q"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"])
    return q.groupBy(*keys).agg(listed.alias(out))
