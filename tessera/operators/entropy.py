"""Encodings and entropy features.

A message is the ordered sequence of one-character codes of a key's series.  Words and matches are computed
from bounded slices of that sequence (halo frames); only the LZ library (N3) and the expanding-window entropy
read a key's message as one group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tessera.plans.sequence import CHUNK, HALO, POS, exact_quantiles, halo_chunks, join_keys, with_pos


# --------------------------------------------------------------------------- Q1-Q3
def binary_code(x: Column) -> Column:
    return F.when(x >= 0, F.lit("1")).otherwise(F.lit("0"))


def quantile_code(df: DataFrame, q: int = 10, keys=("symbol",), value="ret", out="code") -> DataFrame:
    """pd.qcut codes: edges at the exact linear quantiles k/q, right-closed bins,
    the minimum in bin 0; equal values share a bin.  Code = chr(48 + bin)."""
    keys = list(keys)
    inner = [k / q for k in range(1, q)]
    d = join_keys(df, exact_quantiles(df, keys, value, inner, "_e"), keys, "left")  # q-1 numbers per key
    b = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return d.withColumn(out, F.chr(F.lit(48) + b)).drop("_e")


def sigma_code(df: DataFrame, keys=("symbol",), value="ret", out="code") -> DataFrame:
    """Buckets of width σ (sample std) from the minimum: code chr(48 + floor((x - min)/σ)); the
    maximum, which can sit on the upper edge of the last bucket, is kept in that bucket."""
    keys = list(keys)
    st = df.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"), F.stddev_samp(value).alias("_sd"))
    d = join_keys(df, st, keys)
    # without spread (one value, one row) everything is in bucket 0
    nb = F.ceil(F.try_divide(F.col("_mx") - F.col("_mn"), F.col("_sd")))
    i = F.greatest(F.lit(0), F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("_mn"), F.col("_sd"))), nb - 1), F.lit(0)))
    return d.withColumn(out, F.chr(F.lit(48) + i.cast("int"))).drop("_mn", "_mx", "_sd")


# --------------------------------------------------------------------------- N1 / N2
def words(codes: DataFrame, w: int, keys=("symbol",), order: Sequence[str] = ("bar",), code="code") -> DataFrame:
    """Word of length w starting at each position 0 .. n-w-1 (the last full word is left out, as
    in the reference's pmf)."""
    keys = list(keys)
    d = halo_chunks(codes, keys, list(order), after=w)
    frame = W.partitionBy(*keys, CHUNK).orderBy(POS).rowsBetween(0, w)
    d = d.withColumn("_nx", F.collect_list(code).over(frame)).where(~F.col(HALO))
    # a word is kept only when at least one more code follows it
    d = d.where(F.size("_nx") == w + 1).withColumn("word", F.array_join(F.slice("_nx", 1, w), ""))
    return d.select(*keys, POS, "word")


def pmf(codes: DataFrame, w: int, keys=("symbol",), order: Sequence[str] = ("bar",), code="code") -> DataFrame:
    keys = list(keys)
    wd = words(codes, w, keys, order, code)
    c = wd.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return join_keys(c, tot, keys).withColumn("p", F.col("n") / F.col("_t")).drop("_t")


def plug_in_entropy(codes: DataFrame, w: int, keys=("symbol",), order: Sequence[str] = ("bar",), code="code"):
    keys = list(keys)
    p = pmf(codes, w, keys, order, code)
    return p.groupBy(*keys).agg((F.sum(-F.col("p") * F.log2("p")) / w).alias("entropy"))


# --------------------------------------------------------------------------- N3
def lempel_ziv(codes: DataFrame, keys=("symbol",), order: Sequence[str] = ("bar",), code="code") -> DataFrame:
    """LZ word library size per key.  Each new word is the shortest prefix of what is left that is not in the
    library, which is a walk down a trie until a branch is missing.  The walk is sequential in the message by
    definition, so a key is one group; it holds the key's codes and the trie."""
    keys = list(keys)
    d = codes.select(*keys, *order, code)
    key_fields = [f for f in d.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField("lz_size", T.LongType()), T.StructField("n", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols = pdf.sort_values(list(order), kind="stable")[code].tolist()
        branches, node, size = {}, 0, 0  # (node, symbol) -> node; 0 is the root
        for symbol in symbols:
            child = branches.get((node, symbol))
            if child is None:
                size += 1
                branches[node, symbol] = size
                child = 0
            node = child
        out = pd.DataFrame({"lz_size": [size], "n": [len(symbols)]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[f.name for f in schema.fields]]

    return d.groupBy(*keys).applyInPandas(run, schema)


# --------------------------------------------------------------------------- N4 / N5
def match_lengths(code: np.ndarray, points: np.ndarray, window: np.ndarray) -> np.ndarray:
    """For each point, 1 + the longest match (at most its window) of what begins there with what begins at one
    of its window's earlier places.  For one distance back, matches are runs of equal codes: their lengths are
    the distances to the next unequal pair."""
    n, best = len(code), np.zeros(len(points), np.int64)
    for back in range(1, int(window.max(initial=0)) + 1):
        unequal = np.flatnonzero(code[back:] != code[:-back])
        use = np.flatnonzero((window >= back) & (points >= back))
        at = points[use] - back
        k = np.searchsorted(unequal, at)
        stop = np.where(k < len(unequal), np.append(unequal, n)[np.minimum(k, len(unequal))], n - back)
        best[use] = np.maximum(best[use], np.minimum(stop - at, window[use]))
    return best + 1


def _ranks(code: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... codes, until they are told apart (a suffix that ends comes first)."""
    found = [np.unique(code, return_inverse=True)[1].astype(np.int64) + 1]
    width, n = 1, len(code)
    while found[-1].max(initial=0) < n:
        rank = found[-1]
        pair = rank * (n + 1)
        pair[:n - width] += rank[width:]
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (np.diff(pair[order]) != 0).astype(np.int64)]))
        found.append(new)
        width *= 2
    return [r.astype(np.int32) for r in found]


def _common(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``i`` and at ``j`` (below 0: none), i > j."""
    n, use = len(ranks[0]), j >= 0
    x, y = np.where(use, i, n), np.where(use, j, n)
    for k in range(len(ranks) - 1, -1, -1):
        # equal ranks of the first 2^k codes: both suffixes have that many, or they would be the same suffix
        fits = (x < n) & (y < n)
        same = fits & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        x, y = x + (same << k), y + (same << k)
    return np.where(use, x - i, 0)


def match_lengths_expanding(code: np.ndarray, points: np.ndarray) -> np.ndarray:
    """``match_lengths`` where a point's window is all that lies before it (at most as many codes match).

    The suffixes in sorted order: the longest match of a point is with the nearest one on either side that begins
    before it.  n log n numbers are held."""
    n = len(code)
    if not len(points):
        return np.zeros(0, np.int64)
    ranks = _ranks(code)
    order = np.empty(n, np.int64)
    order[ranks[-1] - 1] = np.arange(n)
    left, right, stack = [-1] * n, [-1] * n, []
    for at in order.tolist():
        while stack and stack[-1] > at:
            right[stack.pop()] = at
        if stack:
            left[at] = stack[-1]
        stack.append(at)
    best = np.maximum(_common(ranks, points, np.asarray(left)[points]), _common(ranks, points, np.asarray(right)[points]))
    return np.minimum(best, points) + 1


def kontoyiannis(codes: DataFrame, window: int | None, keys=("symbol",), order: Sequence[str] = ("bar",), code="code",
                 chunk_rows: int = 1 << 14) -> DataFrame:
    """Kontoyiannis entropy, h = mean(log2(window + 1) / L) with L the match length of what follows a point
    against the codes before it; redundancy r = 1 - h/log2(n).

    With a fixed window (at most half the message) the points are window .. n - window and each sees 2·window
    codes: a chunk of points is one group, with that many codes around it.  With ``window=None`` the window
    expands, the points are 1 .. n/2 and each sees all codes before it: a key is one group then, and its suffixes are sorted
once (``match_lengths_expanding``)."""
    keys = list(keys)
    n = codes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if window is None:
        d = with_pos(codes.select(*keys, *order, code), keys, list(order)).withColumns({CHUNK: F.lit(0).cast("long"), HALO: F.lit(False)})
    else:
        d = halo_chunks(codes.select(*keys, *order, code), keys, list(order), before=window, after=window, chunk_rows=max(chunk_rows, window))
    d = join_keys(d.select(*keys, POS, CHUNK, HALO, F.col(code).alias("_code")), n, keys)
    key_fields = [d.schema[c] for c in keys]
    schema = T.StructType(key_fields + [T.StructField("_h", T.DoubleType()), T.StructField("_points", T.LongType()), T.StructField("_n", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        size, first = int(pdf["_n"].iloc[0]), int(pdf[POS].iloc[0])
        pos = pdf[POS].to_numpy()[~pdf[HALO].to_numpy(dtype=bool)]
        w = np.minimum(size // 2, pos if window is None else np.full(len(pos), window))
        use = (pos >= 1) & (pos <= size // 2) if window is None else (pos >= w) & (pos <= size - w)
        codes = pd.factorize(pdf["_code"])[0]
        found = match_lengths_expanding(codes, pos[use] - first) if window is None else match_lengths(codes, pos[use] - first, w[use])
        out = pd.DataFrame({"_h": [(np.log2(w[use] + 1) / found).sum()], "_points": [int(use.sum())], "_n": [size]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[schema.names]

    parts = d.groupBy(*keys, CHUNK).applyInPandas(run, schema)
    res = parts.groupBy(*keys).agg(F.try_divide(F.sum("_h"), F.sum("_points")).alias("h"), F.max("_n").alias("n"), F.sum("_points").alias("points"))
    return res.withColumn("r", 1 - F.try_divide(F.col("h"), F.log2("n")))


# --------------------------------------------------------------------------- N6
def ar1(df: DataFrame, phi: float = 0.5, keys=("symbol",), order: Sequence[str] = ("bar",), value="x", out="y"):
    """y_t = phi·y_{t-1} + x_t from y = 0 before the start: Σ phi^(t-k)·x_k, the chunked
    exponential scan with decay phi (one chunk carry, no per-key loop)."""
    from tessera.plans.ewm import decayed_sum
    return decayed_sum(df, keys, order, value, out, decay=phi)



