"""Exponentially weighted mean / variance (E1, E2) as a chunked scan.

adjust=True weights: at position i the row at position k <= i has weight (1-a)^(i-k).  Inside a
chunk of ``C`` positions the running sums of weights, of values about the chunk's mean and of their squares
are plain window sums of terms scaled by (1-a)^(-j), j the position inside the chunk, and scaled back.  ``C`` is
chosen so that (1-a)^(-2C) stays finite and (1-a)^C is below 1e-130.  What enters a chunk is the state at the
last value before it, wherever that lies: the state of the last chunk with values, joined with that of the
one before it (anything older weighs less than 1e-130).  These tables have one row per chunk.

Nulls keep their position and age the weights of earlier rows (pandas ``ignore_na=False``); however long a run
of nulls is, mean and variance stay, as only ratios of weights count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.plans.sequence import CHUNK, KEY, POS, _blocked, _over_blocks, with_pos


def alpha_of(span: float | None = None, alpha: float | None = None, com: float | None = None) -> float:
    if alpha is not None:
        return float(alpha)
    if span is not None:
        return 2.0 / (float(span) + 1.0)
    if com is not None:
        return 1.0 / (1.0 + float(com))
    raise ValueError("give span, alpha or com")


def chunk_rows_for(a: float) -> int:
    if a >= 1.0:
        return 1 << 20
    lam = -math.log1p(-a)
    return int(max(1, min(1 << 22, math.floor(300.0 / lam))))


def ewm(df: DataFrame, keys: Sequence[str], order: Sequence, col: str, out_mean: str | None = None,
        out_std: str | None = None, out_var: str | None = None, span: float | None = None,
        alpha: float | None = None, min_periods: int = 0, keep_pos: bool = False) -> DataFrame:
    """Add EWM mean and/or bias-corrected std / var of ``col`` per key in ``order``."""
    keys = list(keys)
    a = alpha_of(span, alpha)
    has_pos = POS in df.columns
    d = df if has_pos else with_pos(df, keys, order)
    x = F.col(col).cast("double")
    if a >= 1.0:  # weight only on the current row
        d = d.withColumn("_x", x)
        if out_mean:
            d = d.withColumn(out_mean, F.col("_x"))
        if out_std:
            d = d.withColumn(out_std, F.lit(None).cast("double"))
        if out_var:
            d = d.withColumn(out_var, F.lit(None).cast("double"))
        return d.drop("_x") if keep_pos or has_pos else d.drop("_x", POS)
    C = chunk_rows_for(a)
    lam = -math.log1p(-a)
    d = _blocked(d, keys, F.floor(F.col(POS) / F.lit(C)).cast("long"), CHUNK)
    j = (F.col(POS) - F.col(CHUNK) * F.lit(C)).cast("double")
    g = F.exp(j * F.lit(lam))          # (1-a)^(-j)
    g2 = F.exp(j * F.lit(2 * lam))     # (1-a)^(-2j)
    ok = x.isNotNull() & ~F.isnan(x)
    d = d.withColumn("_xv", F.when(ok, x)).withColumn("_ref", F.avg("_xv").over(W.partitionBy(KEY)))
    off = F.col("_xv") - F.col("_ref")
    has = F.col("_xv").isNotNull()
    w = W.partitionBy(KEY).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    sums = {"_s0": F.sum(F.when(has, g)).over(w) / g, "_s1": F.sum(off * g).over(w) / g, "_s2": F.sum(off * off * g).over(w) / g,
            "_q0": F.sum(F.when(has, g2)).over(w) / g2, "_cnt": F.count("_xv").over(w)}
    state = [*sums, "_ref", POS]

    def aged(old, at, ref):
        """Weights, values and squares of state ``old`` seen from position ``at`` about ``ref``."""
        f = F.exp(-(at - old[POS]).cast("double") * F.lit(lam))
        by = old["_ref"] - ref
        return {"_s0": old["_s0"] * f, "_s1": (old["_s1"] + old["_s0"] * by) * f, "_s2": (old["_s2"] + 2 * by * old["_s1"] + old["_s0"] * by * by) * f,
                "_q0": old["_q0"] * f * f, "_cnt": old["_cnt"]}

    # the state at each chunk's last value, with what the last value before the chunk adds to it; plain sums, so that the
    # running ones are computed once
    at = F.when(has, F.col(POS))
    whole = d.groupBy(KEY).agg(F.sum(F.when(has, g)).alias("_s0"), F.sum(off * g).alias("_s1"), F.sum(off * off * g).alias("_s2"), F.sum(F.when(has, g2)).alias("_q0"),
                               F.count("_xv").alias("_cnt"), F.max("_ref").alias("_ref"), F.max(at).alias(POS), F.max(F.when(has, g)).alias("_g"))
    ended = [F.col("_s0") / F.col("_g"), F.col("_s1") / F.col("_g"), F.col("_s2") / F.col("_g"), F.col("_q0") / (F.col("_g") * F.col("_g")), F.col("_cnt"), F.col("_ref"), F.col(POS)]
    tail = whole.select(KEY, F.when(F.col(POS).isNotNull(), F.struct(*[c.alias(name) for c, name in zip(ended, state)])).alias("_own"))
    d = d.withColumns(sums)
    by_chunk = _over_blocks(keys, CHUNK).rowsBetween(W.unboundedPreceding, -1)
    own = F.col("_own")
    tail = tail.withColumn("_old", F.last("_own", ignorenulls=True).over(by_chunk))
    older = aged(F.col("_old"), own[POS], own["_ref"])
    joined = F.struct(*[(own[c] + F.coalesce(older[c], F.lit(0))).alias(c) for c in sums], own["_ref"].alias("_ref"), own[POS].alias(POS))
    tail = tail.withColumn("_all", F.when(own.isNotNull(), joined))
    tail = tail.select(KEY, F.last("_all", ignorenulls=True).over(by_chunk).alias("_in"))
    d = d.join(tail, KEY, "left")
    into = F.col("_in")
    # before the chunk's first value the state that came in is kept as it is: scaling would lose it in the end
    fresh = F.col("_cnt") == 0
    came = aged(into, F.when(fresh, into[POS]).otherwise(F.col(POS)), F.coalesce("_ref", into["_ref"]))
    S0, S1, S2, Q0, N = (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(came[c], F.lit(0)) for c in sums)
    mean = F.when(S0 > 0, S1 / S0)
    enough = N >= F.lit(max(min_periods, 1))
    if out_mean:
        d = d.withColumn(out_mean, F.when(enough, mean + F.coalesce("_ref", into["_ref"])))
    if out_std or out_var:
        biased = S2 / S0 - mean * mean
        denom = S0 * S0 - Q0
        var = F.when((N >= F.lit(max(min_periods, 2))) & (denom > 0),
                     F.greatest(biased, F.lit(0.0)) * S0 * S0 / denom)
        if out_var:
            d = d.withColumn(out_var, var)
        if out_std:
            d = d.withColumn(out_std, F.sqrt(var))
    d = d.drop(*sums, "_ref", "_xv", "_in", CHUNK, KEY)
    if not keep_pos and not has_pos:
        d = d.drop(POS)
    return d


def decayed_sum(df: DataFrame, keys: Sequence[str], order: Sequence, col: str, out: str, decay: float) -> DataFrame:
    """Σ_k decay^(i-k)·x_k per key (a first-order linear recurrence y = decay·y_prev + x),
    computed like the EWM numerator: chunked scaled sums plus the previous chunk's carry."""
    keys = list(keys)
    a = 1.0 - float(decay)
    has_pos = POS in df.columns
    d = df if has_pos else with_pos(df, keys, order)
    C = chunk_rows_for(a)
    lam = -math.log(decay)
    d = _blocked(d, keys, F.floor(F.col(POS) / F.lit(C)).cast("long"), CHUNK)
    j = (F.col(POS) - F.col(CHUNK) * F.lit(C)).cast("double")
    g = F.exp(j * F.lit(lam))
    w = W.partitionBy(KEY).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum(F.coalesce(F.col(col).cast("double"), F.lit(0.0)) * g).over(w) / g)
    tail = d.groupBy(KEY).agg(F.max_by("_s", F.col(POS)).alias("_cs"), F.max(POS).alias("_lp"))
    following = F.struct(*[F.col(KEY)[k].alias(k) for k in keys], (F.col(KEY)[CHUNK] + 1).alias(CHUNK))
    d = d.join(tail.withColumn(KEY, following), KEY, "left")
    carry = F.coalesce(F.col("_cs") * F.exp(-(F.col(POS) - F.col("_lp")).cast("double") * F.lit(lam)), F.lit(0.0))
    d = d.withColumn(out, F.col("_s") + carry).drop("_s", "_cs", "_lp", CHUNK, KEY)
    return d if has_pos else d.drop(POS)
