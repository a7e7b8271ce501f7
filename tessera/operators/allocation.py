"""Asset allocation (A1-A7): covariance / correlation, inverse-variance, cluster variance,
hierarchical risk parity, rolling rebalancing and minimum-variance-direction weights.

Returns are long ``(universe..., date, asset, ret)``.  Pairwise statistics are a self-join on
(universe, date); everything N x N after that (linkage, eigenvectors) is small and runs as a
grouped map per universe (or per rebalance window), never on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tessera.plans.sequence import cumulative, join_keys
from tessera.session import cut_lineage


# --------------------------------------------------------------------------- A1 / A2
def covariance(returns: DataFrame, keys: Sequence[str] = (), date="date", asset="asset", ret="ret") -> DataFrame:
    """Sample covariance and correlation of every asset pair over common dates (long form).  Pairs are joined
    once, with a <= b; the other half of the table mirrors them."""
    keys = list(keys)
    a = returns.select(*keys, date, F.col(asset).alias("a"), F.col(ret).alias("ra"))
    b = returns.select(*keys, date, F.col(asset).alias("b"), F.col(ret).alias("rb"))
    half = join_keys(a, b, [*keys, date]).where("a <= b").groupBy(*keys, "a", "b").agg(F.covar_samp("ra", "rb").alias("cov"), F.corr("ra", "rb").alias("corr"))
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(*keys, F.explode(sides).alias("_s"), "cov", "corr").select(*keys, "_s.a", "_s.b", "cov", "corr")


def correlation_distance(cov: DataFrame) -> DataFrame:
    """sqrt((1 - ρ)/2)."""
    return cov.withColumn("dist", F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("corr")) / 2.0)))


# --------------------------------------------------------------------------- A3 / A4
def ivp_weights(cov: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse-variance weights 1/σ²_i / Σ 1/σ²_j per universe."""
    keys = list(keys)
    v = cov.where(F.col("a") == F.col("b")).select(*keys, F.col("a").alias("asset"), F.try_divide(F.lit(1.0), F.col("cov")).alias("_iv"))
    tot = F.sum("_iv").over(W.partitionBy(*keys))  # one row per asset of the universe
    return v.select(*keys, "asset", (F.col("_iv") / tot).alias("weight"))


def cluster_variance(cov: DataFrame, clusters: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """wᵀΣw with w the IVP weights inside each cluster.  clusters: keys, cluster, asset."""
    keys = list(keys)
    cov = cut_lineage(cov)  # read three times
    iv = cov.where(F.col("a") == F.col("b")).select(*keys, F.col("a").alias("asset"), F.try_divide(F.lit(1.0), F.col("cov")).alias("_iv"))
    c = join_keys(clusters, iv, [*keys, "asset"])
    w = c.withColumn("w", F.col("_iv") / F.sum("_iv").over(W.partitionBy(*keys, "cluster")))  # one row per asset
    wa = w.select(*keys, "cluster", F.col("asset").alias("a"), F.col("w").alias("wa"))
    wb = w.select(*keys, "cluster", F.col("asset").alias("b"), F.col("w").alias("wb"))
    j = join_keys(join_keys(cov, wa, [*keys, "a"]), wb, [*keys, "cluster", "b"])
    return j.groupBy(*keys, "cluster").agg(F.sum(F.col("wa") * F.col("cov") * F.col("wb")).alias("cluster_var"))


# --------------------------------------------------------------------------- A5 (numpy helpers)
def single_linkage(dist: np.ndarray) -> np.ndarray:
    """Single-linkage merge table (N-1 rows: left id, right id, distance, size) of the rows of
    ``dist`` taken as points (Euclidean distances between rows), built from the minimum spanning
    tree (Prim) and merged in order of edge length; new clusters get ids N, N+1, ...; the smaller
    id is written first."""
    x = np.asarray(dist, dtype=float)
    n = len(x)
    to_row = lambda j: np.sqrt(((x - x[j]) ** 2).sum(axis=1))  # noqa: E731  one row of distances at a time
    in_tree = np.zeros(n, dtype=bool)
    best = np.full(n, np.inf)
    parent = np.full(n, -1)
    in_tree[0] = True
    best[:] = to_row(0)
    parent[:] = 0
    edges = []
    for _ in range(n - 1):
        cand = np.where(in_tree, np.inf, best)
        j = int(np.argmin(cand))
        edges.append((float(cand[j]), int(parent[j]), j))
        in_tree[j] = True
        near = to_row(j)
        upd = (~in_tree) & (near < best)
        best[upd] = near[upd]
        parent[upd] = j
    edges.sort(key=lambda e: e[0])
    comp = list(range(n))
    size = {i: 1 for i in range(n)}

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    label = {i: i for i in range(n)}
    out = []
    for k, (w, u, v) in enumerate(edges):
        ru, rv = find(u), find(v)
        a, b = sorted((label[ru], label[rv]))
        s = size[ru] + size[rv]
        comp[rv] = ru
        size[ru] = s
        label[ru] = n + k
        out.append((a, b, w, s))
    return np.array(out, dtype=float)


def quasi_diag(link: np.ndarray) -> list[int]:
    """Order of the original items that places similar items together (expand the last merge
    recursively, left before right)."""
    n = len(link) + 1
    order = [int(link[-1, 0]), int(link[-1, 1])]
    while max(order) >= n:
        nxt = []
        for i in order:
            if i >= n:
                nxt += [int(link[i - n, 0]), int(link[i - n, 1])]
            else:
                nxt.append(i)
        order = nxt
    return order


def recursive_bisection(cov: np.ndarray, order: list[int]) -> np.ndarray:
    """Risk-parity weights: the ordered assets are halved again and again, each half of a range getting the
    other's share of the two halves' inverse-variance risk."""
    c, n = cov[np.ix_(order, order)], len(order)
    inverse = 1.0 / np.diag(c)

    def risk(lo: int, hi: int) -> float:
        w = inverse[lo:hi] / inverse[lo:hi].sum()
        return float(w @ c[lo:hi, lo:hi] @ w)

    share, ranges = np.ones(n), [(0, n)]
    while ranges:
        lo, hi = ranges.pop()
        mid = (lo + hi) // 2
        if mid == lo:
            continue
        left, right = risk(lo, mid), risk(mid, hi)
        share[lo:mid] *= right / (left + right)
        share[mid:hi] *= left / (left + right)
        ranges += [(lo, mid), (mid, hi)]
    out = np.empty(n)
    out[order] = share
    return out


def hrp_numpy(cov: np.ndarray, corr: np.ndarray) -> np.ndarray:
    dist = np.sqrt(np.clip((1 - corr) / 2.0, 0.0, None))
    link = single_linkage(dist)
    return recursive_bisection(cov, quasi_diag(link))


def ivp_numpy(cov: np.ndarray) -> np.ndarray:
    iv = 1.0 / np.diag(cov)
    return iv / iv.sum()


def _square(pdf: pd.DataFrame):
    assets = sorted(set(pdf["a"]) | set(pdf["b"]))
    idx = {a: i for i, a in enumerate(assets)}
    n = len(assets)
    cov = np.full((n, n), np.nan)
    cor = np.full((n, n), np.nan)
    for a, b, c, r in zip(pdf["a"], pdf["b"], pdf["cov"], pdf["corr"]):
        cov[idx[a], idx[b]] = c
        cor[idx[a], idx[b]] = r
    return assets, cov, cor


def hrp_weights(cov: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A5 per universe: grouped map over the long N x N table (N² rows per universe)."""
    keys = list(keys)
    d = cov if keys else cov.withColumn("_u", F.lit(0))
    gk = keys or ["_u"]
    key_fields = [f for f in d.schema.fields if f.name in gk]
    schema = T.StructType(key_fields + [T.StructField("asset", d.schema["a"].dataType),
                                        T.StructField("hrp", T.DoubleType()), T.StructField("ivp", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        assets, c, r = _square(pdf)
        out = pd.DataFrame({"asset": assets, "hrp": hrp_numpy(c, r), "ivp": ivp_numpy(c)})
        for k in gk:
            out[k] = pdf[k].iloc[0]
        return out[[f.name for f in schema.fields]]

    res = d.groupBy(*gk).applyInPandas(run, schema)
    return res if keys else res.drop("_u")


# --------------------------------------------------------------------------- A6
def rolling_rebalance(returns: DataFrame, s_length: int, rebal: int, date="date", asset="asset", ret="ret") -> DataFrame:
    """Weights fitted on ``s_length`` dates, held for the next ``rebal`` dates, rolled forward by
    ``rebal``: out-of-sample cumulative return of IVP and HRP per window, and over all windows up to and with
    it (``total_hrp``, ``total_ivp``: the last row's is that of the whole run; their logarithms ``log_total_hrp`` and
    ``log_total_ivp`` are there for growth beyond a double's range, null after a total loss).  Each return row is copied into
    the windows that use it (s_length/rebal in-sample copies, one out-of-sample)."""
    from tessera.operators.stats import equity_curve, total_growth

    returns = returns.select(F.col(date).alias("date"), F.col(asset).alias("asset"), F.col(ret).alias("ret"))
    dates = returns.select("date").distinct()
    dates = dates.withColumn("_i", F.row_number().over(W.orderBy("date")) - 1)  # one row per date: small
    r = returns.join(dates, "date")
    ks = F.sequence(F.floor((F.col("_i") - s_length) / rebal).cast("int") + 1, F.floor(F.col("_i") / rebal).cast("int"))
    ins = r.withColumn("win", F.explode(ks)).where(
        (F.col("win") >= 0) & (F.col("_i") >= F.col("win") * rebal) & (F.col("_i") < F.col("win") * rebal + s_length))
    oos = r.withColumn("win", F.floor((F.col("_i") - s_length) / rebal).cast("int")).where(F.col("win") >= 0)
    w = hrp_weights(covariance(ins, ["win"]), ["win"])
    pr = oos.join(w, ["win", "asset"]).groupBy("win", "date").agg(
        F.sum(F.col("hrp") * F.col("ret")).alias("r_hrp"), F.sum(F.col("ivp") * F.col("ret")).alias("r_ivp"))
    per = cut_lineage(pr.groupBy("win").agg(total_growth("r_hrp").alias("cum_hrp"), total_growth("r_ivp").alias("cum_ivp"), F.count(F.lit(1)).alias("days")))
    per = per.withColumns({"_one": F.lit(0), "_h": F.col("cum_hrp") - 1, "_v": F.col("cum_ivp") - 1})
    per = equity_curve(equity_curve(per, ["_one"], ["win"], "_h", "total_hrp"), ["_one"], ["win"], "_v", "total_ivp")
    logs = {f"_l{c}": F.when(F.col(f"cum_{c}") > 0, F.ln(f"cum_{c}")).otherwise(F.lit(float("nan"))) for c in ("hrp", "ivp")}
    per = cumulative(per.withColumns(logs), ["_one"], ["win"], {f"log_total_{c}": ("sum", f"_l{c}") for c in ("hrp", "ivp")})
    whole = {f"log_total_{c}": F.nullif(F.col(f"log_total_{c}"), F.lit(float("nan"))) for c in ("hrp", "ivp")}
    return per.withColumns(whole).select("win", "cum_hrp", "cum_ivp", "days", "total_hrp", "total_ivp", "log_total_hrp", "log_total_ivp")


# --------------------------------------------------------------------------- A7
def pca_weights(cov: DataFrame, keys: Sequence[str] = (), risk_target: float = 1.0, risk_dist: Sequence[float] | None = None) -> DataFrame:
    """Weights whose risk is spread over the principal directions as ``risk_dist`` says (shares by falling
    eigenvalue; by default all of it on the direction of least variance).  A direction of variance v with
    share s is held at risk_target·sqrt(s/v); directions point so that their largest loading is positive."""
    keys = list(keys)
    d = cov if keys else cov.withColumn("_u", F.lit(0))
    gk = keys or ["_u"]
    key_fields = [f for f in d.schema.fields if f.name in gk]
    schema = T.StructType(key_fields + [T.StructField("asset", d.schema["a"].dataType),
                                        T.StructField("weight", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        assets, c, _ = _square(pdf)
        variance, direction = np.linalg.eigh(c)  # rising variance
        if risk_dist is None:
            held = [(0, 1.0)]
        else:
            if len(risk_dist) != len(variance):
                raise ValueError(f"{len(risk_dist)} risk shares for {len(variance)} assets")
            held = [(len(variance) - 1 - k, share) for k, share in enumerate(risk_dist) if share]
        weight = np.zeros(len(assets))
        for k, share in held:
            v = direction[:, k]
            weight += np.sign(v[np.abs(v).argmax()]) * risk_target * np.sqrt(share / variance[k]) * v
        out = pd.DataFrame({"asset": assets, "weight": weight})
        for k in gk:
            out[k] = pdf[k].iloc[0]
        return out[[f.name for f in schema.fields]]

    res = d.groupBy(*gk).applyInPandas(run, schema)
    return res if keys else res.drop("_u")
