"""Exact top-k by inner product with pivot-table elimination.

Vectors are scaled to integers. One coordinate more, sqrt(M^2 - |x|^2) with M the longest vector's length
(0 for queries, whose length does not matter), puts all on a sphere, where the largest inner product is the
smallest angle d. The distances d of every vector to `pivots` data vectors are computed once and stored with it.
For a query q and a pivot p the triangle inequality gives d(q, x) >= |d(q, p) - d(x, p)|; the largest of these
lower bounds, over all pivots, bounds the score from above: M |q| cos(bound). Candidates are evaluated exactly in
the order of their bounds, until the k-th score lies above the bounds of all that are left.

Queries and candidates meet in blocks, (candidates / `block`) x (queries / `query_block`) groups of bounded
size. A first round against one block gives each query a score that k candidates reach; further blocks begin
with it, and so mostly return nothing. The pivots are a bounded sample (the first by a hash): they decide how
many candidates are evaluated, never which are returned.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
continued by zeros; every other row is a candidate, repeated ones and those without an id too, but for the query's
own row; ties go to the smaller id, none last; repeated queries are answered each; fewer than k candidates are all returned;
an empty table gives an empty result. Scores must fit 53 bits, else ValueError. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shared_table

EXACT = 1 << 53


def scaled(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, vec): vectors as floor(scale * x), those that take part."""
    v = F.col(vec_col)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return df.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), whole.alias("vec"))


def distances(x: np.ndarray, x_more: np.ndarray, pivots: np.ndarray, p_more: np.ndarray) -> np.ndarray:
    """Angles between rows and pivots, one further coordinate each; 0 with a vector of length 0."""
    size = lambda v, more: np.sqrt((v * v).sum(axis=1) + more * more)
    both = np.outer(size(x, x_more), size(pivots, p_more))
    return np.arccos(np.clip(np.divide(x @ pivots.T + np.outer(x_more, p_more), both, out=np.ones_like(both), where=both > 0), -1, 1))


def search(queries: np.ndarray, q_rows: np.ndarray, q_dist: np.ndarray, floor: np.ndarray, vecs: np.ndarray, rows: np.ndarray, dist: np.ndarray, longest: float, k: int):
    """For each query of a block, the k best candidates of a block that reach the query's floor: lists of
    (query's place, candidates' places, scores). Ties go to the smaller place."""
    reach_of = np.sqrt((queries * queries).sum(axis=1) * longest)
    for i in range(len(queries)):
        bound = np.abs(dist - q_dist[i]).max(axis=1) if len(rows) else np.zeros(0)
        most = reach_of[i] * (np.cos(bound) + 1e-7) + 1  # the slack is far above the rounding of angles
        most[rows == q_rows[i]] = -np.inf
        least = floor[i]
        order = np.argsort(-most, kind="stable")
        order = order[:np.searchsorted(-most[order], -least, side="right")] if np.isfinite(least) else order[most[order] > -np.inf]
        place, score, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 8 * k
        while at < len(order):
            new = order[at:at + step]
            place, score = np.concatenate((place, new)), np.concatenate((score, vecs[new] @ queries[i]))
            best = np.lexsort((place, -score))[:k]
            place, score = place[best], score[best]
            at, step = at + step, step * 2
            if len(score) == k and at < len(order) and most[order[at]] < score[-1]:
                break
        reach = score >= least
        yield i, place[reach], score[reach]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // len(lists) if len(lists) else 0)


def _meet(rows: DataFrame, longest: float, k: int) -> DataFrame:
    """Search each group (v_block, q_block) of rows (is_query, row, id, vec, dist, floor)."""
    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        q, v = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query)).sort_by([("id", "ascending"), ("row", "ascending")])
        own, asked = v.column("row").to_numpy(), q.column("row").to_numpy()
        out = []
        if len(own) and len(asked):
            found = search(_matrix(q.column("vec")), asked, _matrix(q.column("dist")), q.column("floor").to_numpy(), _matrix(v.column("vec")), own, _matrix(v.column("dist")), longest, k)
            out = [(np.full(len(p), asked[i]), p, s.astype(np.int64)) for i, p, s in found]
        query, place, score = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(query), v.column("row").take(pa.array(place)), v.column("id").take(pa.array(place)), pa.array(score)], ["query", "row", "id", "score"])

    return rows.groupBy("v_block", "q_block").applyInArrow(run, "query long, row long, id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, pivots: int = 32, block: int = 4096, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates; `is_query` is a condition on `id`."""
    spark = df.sparkSession
    rows = shared_table(scaled(df, id_col, vec_col, scale), "pivot-rows")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, n_queries, dim, longest = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("vec")), F.max(square)).first()
    dim, longest = dim or 0, longest or 0.0
    if longest >= EXACT:
        raise ValueError(f"squared length {longest:.3g}: inner products would not be exact")
    padded = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec")))
    rows = rows.select("row", "id", padded.alias("vec"))
    sample = rows.orderBy(F.xxhash64("id", "row"), "id", "row").limit(pivots).collect()
    chosen = np.array([r.vec for r in sample], float).reshape(len(sample), dim)
    p_more = np.sqrt(np.maximum(longest - (chosen * chosen).sum(axis=1), 0))

    def measure(batches):
        for b in batches:
            x = _matrix(pa.chunked_array([b.column(2)])).reshape(b.num_rows, dim)
            more = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
            cols = [pa.array(list(distances(x, m, chosen, p_more)), pa.list_(pa.float64())) for m in (more, np.zeros(len(x)))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], ["row", "id", "vec", "dist", "q_dist"])

    # the pivot table
    table = shared_table(rows.mapInArrow(measure, "row long, id long, vec array<double>, dist array<double>, q_dist array<double>"), "pivot-table")
    v_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    block_of = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    asked = shared_table(table.filter(is_query).select("row", "id", "vec", F.col("q_dist").alias("dist"), block_of(q_blocks).alias("q_block")), "pivot-queries")
    vecs = table.select("row", "id", "vec", "dist", block_of(v_blocks).alias("v_block"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def meet(vecs, queries):
        names = ["is_query", "row", "id", "vec", "dist", "floor", "v_block", "q_block"]
        left = vecs.withColumn("q_block", every(q_blocks)).withColumns({"is_query": F.lit(False), "floor": F.lit(0.0)})
        return _meet(left.select(names).unionByName(queries.withColumn("is_query", F.lit(True)).select(names)), longest, k)

    none = F.lit(float("-inf"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    first = shared_table(meet(vecs.filter("v_block = 0"), asked.withColumns({"floor": none, "v_block": F.lit(0)})), "pivot-first")
    reached = shared_table(first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") == k).select("query", F.col("low").cast("double").alias("floor")), "pivot-floor")
    found = first
    if v_blocks > 1:
        further = asked.join(reached.withColumnRenamed("query", "row"), "row", "left").withColumn("floor", F.coalesce("floor", none)).withColumn("v_block", F.explode(F.sequence(F.lit(1), F.lit(v_blocks - 1))))
        found = first.unionByName(meet(vecs.filter("v_block > 0"), further))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
