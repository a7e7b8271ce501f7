"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_shared, shared_table


def _distinct_links(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them and itself: the larger neighbours (large) or,
    with the node, the smaller ones (small). The minima are a table of their own, so that the join with the
    links of a node that has very many can be split."""
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    else:
        links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = shared_table(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")), "cc-least")
    near = links.join(least, F.col("a") == F.col("node"))
    if large:
        return _distinct_links(near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    return _distinct_links(near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link in `links` (a, b); root is the component's smallest node.

    Large and small stars alternate until the links are stars around roots, which takes rounds in the order
    of the logarithm of the longest path. Every round is a table in the shared folder."""
    spark = links.sparkSession
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
    now = shared_table(_distinct_links(links.select("a", "b")), "cc-links")
    before = None
    while (state := mark(now)) != before:
        large = shared_table(_star(now, True), "cc-large")
        small = shared_table(_star(large, False), "cc-small")
        drop_shared(spark, now)
        drop_shared(spark, large)
        now, before = small, state
    return shared_table(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "cc-nodes")
