"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows' input partitions have known counts and the shards have fixed sizes. How many rows each partition
sends to each shard is drawn from the multivariate hypergeometric law, as a uniform shuffle of all rows would
deal them (the matrix has partitions x shards numbers, whatever the rows). Each partition permutes its rows
and deals them out by its line of the matrix; after the exchange each shard is permuted again, in blocks of a
uniform hash whose counts give every block its first slot.

Text moves once, at the end, by a unique row id: neither a hot source nor equal texts can load one task.

Defined cases: a null text counts as empty; repeated rows are rows of their own; an empty table gives an
empty result; fewer rows than shards leave shards empty. Rerun on the same partitions with the same seed, the
same rows get the same places. Columns beyond those named stay; names that begin with `__shard_` are reserved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import shared_table

#: Rows of a block in which a shard's rows are ordered by one task.
BLOCK_ROWS = 200_000


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows sent from each partition to each shard; line and column sums are `counts` and `sizes`."""
    rng, left, out = np.random.default_rng(seed), np.array(sizes, dtype=np.int64), np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        # conditional draws, shard by shard; the generator's own multivariate draw is limited to 10^9 rows
        rest, want = int(left.sum()), n
        for j in range(len(sizes) - 1):
            if want == 0:
                break
            rest -= int(left[j])
            out[i, j] = take = _hypergeometric(rng, int(left[j]), rest, want)
            want -= take
        else:
            out[i, -1] = want
        left -= out[i]
    return out


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    return tabled_draw(float(rng.random()), good, bad, n)


def tabled_draw(u: float, good: int, bad: int, n: int) -> int:
    """The draw that `u` in [0, 1) stands for, by the law's own table: each number's chance follows from its
    neighbour's, outward from the mode. Beyond the 14 standard deviations tabled chances are less than a double's step."""
    t = good + bad
    mode = (n + 1) * (good + 1) // (t + 2)
    reach = int(14 * (n * (good / t) * (bad / t) * ((t - n) / max(1, t - 1))) ** 0.5) + 60
    low, high = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    # chance of k + 1 over that of k
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    chance = np.exp(np.concatenate(([0.0], np.cumsum(step))) - step[:mode - low].sum())
    return low + int(np.searchsorted(np.cumsum(chance), u * chance.sum(), side="right"))


def assign_shards(df: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """`df` with `__shard` (0 to shards - 1) and `__shard_slot` (gapless from 0 in each shard)."""
    spark = df.sparkSession
    table = shared_table(df.withColumn("__shard_part", F.spark_partition_id()).withColumn("__shard_row", F.monotonically_increasing_id()), "shard-rows")
    keys = table.select("__shard_part", "__shard_row")
    counts = sorted(map(tuple, keys.groupBy("__shard_part").count().collect()))
    total = sum(n for _, n in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    ends = communication_matrix([n for _, n in counts], sizes, seed).cumsum(axis=1)
    lines = spark.createDataFrame([(p, e.tolist()) for (p, _), e in zip(counts, ends)], "__shard_part int, ends array<long>")
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col("__shard_row"))
    # permute locally, and deal out by the partition's line
    local = F.row_number().over(Window.partitionBy("__shard_part").orderBy(draw("local"), "__shard_row"))
    dealt = keys.withColumn("n", local).join(lines, "__shard_part").select("__shard_row", F.size(F.filter("ends", lambda e: e < F.col("n"))).alias("__shard"))
    # permute each shard again, in blocks of the hash's upper range
    blocks = max(1, -(-total // (shards * BLOCK_ROWS)), 64 if total > 64 * shards else 1)
    block = F.floor(F.shiftrightunsigned(draw("shard"), 11) / F.lit(float(1 << 53)) * blocks).cast("int")
    dealt = shared_table(dealt.withColumn("block", block), "shard-dealt")
    sums = dealt.groupBy("__shard", "block").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("__shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = shared_table(sums.select("__shard", "block", F.coalesce(first, F.lit(0)).alias("first")), "shard-blocks")
    rank = F.row_number().over(Window.partitionBy("__shard", "block").orderBy(draw("shard"), "__shard_row")) - 1
    placed = dealt.withColumn("rank", rank).join(starts, ["__shard", "block"]).select("__shard_row", "__shard", (F.col("first") + F.col("rank")).alias("__shard_slot"))
    placed = shared_table(placed, "shard-placed")
    return table.join(placed.hint("shuffle_hash"), "__shard_row").select(*df.columns, "__shard", "__shard_slot")


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 11) -> None:
    """The shards as Parquet, one folder each, rows in slot order."""
    out = assign_shards(df, shards, seed).repartitionByRange("__shard", "__shard_slot").sortWithinPartitions("__shard", "__shard_slot")
    out.withColumnRenamed("__shard", "shard").drop("__shard_slot").write.partitionBy("shard").parquet(path)
