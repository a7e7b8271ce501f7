"""Mixing sources to target weights.

Tokens are summed per source. Each source gets a share of the mix by its weight, at most `max_repeats`
times its own size; what a capped source can't take goes to the others by weight until none is above.
target / size is the source's repetition rate. A document is emitted floor(rate) times, plus once more if a
hash of its content and the seed falls below the fraction: reruns and lost executors give the same mix.

Defined cases: a null text has size 0; null is a source of its own, ordered last; a source of size 0 has
rate 0; repeated rows are decided alike; an empty table gives an empty mix. Columns beyond those named stay
as they are; names that begin with `__mix_` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import count_words, shared_table


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: float) -> DataFrame:
    """(source, size, target) from one row (source, size) for each source, any number of sources.

    Sources are ranked by code point within range partitions; the partitions' counts (as many as there are
    partitions) give each its first rank. The cap's level is found by aggregates over the source table."""
    spark = sizes.sparkSession
    ranged = sizes.select("source", F.col("size").cast("double").alias("size")).repartitionByRange(F.col("source").asc_nulls_last())
    ranged = shared_table(ranged.withColumn("part", F.spark_partition_id()), "mix-sources")
    before, first = 0, {}
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):
        first[part], before = before, before + n
    from pyspark.sql import Window
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    starts = spark.createDataFrame(sorted(first.items()) or [(0, 0)], "part int, first long")
    ranked = ranged.withColumn("local", local).join(starts, "part").select("source", "size", (F.col("first") + F.col("local")).alias("rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = shared_table(ranked.withColumn("weight", weight).withColumn("cap", F.col("size") * max_repeats), "mix-weights")
    # The capped sources only grow in number, so this ends; the level is the mix's size per unit of weight.
    total = ranked.agg(F.sum("size")).first()[0] or 0.0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * level
        cap, weight_left, n = ranked.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if not weight_left or n == capped:
            break
        capped, level = n, (total - (cap or 0.0)) / weight_left
    return ranked.select("source", "size", F.least("cap", F.col("weight") * level).alias("target"))


def mix_decisions(df: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: float = 3.0, seed: int = 17,
                  id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None) -> DataFrame:
    """`df` with `__mix_size` (words), `__mix_source_size`, `__mix_target` and `__mix_copies`."""
    sized = df.withColumn("__mix_size", count_words(F.col(text_col)) if size is None else size)
    targets = source_targets(sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("__mix_size").alias("size")), weights, max_repeats)
    targets = shared_table(targets, "mix-targets").toDF("__mix_source", "__mix_source_size", "__mix_target")
    out = sized.join(targets, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    rate = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(F.lit(0.0))
    # 52 bits of a hash of the document as a number in [0, 1)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(text_col)).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")
    return out.withColumn("__mix_copies", copies).withColumn("__mix_source_size", F.col("__mix_source_size").cast("long")).drop("__mix_source")


def mix(df: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of `df`, each as many times as decided."""
    out = mix_decisions(df, **options)
    copies = F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))
    return out.filter("__mix_copies > 0").select(*df.columns, copies.alias("__mix_copy")).drop("__mix_copy")
