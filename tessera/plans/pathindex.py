"""Searches along a series by a multi-level min-max index.

A key's rows, numbered in time, stand in blocks of ``fan``; a block's items are (last time, lowest, highest
value), of single rows on the first level, of the blocks below on the others, up to one block for a key. A
search goes down the levels and reads one block (a touch: three at most) on each: rows per search are
logarithmic in the series, however long the path is, however the rows crowd in time. The first level is
written once and holds the series; what the others hold is smaller by ``fan`` each.

Keys are compared null-safe.  Times are unique per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tessera.plans.sequence import KEY, POS, with_pos
from tessera.session import cut_lineage

FAN = 32


class PathIndex(NamedTuple):
    levels: list[DataFrame]  # (KEY, _items), the rows' level first
    keys: list[str]
    fan: int


def path_index(series: DataFrame, keys: Sequence[str], time_col: str, value: str, fan: int = FAN) -> PathIndex:
    """Index of ``series`` (keys, time, value)."""
    keys = list(keys)
    d = with_pos(series.select(*keys, F.col(time_col).alias("_t"), F.col(value).cast("double").alias("_v")), keys, ["_t"])
    item = F.struct(F.col("_t").alias("last"), F.col("_v").alias("lo"), F.col("_v").alias("hi"))
    levels = [blocks(d.select(*keys, F.col(POS).alias("_i"), item.alias("_item")), keys, fan)]
    top = levels[0].agg(F.max(f"{KEY}._b")).first()[0] or 0
    while top:
        below = levels[-1]
        item = F.struct(*[f(F.col("_items")[n]).alias(n) for f, n in ((F.array_max, "last"), (F.array_min, "lo"), (F.array_max, "hi"))])
        levels.append(blocks(below.select(*[F.col(f"{KEY}.{k}") for k in keys], F.col(f"{KEY}._b").alias("_i"), item.alias("_item")), keys, fan))
        top //= fan
    return PathIndex(levels, keys, fan)


def blocks(items: DataFrame, keys: Sequence[str], fan: int) -> DataFrame:
    """(KEY, _items): numbered items (keys, _i, _item) in blocks of ``fan``, written once."""
    block = F.struct(*keys, F.floor(F.col("_i") / F.lit(fan)).alias("_b")).alias(KEY)
    listed = items.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("_i", "_item"))).alias("_l"))  # fan items
    return cut_lineage(listed.select(KEY, F.transform("_l", lambda x: x["_item"]).alias("_items")))


def locate(index: PathIndex, rows: DataFrame, at: Column, out: dict[str, str]) -> DataFrame:
    """``rows`` with what ``out`` names of the first row of the series at or after ``at`` (null past its end, or without a time):
    ``pos``, ``time`` and ``value`` -> new column."""
    d = rows.withColumn("_at", at).withColumn("_b", F.when(F.col("_at").isNotNull(), F.lit(0).cast("long")))
    for level in reversed(index.levels):
        d = d.withColumn(KEY, F.struct(*index.keys, "_b")).join(level, KEY, "left")
        d = d.withColumn("_n", F.size(F.filter("_items", lambda x: x["last"] < F.col("_at"))))
        d = d.withColumn("_x", F.get("_items", F.col("_n")))
        d = d.withColumn("_b", F.when(F.col("_x").isNotNull(), F.col("_b") * index.fan + F.col("_n"))).drop("_items", "_n", KEY)
    source = {"pos": F.col("_b"), "time": F.col("_x.last"), "value": F.col("_x.lo")}
    return d.withColumns({name: source[what] for what, name in out.items()}).drop("_at", "_b", "_x")


def first_touches(index: PathIndex, asks: DataFrame, pos: str, above: Callable[[Column, Column], Column], below: Callable[[Column, Column], Column],
                  out: tuple[str, str]) -> DataFrame:
    """``asks`` with the times of the first rows from position ``pos`` on that meet ``above`` and ``below``.

    Both conditions take (lowest, highest) of a block, and may use the columns of ``asks``: they hold for a block if
    they hold for one of its rows.  Equal rows of ``asks`` become one.  A block on the own path and the first
    blocks found above it are all that can hold the first touch, and the least of what they hold is it."""
    cols, fan = asks.columns, index.fan
    d = asks.withColumns({"_up": F.lit(None).cast("long"), "_dn": F.lit(None).cast("long")})
    for k, level in reversed(list(enumerate(index.levels))):
        own = lambda j: F.floor(F.col(pos) / F.lit(fan ** j))
        asked = F.array_distinct(F.array_compact(F.array(own(k + 1), "_up", "_dn")))
        d = d.withColumn("_b", F.explode(asked))
        # the first item that counts, and what is looked for in the block: a touch is in the own one or in that found above
        mine = F.col("_b") == own(k + 1)
        d = d.withColumns({"_from": (own(k) - F.col("_b") * fan + (1 if k else 0)), "_base": F.col("_b") * fan,
                           "_ask_up": mine | F.col("_b").eqNullSafe(F.col("_up")), "_ask_dn": mine | F.col("_b").eqNullSafe(F.col("_dn"))})
        d = d.withColumn(KEY, F.struct(*index.keys, "_b")).join(level, KEY)

        def first(wanted, hits, what):
            item = lambda x, i: F.when((i >= F.col("_from")) & hits(x["lo"], x["hi"]), what(x, i))
            return F.min(F.when(F.col(wanted), F.array_min(F.transform("_items", item))))

        block = lambda x, i: F.col("_base") + i
        found = [first("_ask_up", above, block).alias("_up"), first("_ask_dn", below, block).alias("_dn")]
        if not k:
            when = lambda x, i: x["last"]
            found = [first("_ask_up", above, when).alias(out[0]), first("_ask_dn", below, when).alias(out[1])]
        d = d.groupBy(*cols).agg(*found)
    return d
