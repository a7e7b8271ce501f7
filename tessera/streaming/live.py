"""Structured Streaming forms of the ingest, bar and event operators (ST1-ST4).

* ST1 ``ingest``: raw trade files -> parquet partitioned by symbol and date, each trade once, however late it or
  its copies come: a micro-batch is appended without what its partitions hold already.
* ST2 ``live_threshold_bars``: volume / dollar bars with per-symbol state (running sum, OHLC, counts); a bar is
  emitted when it closes, and on request when its day ends.
* ST3 ``live_cusum``: CUSUM events with per-symbol state (sPos, sNeg, last value).
* ST4 ``interval_stats_stream``: tumbling-window statistics per symbol with a watermark.

ST2 and ST3 take a symbol's rows in (ts, seq) order whatever order they arrive in: rows wait in the state, by
time slots of ``slot`` (each costs a few calls to the state store: choose hours to replay months), until the watermark has passed their slot's end and a timer takes them, so a row may come as
late as the watermark allows; a row behind the watermark is dropped.  Only the slots that get rows are written.
The drained stream equals the batch operators (B2/B3, F1) on the rows that were not late; the newest
slots stay in the state until later rows, of any symbol, move the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from tessera.operators.sessions import wall_micros
from tessera.plans.sequence import join_keys
from tessera.sources.trades import sip_to_ny, sip_to_ts

TRADE = ["symbol", "date", "sip_timestamp", "seq"]


# --------------------------------------------------------------------------- ST1
def _mkdirs(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def land(batch: DataFrame, batch_id: int, dst: str, checkpoint: str) -> None:
    """Append to ``dst`` the trades of a micro-batch that it does not hold.

    A batch with a commit marker is done.  One that failed before its marker is run again: what it had
    written is found in its partitions, the only ones read, and is not written twice."""
    spark = batch.sparkSession
    marker = f"{checkpoint.rstrip('/')}/landed/{batch_id}"
    if _exists(spark, marker):
        return
    _mkdirs(spark, dst)
    batch = batch.persist()
    dates = [r.date for r in batch.select("date").distinct().collect()]  # the batch's partitions
    held = spark.read.schema(batch.schema).parquet(dst)
    held = held.where(F.col("date").isin([d for d in dates if d is not None]) | (F.col("date").isNull() if None in dates else F.lit(False)))
    join_keys(batch.dropDuplicates(TRADE), held.select(*TRADE), TRADE, "left_anti").write.partitionBy("symbol", "date").mode("append").parquet(dst)
    batch.unpersist()
    _mkdirs(spark, marker)


def ingest(trades: DataFrame, dst: str, checkpoint: str, trigger_once: bool = True):
    """Land a stream of raw trades (symbol, sip_timestamp, seq, price, size, ...) in ``dst``."""
    s = trades.withColumn("ts", sip_to_ts(F.col("sip_timestamp"))).withColumn("date", F.to_date(sip_to_ny(F.col("sip_timestamp"))))
    w = s.writeStream.foreachBatch(lambda batch, i: land(batch, i, dst, checkpoint)).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start() if trigger_once else w.start()


def ingest_stream(spark, src: str, schema: T.StructType, dst: str, checkpoint: str, trigger_once: bool = True):
    """Tail ``src`` (raw trade parquet with symbol, sip_timestamp, seq, price, size) into ``dst``."""
    return ingest(spark.readStream.schema(schema).parquet(src), dst, checkpoint, trigger_once)


def _event_time(trades: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP: wall-clock NTZ times are counted as instants from 1970-01-01, whatever the
    session's time zone."""
    return trades.withColumn("_et", F.timestamp_micros(wall_micros("ts")))


# --------------------------------------------------------------------------- rows in order
SLOT_KEY = "slot long"
SLOT_ROWS = "us array<long>, seq array<long>, price array<double>, size array<double>"


class InOrder(StatefulProcessor):
    """Rows of a symbol in order.  The state is ``fields`` and, for each time slot, the rows that wait in it;
    ``take(key, fields, us, seq, price, size)`` gets the rows of the slots that the watermark has passed, sorted,
    and returns the new fields and the rows to emit."""

    def __init__(self, start: tuple, fields: T.StructType, take, out_names: list[str], slot_us: int):
        self.start, self.schema, self.take, self.out_names, self.slot_us = start, fields, take, out_names, slot_us

    def init(self, handle) -> None:
        self.handle = handle
        self.fields = handle.getValueState("fields", self.schema)
        self.waiting = handle.getMapState("waiting", SLOT_KEY, SLOT_ROWS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a key's rows come in several Arrow chunks: they are sorted as one
        new = pd.concat([p[["us", "seq", "price", "size"]] for p in rows], ignore_index=True)
        for slot, part in new.groupby(new["us"] // self.slot_us):
            at = (int(slot),)
            cols = [part[c].tolist() for c in ("us", "seq", "price", "size")]
            held = self.waiting.getValue(at)
            if held is not None:
                cols = [[*old, *more] for old, more in zip(held, cols)]
            else:
                self.handle.registerTimer((int(slot) + 1) * self.slot_us // 1000)
            self.waiting.updateValue(at, tuple(cols))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        slots = sorted(k[0] for k in self.waiting.keys() if (k[0] + 1) * self.slot_us <= passed)
        if not slots:  # an earlier timer took them
            return
        parts = []
        for s in slots:
            parts.append(pd.DataFrame(dict(zip(("us", "seq", "price", "size"), self.waiting.getValue((s,))))))
            self.waiting.removeKey((s,))
        rows = pd.concat(parts, ignore_index=True).sort_values(["us", "seq"], kind="stable")
        cols = [rows[c].to_numpy(dtype=t) for c, t in (("us", "int64"), ("seq", "int64"), ("price", float), ("size", float))]
        fields, out = self.take(key, tuple(self.fields.get()) if self.fields.exists() else self.start, *cols)
        self.fields.update(tuple(fields))
        if out:
            yield pd.DataFrame(out, columns=self.out_names)


def _stateful(trades: DataFrame, watermark: str, slot: str, out: T.StructType, state: T.StructType, start: tuple, take) -> DataFrame:
    spark = trades.sparkSession
    # the state store that keeps map states and timers; a setting of the session's streams
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = _event_time(trades).withWatermark("_et", watermark)
    t = t.withColumn("us", F.unix_micros("_et")).select("symbol", "_et", "us", "seq", "price", "size")
    slot_us = int(pd.Timedelta(slot).total_seconds() * 1_000_000)
    processor = InOrder(start, state, take, out.names, slot_us)
    return t.groupBy("symbol").transformWithStateInPandas(processor, out, "Append", "EventTime")


def _wall(us: int | None) -> pd.Timestamp | None:
    return None if us is None else pd.Timestamp(us, unit="us")


# --------------------------------------------------------------------------- ST2
BAR_STATE = T.StructType([
    T.StructField("cum", T.DoubleType()), T.StructField("bar", T.LongType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()),
    T.StructField("dollars", T.DoubleType()), T.StructField("ticks", T.LongType()),
    T.StructField("prev_us", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("start_us", T.LongType())])

BAR_OUT = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("bar", T.LongType()),
    T.StructField("time", T.TimestampNTZType()), T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()),
    T.StructField("dollars", T.DoubleType()), T.StructField("ticks", T.LongType()),
    T.StructField("start_ts", T.TimestampNTZType()), T.StructField("end_ts", T.TimestampNTZType())])

DAY_US = 86_400_000_000


#: Sum, number and OHLC of the open bar at the start.
BAR_START = (0.0, 0, None, None, None, None, 0.0, 0.0, 0, None, None, None)


def _bar_taker(threshold: float, dollar: bool, flush_days: bool):
    def take(key, fields, us, seq, price, size):
        cum, bar, op, hi, lo, cl, vol, dol, n, before, last, first = fields
        out = []
        for t, px, sz in zip(us.tolist(), price.tolist(), size.tolist()):
            if flush_days and n and t // DAY_US != last // DAY_US:  # the day's last bar stays open no longer
                out.append((key[0], bar, _wall(before), op, hi, lo, cl, vol, dol, n, _wall(first), _wall(last)))
                bar, cum, n = bar + 1, 0.0, 0
            if n == 0:
                op, hi, lo, first, vol, dol = px, px, px, t, 0.0, 0.0
            hi, lo, cl, vol, dol, n = max(hi, px), min(lo, px), px, vol + sz, dol + px * sz, n + 1
            cum += px * sz if dollar else sz
            before, last = last, t
            if cum >= threshold:
                out.append((key[0], bar, _wall(before), op, hi, lo, cl, vol, dol, n, _wall(first), _wall(t)))
                bar, cum, n = bar + 1, 0.0, 0
        return (cum, bar, op, hi, lo, cl, vol, dol, n, before, last, first), out

    return take


def live_threshold_bars(trades: DataFrame, threshold: float, dollar: bool = True, watermark: str = "1 hour", flush_days: bool = False, slot: str = "5 minutes"):
    """Streaming volume / dollar bars per symbol (input: symbol, ts, seq, price, size).  With ``flush_days`` the
    bar that is open when a symbol's day ends is emitted with the next day's first row, and the next day begins a
    new one."""
    return _stateful(trades, watermark, slot, BAR_OUT, BAR_STATE, BAR_START, _bar_taker(float(threshold), dollar, flush_days))


# --------------------------------------------------------------------------- ST3
CUSUM_STATE = T.StructType([T.StructField("pos", T.DoubleType()), T.StructField("neg", T.DoubleType()),
                            T.StructField("last", T.DoubleType()), T.StructField("last_us", T.LongType())])
CUSUM_OUT = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("time", T.TimestampNTZType()),
                          T.StructField("side", T.IntegerType())])


def _cusum_taker(h: float):
    def take(key, fields, us, seq, price, size):
        up, down, last, last_us = fields
        out = []
        for t, x in zip(us.tolist(), price.tolist()):
            if t == last_us:  # the first row of a time counts
                continue
            if last is not None:
                up, down = max(0.0, up + (x - last)), min(0.0, down + (x - last))
                if down < -h:
                    down = 0.0
                    out.append((key[0], _wall(t), -1))
                elif up > h:
                    up = 0.0
                    out.append((key[0], _wall(t), 1))
            last, last_us = x, t
        return (up, down, last, last_us), out

    return take


def live_cusum(trades: DataFrame, h: float, watermark: str = "1 hour", slot: str = "5 minutes"):
    """Streaming CUSUM events per symbol (input: symbol, ts, seq, price, size)."""
    return _stateful(trades, watermark, slot, CUSUM_OUT, CUSUM_STATE, (0.0, 0.0, None, None), _cusum_taker(float(h)))


# --------------------------------------------------------------------------- ST4
def interval_stats_stream(trades: DataFrame, minutes: int = 30, watermark: str = "1 hour"):
    """Tumbling ``minutes`` windows per symbol: ticks, volume, mean price, price std, first/last
    (by time) prices; emitted once the watermark passes the window end."""
    t = _event_time(trades).withWatermark("_et", watermark)
    return (t.groupBy("symbol", F.window("_et", f"{minutes} minutes"))
             .agg(F.count(F.lit(1)).alias("ticks"), F.sum("size").alias("volume"), F.avg("price").alias("mean"),
                  F.stddev_samp("price").alias("std"), F.min_by("price", F.struct("ts", "seq")).alias("open"),
                  F.max_by("price", F.struct("ts", "seq")).alias("close"))
             .select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"),
                     "ticks", "volume", "mean", "std", "open", "close"))

