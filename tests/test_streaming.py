import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tessera.operators.bars import dollar_bars
from tessera.operators.filters import cusum_events
from tessera.streaming.live import ingest_stream, interval_stats_stream, land, live_cusum, live_threshold_bars

SCHEMA = "symbol string, ts timestamp_ntz, seq long, price double, size double"


def _trades(make_trades, days=1):
    rng = np.random.default_rng(11)
    return make_trades([(sym, i * 3, i + 1000 * d, float(rng.uniform(5, 50)), float(rng.integers(1, 9)), d) for sym in ["A", "B"] for d in range(days) for i in range(300)])


@pytest.fixture
def shuffled(spark, make_trades):
    """Files whose rows overlap in time, read one by one out of order; then a late file and a last tick that
    moves the watermark past everything."""
    root = tempfile.mkdtemp(prefix="tessera-stream-")
    batch = _trades(make_trades)
    part = F.floor(F.col("seq") / 60)
    # neighbouring files trade rows: a row comes up to one file early or late, within the watermark
    mixed = batch.withColumn("_part", (part + F.pmod(F.col("seq") * 7919, F.lit(2))).cast("int")).cache()
    for p in range(7):
        mixed.where(F.col("_part") == p).drop("_part").orderBy(F.rand(3)).coalesce(1).write.parquet(f"{root}/src/{p}")
    last = batch.where("symbol = 'A'").limit(1)
    end = last.withColumn("symbol", F.lit("Z")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 DAYS"))
    end.coalesce(1).write.parquet(f"{root}/src/7")
    late = last.withColumn("size", F.lit(1e9)).withColumn("seq", F.lit(-1).cast("long"))
    late.coalesce(1).write.parquet(f"{root}/src/8")
    end.withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 DAYS")).coalesce(1).write.parquet(f"{root}/src/9")
    return batch, f"{root}/src"


def _read(spark, src):
    """One file for each micro-batch, in the order of the folders."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{src}/*")


def _drain(spark, sdf, name):
    q = sdf.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


@pytest.fixture
def small_arrow_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_live_bars_out_of_order_equal_batch(spark, shuffled, small_arrow_chunks):
    batch, src = shuffled
    live = _drain(spark, live_threshold_bars(_read(spark, src), 2000.0, watermark="8 hours", slot="37 minutes"), "live_bars").where("symbol <> 'Z'").orderBy("symbol", "bar").toPandas()
    exp = dollar_bars(batch, 2000.0).orderBy("symbol", "bar").toPandas()
    assert len(live) == len(exp) > 0
    assert list(live.ticks) == list(exp.ticks) and list(live.end_ts) == list(exp.end_ts)
    assert np.allclose(live.volume, exp.volume) and np.allclose(live.close, exp.close) and np.allclose(live.open, exp.open)
    assert list(live.time.fillna(0)) == list(exp.time.fillna(0))


def test_live_cusum_out_of_order_equals_batch(spark, shuffled, small_arrow_chunks):
    batch, src = shuffled
    live = _drain(spark, live_cusum(_read(spark, src), 20.0, watermark="8 hours"), "live_cusum").orderBy("symbol", "time").toPandas()
    close = batch.select("symbol", F.col("ts").alias("time"), "seq", F.col("price").alias("close"))
    exp = cusum_events(close, 20.0).orderBy("symbol", "time").toPandas()
    assert list(live.side) == list(exp.side) and list(live.time) == list(exp.time) and len(exp)


def test_live_bars_end_with_the_day(spark, make_trades):
    root = tempfile.mkdtemp(prefix="tessera-stream-")
    t = _trades(make_trades, days=3)
    t.coalesce(1).write.parquet(f"{root}/0")
    t.limit(1).withColumn("symbol", F.lit("Z")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 90 DAYS")).coalesce(1).write.parquet(f"{root}/1")
    live = _drain(spark, live_threshold_bars(_read(spark, root), 1e6, watermark="1 hour", flush_days=True), "flushed").where("symbol <> 'Z'").toPandas()
    # no day reaches the threshold: each ends with one open bar (from 10:00 the first day, with the 20 ticks
    # after midnight the others), and the last day's waits for the next
    assert sorted(live.ticks) == [280, 280, 300, 300, 300, 300] and sorted(live.bar) == [0, 0, 1, 1, 2, 2]
    assert (live.start_ts.dt.date == live.end_ts.dt.date).all()


RAW = T.StructType([T.StructField(n, t()) for n, t in (("symbol", T.StringType), ("sip_timestamp", T.LongType), ("seq", T.LongType), ("price", T.DoubleType), ("size", T.DoubleType))])
NS = int(dt.datetime(2024, 1, 2, 15, tzinfo=dt.timezone.utc).timestamp()) * 10**9


def _raw(symbol, i, hours=0.0):
    return symbol, NS + i * 10**9 + int(hours * 3600) * 10**9, i, 1.0 + i, 2.0


def test_ingest_keeps_late_trades_once(spark):
    """Three landings; the third holds rows 18 hours and a year behind the newest, and copies of old rows."""
    root = tempfile.mkdtemp(prefix="tessera-stream-")
    landed = [[_raw("A", i) for i in range(50)], [_raw("A", i) for i in range(40, 50)] + [_raw("B", 0), _raw("A", 0, 48)],
              [_raw("A", 100 + i, -18) for i in range(5)] * 2 + [_raw(None, 7, -24 * 365), _raw("A", 3), _raw("A", 0, 48)]]
    for k, rows in enumerate(landed):
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(f"{root}/src/{k}")
        ingest_stream(spark, f"{root}/src/*", RAW, f"{root}/dst", f"{root}/ckpt").awaitTermination()
    out = spark.read.parquet(f"{root}/dst")
    assert sorted((str(r.symbol), r.sip_timestamp, r.seq) for r in out.collect()) == sorted({(str(s), t, q) for rows in landed for s, t, q, _, _ in rows})
    assert {str(r.date) for r in out.where("symbol = 'A'").collect()} == {"2024-01-01", "2024-01-02", "2024-01-04"}


def test_a_batch_lands_once(spark):
    """A batch that is run again, before or after its marker was set, adds nothing."""
    root = tempfile.mkdtemp(prefix="tessera-stream-")
    batch = spark.createDataFrame([_raw("A", i) for i in range(9)] * 2, RAW).withColumns({"ts": F.lit(None).cast("timestamp"), "date": F.lit("2024-01-02").cast("date")})
    count = lambda: spark.read.parquet(f"{root}/dst").count()
    land(batch, 4, f"{root}/dst", f"{root}/a")
    assert count() == 9
    land(batch, 4, f"{root}/dst", f"{root}/lost-marker")
    assert count() == 9
    land(batch.withColumn("seq", F.col("seq") + 100), 4, f"{root}/dst", f"{root}/a")  # the marker says that batch 4 is done
    assert count() == 9
    land(batch.withColumn("date", F.lit(None).cast("date")), 5, f"{root}/dst", f"{root}/a")
    assert count() == 18


def test_interval_stats_stream(spark, make_trades):
    root = tempfile.mkdtemp(prefix="tessera-stream-")
    t = _trades(make_trades)
    t.coalesce(1).write.parquet(f"{root}/0")
    out = {(r.symbol, r.start): r for r in _drain(spark, interval_stats_stream(spark.readStream.schema(SCHEMA).parquet(f"{root}/*"), 30, watermark="0 seconds"), "live_stats").collect()}
    # ten ticks, three minutes apart, fall into every half hour
    assert len(out) >= 2 * 28 and {r.ticks for r in out.values()} == {10}
    pdf = t.toPandas()
    for (sym, start), r in list(out.items())[:6]:
        own = pdf[(pdf.symbol == sym) & (pdf.ts >= start) & (pdf.ts < r.end)].sort_values(["ts", "seq"])
        assert np.isclose(r.volume, own["size"].sum()) and r.open == own.price.iloc[0] and r.close == own.price.iloc[-1] and np.isclose(r["mean"], own.price.mean())
