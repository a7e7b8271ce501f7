import datetime as dt
import tempfile

from pyspark.sql import functions as F

from tessera.sources.trades import ingest_backlog, ingest_trades, read_trade_parquets, weekly_last_returns


def _raw(spark, rows):
    return spark.createDataFrame(rows, "symbol string, sip_timestamp long, seq long, price double, size double")


def ns(y, m, d, hh, mm, ss=0):
    # New York wall clock in January (UTC-5) -> ns epoch
    t = dt.datetime(y, m, d, hh, mm, ss, tzinfo=dt.timezone(dt.timedelta(hours=-5)))
    return int(t.timestamp()) * 1_000_000_000


def test_ingest_is_idempotent_and_read_back(spark):
    root = tempfile.mkdtemp(prefix="tessera-ingest-")
    rows = [("A", ns(2024, 1, 2, 9, 29), 0, 10.0, 1.0), ("A", ns(2024, 1, 2, 10, 0), 1, 11.0, 2.0),
            ("B", ns(2024, 1, 3, 15, 59), 2, 5.0, 3.0)]
    skipped = ingest_trades(_raw(spark, rows), f"{root}/trades")
    assert skipped.count() == 0
    again = ingest_trades(_raw(spark, rows), f"{root}/trades")
    assert again.count() == 2  # both (symbol, date) pairs already present
    back = read_trade_parquets(spark, f"{root}/trades", session_only=True)
    assert back.count() == 2  # 09:29 New York is outside the regular session
    assert set(r.symbol for r in back.collect()) == {"A", "B"}


def test_rows_of_many_files_have_their_own_numbers(spark):
    """Rows of one nanosecond in 120 files: ordered by file and row, no number twice."""
    root = tempfile.mkdtemp(prefix="tessera-files-")
    t = ns(2024, 1, 2, 10, 0)
    df = spark.range(360).select(F.lit("A").alias("symbol"), F.lit(t).alias("sip_timestamp"), F.col("id").cast("double").alias("price"), F.lit(1.0).alias("size"))
    df.repartitionByRange(120, "price").sortWithinPartitions("price").write.parquet(f"{root}/raw")
    out = read_trade_parquets(spark, f"{root}/raw").orderBy("ts", "seq").collect()
    assert len(out) == 360 == len({r.seq for r in out}) and [r.price for r in out] == [float(k) for k in range(360)]


def test_backlog_weekdays_minus_existing(spark):
    syms = spark.createDataFrame([("A",)], "symbol string")
    have = spark.createDataFrame([("A", dt.date(2024, 1, 2))], "symbol string, date date")
    b = ingest_backlog(spark, syms, 2024, 1, existing=have)
    days = sorted(r.date for r in b.collect())
    assert dt.date(2024, 1, 2) not in days and dt.date(2024, 1, 6) not in days  # ingested / Saturday
    assert len(days) == 23 - 1


def test_weekly_last_returns(spark):
    px = spark.createDataFrame([("X", dt.date(2024, 1, d), float(p)) for d, p in [(1, 100), (2, 110), (3, 99), (8, 99)]],
                               "symbol string, date date, price double")
    w = {r.week: r.ret for r in weekly_last_returns(px).collect()}
    assert abs(w[dt.date(2024, 1, 7)] - (99 / 110 - 1)) < 1e-12 and w[dt.date(2024, 1, 14)] == 0.0


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "close" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
    assert F is not None
