"""Trade sources and sinks.

Every trade table in this library has the columns
``symbol STRING, ts TIMESTAMP(_NTZ), seq BIGINT, price DOUBLE, size DOUBLE``; ``(ts, seq)`` is the
ordering key inside a symbol, ``seq`` the unique tie-breaker.  ``symbol`` is what gives Spark its
parallelism, so every operator takes it as a key.  Wall-clock times (New York, CSV ticks) are
TIMESTAMP_NTZ and do not depend on the session's time zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tessera.operators.sessions import NY, regular_session, wall_micros
from tessera.session import cut_lineage

TRADE_COLUMNS = ["symbol", "ts", "seq", "price", "size"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades_from_events(spark: SparkSession, sf_dir: str, symbol_col: str = "event_type") -> DataFrame:
    """Stand-in trade table built from the driver's ``events`` table:
    symbol=event_type (or user_id), ts=ts, seq=event_id, price=value, size=props.k; rows with
    size <= 0 are dropped (as the tick cleaning step does).  Only the five needed columns are read."""
    ev = table(spark, sf_dir, "events")
    size = F.get_json_object("props", "$.k").cast("double")
    return (ev.select(F.col(symbol_col).cast("string").alias("symbol"), F.col("ts"),
                      F.col("event_id").alias("seq"), F.col("value").alias("price"), size.alias("size"))
              .where(F.col("size") > 0))


# --------------------------------------------------------------------------- S4
def sip_to_ts(ns: Column) -> Column:
    """Nanosecond UTC epoch -> microsecond TIMESTAMP (UTC instant), rounded down by whole numbers.  Spark
    timestamps stop at microseconds, so the BIGINT stays the ordering key."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000).cast("long")))


def sip_to_utc(ns: Column) -> Column:
    """Nanosecond epoch -> UTC wall clock (TIMESTAMP_NTZ), put together from its day and its time of day."""
    day_ns = F.lit(86_400_000_000_000)
    rest = F.pmod(ns, day_ns)
    date = F.date_from_unix_date(F.call_function("div", ns - rest, day_ns).cast("int"))
    micros = F.call_function("div", rest, F.lit(1000).cast("long"))
    part = lambda n, m: F.pmod(F.call_function("div", micros, F.lit(n).cast("long")), F.lit(m)).cast("int")
    seconds = (F.pmod(micros, F.lit(60_000_000)).cast("decimal(16,6)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(16,6)")
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.day(date), part(3_600_000_000, 24), part(60_000_000, 60), seconds)


def sip_to_ny(ns: Column) -> Column:
    """Nanosecond epoch -> New York wall clock (TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(NY), sip_to_utc(ns))


def ny_to_sip(ny_wall: Column) -> Column:
    """New York wall clock (date, TIMESTAMP_NTZ or TIMESTAMP) -> nanosecond epoch (microsecond precision)."""
    utc = F.convert_timezone(F.lit(NY), F.lit("UTC"), ny_wall.cast("timestamp_ntz"))
    return wall_micros(utc) * F.lit(1000)


# --------------------------------------------------------------------------- S1
def read_trade_parquets(spark: SparkSession, path: str, session_only: bool = True,
                        dst: str | None = None) -> DataFrame:
    """Read raw trade parquet: a folder partitioned by ``symbol=``, files that hold ``symbol``, or files at
    ``{ticker}/{YYYY}/{file}.parquet``, whose ticker is the symbol.  The used columns (pruned at the scan) give
    UTC ``ts`` and New York ``ny_ts``; without a ``seq`` column, ties are ordered by nanosecond, file
    and row of the file.  Optionally keeps the regular session (P1) and writes the result by symbol and date."""
    reader = spark.read.option("mergeSchema", "false")
    try:
        raw = reader.parquet(path)
    except AnalysisException as e:  # no files but in folders that are no partitions
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        raw = reader.option("recursiveFileLookup", "true").parquet(path)
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if "symbol" in raw.columns:
        symbol = F.col("symbol").cast("string")
    else:
        ticker = F.url_decode(F.regexp_extract(file, r"([^/]+)/\d{4}/[^/]+$", 1))
        symbol = F.when(ticker != "", ticker).otherwise(F.raise_error(F.concat(F.lit("no ticker in the path "), file)).cast("string"))
    seq = [F.col("seq").cast("long").alias("seq")] if "seq" in raw.columns else [file.alias("_file"), row.alias("_row")]
    df = raw.select("sip_timestamp", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), symbol.alias("symbol"), *seq)
    if "seq" not in raw.columns:
        # files are numbered by name, so that no two rows share a number: 10 bits of nanoseconds, 20 of the file, 33 of its row
        files = raw.select(file.alias("_file")).distinct()
        files = cut_lineage(files.withColumn("_n", F.row_number().over(W.orderBy("_file")) - 1))  # a row per file
        fits = (F.col("_n") < 1 << 20) & (F.col("_row") < F.lit(1 << 33))
        tie = F.pmod("sip_timestamp", F.lit(1000)) * F.lit(1 << 53) + F.col("_n").cast("long") * F.lit(1 << 33) + F.col("_row")
        df = df.join(files, "_file").withColumn("seq", F.when(fits, tie).otherwise(F.raise_error(F.lit("too many files, or rows in a file, to number")).cast("long"))).drop("_file", "_row", "_n")
    df = df.withColumn("ts", sip_to_ts(F.col("sip_timestamp"))).withColumn("ny_ts", sip_to_ny(F.col("sip_timestamp")))
    if session_only:
        df = regular_session(df, "ny_ts")
    if dst is not None:
        # rebalanced, not repartitioned: a day of one symbol may be split over tasks
        (df.withColumn("date", F.to_date("ny_ts")).hint("rebalance", "symbol", "date")
           .write.mode("overwrite").partitionBy("symbol", "date").parquet(dst))
    return df


# --------------------------------------------------------------------------- S2
def ingested(spark: SparkSession, dst: str) -> DataFrame:
    """(symbol, date) pairs present in ``dst``; none if nothing has been written there.  Any other failure to
    read it is raised: it must not pass for an empty folder."""
    try:
        found = spark.read.schema("price double, size double, symbol string, date date").parquet(dst)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "symbol string, date date")
    return found.select("symbol", "date").distinct()


def ingest_trades(landed: DataFrame, dst: str, spark: SparkSession | None = None) -> DataFrame:
    """Idempotent batch ingest: landed raw trades (symbol, sip_timestamp, price, size, ...) are
    written to ``dst`` partitioned by (symbol, date); (symbol, date) pairs already present are
    skipped by an anti-join, empty pairs are never written.  Returns the skipped pairs."""
    from tessera.session import cut_lineage
    spark = spark or landed.sparkSession
    land = landed.withColumn("date", F.to_date(sip_to_ny(F.col("sip_timestamp"))))
    existing = cut_lineage(ingested(spark, dst))  # as it was before this batch
    fresh = land.join(existing, ["symbol", "date"], "left_anti")
    fresh.hint("rebalance", "symbol", "date").write.mode("append").partitionBy("symbol", "date").parquet(dst)
    return land.select("symbol", "date").distinct().join(existing, ["symbol", "date"], "left_semi")


# --------------------------------------------------------------------------- S3
def ingest_backlog(spark: SparkSession, symbols: DataFrame, year: int, month: int,
                   existing: DataFrame | None = None) -> DataFrame:
    """Every weekday of ``year-month`` x symbol, as half-open New York day ranges in ns, minus the
    (symbol, date) pairs already ingested."""
    start = _dt.date(year, month, 1)
    end = (_dt.date(year + (month == 12), month % 12 + 1, 1) - _dt.timedelta(days=1))
    out = (symbols.select("symbol").distinct()
           .withColumn("date", F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))))
           .where(F.weekday("date") <= 4))  # at most 31 days per symbol
    out = out.withColumn("start_ns", ny_to_sip(F.col("date"))).withColumn("end_ns", ny_to_sip(F.date_add("date", 1)))
    if existing is not None:
        out = out.join(existing.select("symbol", "date"), ["symbol", "date"], "left_anti")
    return out


# --------------------------------------------------------------------------- S5
def read_tick_csv(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    """CSV ticks ``date,time,price,volume`` (m/d/Y, H:M:S with up to six digits of a second): drop volume <= 0,
    parse the joined date/time (``datetime``, TIMESTAMP_NTZ), optionally cut by start date."""
    schema = "date string, time string, price double, volume double"
    df = spark.read.schema(schema).option("header", True).csv(path)
    joined = F.to_timestamp_ntz(F.concat_ws(" ", "date", "time"), F.lit("M/d/yyyy H:m:s[.SSSSSS]"))
    df = df.where(F.col("volume") > 0).select("price", "volume", joined.alias("datetime"))
    if start is not None:
        df = df.where(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    return df


def write_tick_csv(ticks: DataFrame, path: str) -> None:
    """Clean ticks as CSV ``price,volume,datetime`` with a header and microseconds."""
    (ticks.select("price", "volume", F.date_format(F.col("datetime").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"))
          .write.mode("overwrite").option("header", True).csv(path))


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tick_csv`` wrote."""
    df = spark.read.schema("price double, volume double, datetime string").option("header", True).csv(path)
    return df.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


# --------------------------------------------------------------------------- S6
def weekly_last_returns(prices: DataFrame, date_col: str = "date", keys=("symbol",), value: str = "price") -> DataFrame:
    """Long (date, symbol, price) -> daily simple returns -> the last daily return of each week
    (weeks end on Sunday); it does not compound."""
    from tessera.plans.sequence import shift

    k = list(keys)
    d = prices.select(*k, F.col(date_col).alias("date"), F.col(value).alias("price"))
    d = shift(d, k, ["date"], {"price": "prev_price"}, 1)
    d = d.withColumn("ret", F.try_divide("price", "prev_price") - 1).where(F.col("ret").isNotNull())
    week_end = F.date_add(F.date_trunc("week", F.col("date")).cast("date"), 6)
    return (d.groupBy(*k, week_end.alias("week"))
             .agg(F.max_by("ret", "date").alias("ret")))


def unpivot_wide(df: DataFrame, id_col: str, var_name: str = "symbol", value_name: str = "price") -> DataFrame:
    cols = [c for c in df.columns if c != id_col]
    return df.unpivot([id_col], cols, var_name, value_name)
