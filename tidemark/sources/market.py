"""Readers of bars, ticks, fills and slow series, and the versioned bar store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import no_nan

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, seq, session, mid_c, bid_c, ask_c, payload) of events: prices on an integer grid, with a synthetic half-spread of 2 bps and 1 at least."""
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.round(F.col("value") * 100).cast("long").alias("mid_c"), F.col("props").alias("payload"))
    half = F.greatest(F.lit(1), F.expr("mid_c * 2 div 10000"))
    return t.withColumns({"bid_c": F.col("mid_c") - half, "ask_c": F.col("mid_c") + half})


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position_key, seq, ts, side, qty, price, fee) of lineitem: odd lines buy, even lines sell, one position for each part and supplier."""
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("position_key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_linenumber") % 2 == 1, "buy").otherwise("sell").alias("side"), F.col("l_quantity").cast("long").alias("qty"), price.alias("price_c"), F.col("l_tax").alias("fee"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, value): mean order price of each day, a slow driver."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("value"))


def read_bar_csv(spark: SparkSession, path: str, symbol: str, cadence_s: int, sep: str = ",", stamp_format: str | None = None, price_scale: float = 1.0) -> DataFrame:
    """Bars of CSV files: the stamp is open_time, time, timestamp or date; volume may be tick_volume, and is 1000 if missing; a missing close_time is the stamp and the cadence.

    Stamps without zone are the session's. Rows without a stamp or price are refused by FAILFAST; an empty file gives no rows.
    """
    raw = spark.read.csv(path, header=True, sep=sep, mode="FAILFAST", encoding="UTF-8")
    raw = raw.toDF(*[c.strip().lstrip("﻿").lower() for c in raw.columns])
    named = [c for c in ("open_time", "time", "timestamp", "date") if c in raw.columns]
    if not named:
        raise ValueError(f"no column open_time, time, timestamp or date in {path}")
    ts = F.coalesce(*[F.to_timestamp(c, stamp_format) if stamp_format else F.to_timestamp(c) for c in named])
    price = {c: F.col(c).cast("double") * price_scale for c in ("open", "high", "low", "close")}
    end = F.to_timestamp("close_time") if "close_time" in raw.columns else F.lit(None).cast("timestamp")
    counted = [F.col(c).cast("double") for c in ("volume", "tick_volume") if c in raw.columns]
    volume = F.coalesce(*counted) if counted else F.lit(None).cast("double")
    bars = raw.select(F.lit(symbol).alias("symbol"), ts.alias("ts"), *[c.alias(k) for k, c in price.items()], F.coalesce(volume, F.lit(1000.0)).alias("volume"), F.coalesce(end, F.timestamp_seconds(F.unix_seconds(ts) + cadence_s)).alias("close_time"))
    return no_nan(bars)


def read_panel(spark: SparkSession, root: str, cadence_s: int, end: str | None = None, suffix: str = "m15.csv") -> DataFrame:
    """Bars of many instruments, root/<name>/<name>m15.csv each, up to and with `end`; stamps are the server's. Of bars with one stamp one stays, the smallest."""
    bars = read_bar_csv(spark, f"{root}/*/*{suffix}", "", cadence_s).withColumn("symbol", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    bars = bars if end is None else bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    one = bars.groupBy("symbol", "ts").agg(F.min(F.struct("open", "high", "low", "close", "volume")).alias("b"))
    return one.select("symbol", "ts", "b.*")


def read_bar_parquet(spark: SparkSession, path: str, symbol: str, stamp_col: str, volume_col: str = "ticks") -> DataFrame:
    """Bars of Parquet parts whose stamps are UTC without zone."""
    raw = spark.read.parquet(path)
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    return no_nan(raw.select(F.lit(symbol).alias("symbol"), F.col(stamp_col).cast("timestamp_ntz").alias("ts"), *prices, F.col(volume_col).cast("double").alias("volume")))


def refused(condition: Column, value: Column, what: str, stamp: Column) -> Column:
    """The value, or an error that names the row when it is read."""
    return F.when(condition, F.raise_error(F.concat(F.lit(f"{what} at "), F.coalesce(stamp.cast("string"), F.lit("a row without a date")))).cast("double")).otherwise(value)


def read_level_history(spark: SparkSession, path: str) -> DataFrame:
    """(ts, value) of an index's history with lines of text before its header DATE,...,CLOSE (last column). Rows without a date, or with a close that isn't positive, and repeated dates are errors."""
    lines = spark.read.text(path).select(F.split(F.ltrim("value"), ",").alias("f")).where(F.size("f") > 1)
    rows = lines.where(F.upper(F.trim(F.col("f")[0])) != "DATE")
    ts = F.coalesce(F.expr("try_to_timestamp(trim(f[0]), 'MM/dd/yyyy')"), F.expr("try_to_timestamp(trim(f[0]), 'yyyy-MM-dd')")).cast("date")
    d = rows.select(ts.alias("ts"), F.expr("try_cast(trim(f[size(f) - 1]) AS double)").alias("v"), F.trim(F.col("f")[0]).alias("text"))
    d = d.groupBy("ts", "text").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
    bad = F.col("ts").isNull() | F.col("v").isNull() | (F.col("v") <= 0) | (F.col("n") > 1)
    return d.select("ts", refused(bad, F.col("v"), "bad level", F.col("text")).alias("value"))


def read_monthly_levels(spark: SparkSession, path: str, value_col: str, before: str) -> DataFrame:
    """(ts, value): a monthly series of rows (DATE, value) dated on the first, stamped at the month's end, from before a cut-off; later rows' values are never parsed. Other days, missing and negative values are errors."""
    raw = spark.read.csv(path, header=True).where(F.to_date("DATE") < F.lit(before).cast("date"))
    value = F.expr(f"try_cast(`{value_col}` AS double)")
    bad = (F.dayofmonth("DATE") != 1) | value.isNull() | (value < 0)
    return raw.select(F.last_day("DATE").alias("ts"), refused(bad, value, f"bad {value_col}", F.col("DATE")).alias("value"))


def paired(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(ts, two columns) where both series (ts, value) have a value; values that aren't positive are errors when they are read."""
    both = left.select("ts", F.col("value").cast("double").alias("_a")).join(right.select("ts", F.col("value").cast("double").alias("_b")), "ts").where("_a IS NOT NULL AND _b IS NOT NULL")
    return both.select("ts", *[refused(F.col(c) <= 0, F.col(c), f"{n} isn't positive", F.col("ts")).alias(n) for c, n in zip(("_a", "_b"), names, strict=True)])


def read_series_csv(spark: SparkSession, path: str, date_col: str, value_col: str, positive: bool = False) -> DataFrame:
    """(ts, value) of a macro series; "." and non-numbers are dropped, and non-positive values too if positive."""
    raw = spark.read.csv(path, header=True, nullValue=".")
    out = raw.select(F.to_date(date_col).alias("ts"), F.expr(f"try_cast(`{value_col}` AS double)").alias("value")).where("ts IS NOT NULL AND value IS NOT NULL")
    return out.where("value > 0") if positive else out


def monthly(series: DataFrame, lag_months: int) -> DataFrame:
    """(ts, value): the last value of each month, stamped at its end and delayed until it was published."""
    return series.groupBy(F.trunc("ts", "MM").alias("m")).agg(F.max_by("value", "ts").alias("value")).select(F.last_day(F.add_months("m", lag_months)).alias("ts"), "value")


def weekly(series: DataFrame, lag_days: int) -> DataFrame:
    """(ts, value): the last value of each week from Monday, stamped at its Sunday and delayed until it was published."""
    return series.groupBy(F.trunc("ts", "WEEK").alias("w")).agg(F.max_by("value", "ts").alias("value")).select(F.date_add("w", 6 + lag_days).alias("ts"), "value")


def positions_report(spark: SparkSession, path: str, market_code: str, delay_days: int = 3) -> DataFrame:
    """(ts, value, spec_net, comm_net, spec_share, oi) of a weekly report of traders' positions: rows of one market, known delay_days after their date; value is spec_net.

    Columns: date, code, oi, spec_long, spec_short, comm_long, comm_short. Rows without a date or open interest are dropped; of repeated dates the last stays."""
    raw = spark.read.csv(path, header=True)
    number = lambda n: F.expr(f"try_cast(replace(`{n}`, ',', '') AS double)")
    d = raw.where(F.trim("code") == market_code).select(F.to_date("date").alias("date"), *[number(n).alias(n) for n in ("oi", "spec_long", "spec_short", "comm_long", "comm_short")]).where("date IS NOT NULL AND oi > 0")
    one = d.groupBy("date").agg(F.max(F.struct("oi", "spec_long", "spec_short", "comm_long", "comm_short")).alias("r")).select("date", "r.*")
    net = F.col("spec_long") - F.col("spec_short")
    return one.select(F.date_add("date", delay_days).alias("ts"), net.alias("value"), net.alias("spec_net"), (F.col("comm_long") - F.col("comm_short")).alias("comm_net"), ((F.col("spec_long") + F.col("spec_short")) / F.col("oi")).alias("spec_share"), "oi")


def checked_positions(report: DataFrame) -> DataFrame:
    """positions_report() rows whose traders hold no more than the open interest; others are errors when they are read."""
    bad = F.col("spec_share") > 2
    return report.withColumn("value", refused(bad, F.col("value"), "impossible positions", F.col("ts")))


def write_bar_csv(bars: DataFrame, path: str) -> None:
    """Bars as CSV parts with a header, stamps in UTC; read_bar_csv reads them back."""
    bars.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("open_time"), "open", "high", "low", "close", "volume").write.csv(path, header=True)


def merge_chunks(bars: DataFrame) -> DataFrame:
    """Chunks of one series: identical bars count once; stamps with different bars are an error when they are read."""
    prices = F.struct("open", "high", "low", "close")
    merged = bars.groupBy("symbol", "ts").agg(F.min(prices).alias("a"), F.max(prices).alias("b"), F.first("volume").alias("volume"))
    checked = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("conflicting bars at "), F.col("ts").cast("string"))))
    return merged.select("symbol", "ts", checked.alias("p"), "volume").select("symbol", "ts", "p.*", "volume")


def write_bars(bars: DataFrame, root: str, timeframe: str, version: str) -> None:
    """Stores a version once: root/bars by timeframe, version and symbol, and its manifest row. A version that exists is an error."""
    spark = bars.sparkSession
    part = f"{root}/bars/timeframe={timeframe}/version={version}"
    bars.write.mode("errorifexists").partitionBy("symbol").parquet(part)
    stored = spark.read.parquet(part)
    manifest = stored.agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"), checksum(stored).alias("checksum"))
    manifest.select(F.lit(timeframe).alias("timeframe"), F.lit(version).alias("version"), "*", F.current_timestamp().alias("created_at")).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def checksum(bars: DataFrame):
    """A hash of all rows that doesn't depend on their order."""
    return F.sum(F.xxhash64("symbol", "ts", "open", "high", "low", "close").cast("decimal(38,0)")).cast("string")


def purge_version(spark: SparkSession, root: str, timeframe: str, version: str) -> None:
    """Withdraws a version: a tombstone in the manifest hides it from readers at once. Stored files are never changed under a running reader."""
    gone = spark.createDataFrame([(timeframe, version)], "timeframe string, version string")
    gone.coalesce(1).write.mode("append").parquet(f"{root}/purged")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Registered versions that weren't purged."""
    rows = spark.read.parquet(f"{root}/manifest")
    try:
        purged = spark.read.parquet(f"{root}/purged")
    except AnalysisException:  # nothing was ever purged
        return rows
    return rows.join(purged.distinct(), ["timeframe", "version"], "left_anti")


def latest_version(spark: SparkSession, root: str, timeframe: str) -> str | None:
    return manifest(spark, root).where(F.col("timeframe") == timeframe).agg(F.max_by("version", "created_at")).first()[0]


def usable_versions(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows whose stored bars are as many as registered."""
    stored = spark.read.parquet(f"{root}/bars").groupBy("timeframe", F.col("version").cast("string").alias("version")).agg(F.count(F.lit(1)).alias("stored"))
    return manifest(spark, root).join(stored, ["timeframe", "version"]).where("stored = rows").drop("stored")


def read_bars(spark: SparkSession, root: str, timeframe: str, version: str, start=None, end=None) -> DataFrame:
    """Bars with start <= ts < end; both bounds and the partition columns are pushed down to the scan."""
    bars = spark.read.parquet(f"{root}/bars").where((F.col("timeframe") == timeframe) & (F.col("version").cast("string") == version))
    bars = bars if start is None else bars.where(F.col("ts") >= start)
    return (bars if end is None else bars.where(F.col("ts") < end)).select(*BAR_COLUMNS)


def agreement(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(n, max_diff, corr, same_sign): two copies of a series where both are known, and the share of changes with equal sign. Series are slow: one window over all stamps."""
    both = left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), keys).where("a IS NOT NULL AND b IS NOT NULL")
    w = Window.orderBy(*keys)
    da, db = F.signum(F.col("a") - F.lag("a").over(w)), F.signum(F.col("b") - F.lag("b").over(w))
    d = both.withColumn("same", (da == db).cast("double"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"), F.corr("a", "b").alias("corr"), F.avg("same").alias("same_sign"))


def row_chain(rows: DataFrame, keys: list[str], order: list[str], text: Column) -> DataFrame:
    """(keys, n, head): a hash chain over a group's rows in order, each link the SHA-256 of the link before and the row's text. Groups must be bounded (a month of bars)."""
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, text.alias("_text")))).alias("r"))
    head = F.aggregate("r", F.lit(""), lambda link, x: F.sha2(F.concat(link, F.coalesce(x["_text"], F.lit(""))), 256))
    return g.select(*keys, F.size("r").cast("long").alias("n"), head.alias("head"))
