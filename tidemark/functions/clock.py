"""Server clocks, sessions and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import seconds


def server_to_utc(stamp: Column, zone: str = "America/New_York") -> Column:
    """UTC of a server stamp that is GMT+3 while `zone` keeps summer time and GMT+2 else, as probed at the stamp less 3 hours."""
    probe = stamp - F.expr("INTERVAL 3 HOURS")
    offset = F.unix_seconds(F.from_utc_timestamp(probe.cast("timestamp"), zone)) - F.unix_seconds(probe.cast("timestamp"))
    winter = {"America/New_York": -5 * 3600, "Europe/Athens": 2 * 3600}[zone]
    return F.when(offset != winter, probe).otherwise(stamp - F.expr("INTERVAL 2 HOURS"))


def closures(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(start, end) in UTC: weekends from Friday 17:00 to Sunday 18:00 and 17:00 to 18:00 on Mondays to Thursdays, New York time."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS d")
    at = lambda day, h: F.to_utc_timestamp(F.col(day).cast("timestamp") + F.make_interval(hours=F.lit(h)), "America/New_York").cast("timestamp_ntz")
    week = days.withColumn("s", F.date_add("d", 2)).where(F.weekday("d") == 4).select(at("d", 17).alias("start"), at("s", 18).alias("end"))
    return days.where(F.weekday("d") < 4).select(at("d", 17).alias("start"), at("d", 18).alias("end")).union(week)


def payroll_releases(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(ts) in UTC of 08:30 New York time on each month's first Friday."""
    months = spark.sql(f"SELECT explode(sequence(DATE'{first_year}-01-01', DATE'{last_year}-12-01', INTERVAL 1 MONTH)) AS m")
    friday = F.next_day(F.date_sub("m", 1), "Fri").cast("timestamp")
    return months.select(F.to_utc_timestamp(friday + F.expr("INTERVAL '08:30' HOUR TO MINUTE"), "America/New_York").cast("timestamp_ntz").alias("ts"))


#: Bars of a trading year (252 days of 24 hours) for each name of a bar's width: fixed values.
PERIODS = {"1m": 362_880, "5m": 72_576, "15m": 24_192, "30m": 12_096, "1h": 6_048, "4h": 1_512, "1d": 252}
#: Other names of the same widths.
ALIASES = {"m1": "1m", "h1": "1h", "d1": "1d"}


def periods_per_year(timeframe: str) -> int:
    """Bars of a trading year; an unknown name is an error, since a wrong guess changes every yearly ratio."""
    name = timeframe.strip().lower()
    name = ALIASES.get(name, name)
    if name not in PERIODS:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    return PERIODS[name]


def bars_per_year(bars: DataFrame) -> DataFrame:
    """(symbol, bars_per_year): 252 days over the median spacing of bars; 252 for series of fewer than three bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    gap = bars.select("symbol", (seconds("ts") - seconds(F.lag("ts").over(w))).alias("s"))
    apart = gap.groupBy("symbol").agg(F.percentile(F.when(F.col("s") > 0, F.col("s")), 0.5).alias("m"), F.count_if(F.col("s") > 0).alias("n"))
    return apart.select("symbol", F.when(F.col("n") >= 2, 252 * 86400.0 / F.col("m")).otherwise(252.0).alias("bars_per_year"))


def nights(start: str, end: str) -> Column:
    """Midnights between two stamps, 0 where one is unknown or they are reversed."""
    return F.coalesce(F.greatest(F.lit(0), F.datediff(end, start)), F.lit(0))


def in_intervals(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """rows with inside: whether ts lies in one of the intervals (start, end), end exclusive. Overlapping intervals are merged first; then the last start before a row decides.

    Intervals are a calendar, so each day of rows meets the few that touch it."""
    w = Window.orderBy("start")
    reach = intervals.withColumn("_top", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    merged = reach.withColumn("_g", F.sum((F.col("_top").isNull() | (F.col("start") > F.col("_top"))).cast("int")).over(w)).groupBy("_g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    days = merged.withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("end")))).groupBy("_day").agg(F.collect_list(F.struct("start", "end")).alias("_in"))
    both = rows.withColumn("_day", F.to_date("ts")).join(days, "_day", "left")
    hit = F.exists("_in", lambda i: (F.col("ts") >= i["start"]) & (F.col("ts") < i["end"]))
    return both.withColumn("inside", F.coalesce(hit, F.lit(False))).select(*rows.columns, "inside")


def session(stamp: Column) -> Column:
    h = F.hour(stamp)
    return F.when(h < 7, "asia").when(h < 12, "london").when(h < 16, "overlap").when(h < 21, "new_york").otherwise("late")


def shift_days(df: DataFrame, col: str, days: int) -> DataFrame:
    """A slow series stamped when it was known: its date plus a publication delay."""
    return df.withColumn(col, F.date_add(col, days))


def clock_fit(reference: DataFrame, candidate: DataFrame, shifts_s: list[int], least: int = 200, value: str = "r") -> DataFrame:
    """(symbol, shift_s, n, corr): the shift of a candidate's stamps whose values correlate best with the reference's (ts, value), where `least` stamps or more meet; ties to the smaller shift.

    The candidate has a row for each shift, and one equi-join finds the meetings of all."""
    moved = candidate.where(F.col(value).isNotNull()).withColumn("shift_s", F.explode(F.array(*[F.lit(x) for x in shifts_s])))
    moved = moved.select("symbol", "shift_s", (F.col("ts") + F.make_dt_interval(secs=F.col("shift_s"))).alias("ts"), F.col(value).alias("_c"))
    met = moved.join(reference.select("ts", F.col(value).alias("_r")).where("_r IS NOT NULL"), "ts")
    fits = met.groupBy("symbol", "shift_s").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("_c", "_r"), 9).alias("corr")).where((F.col("n") >= least) & F.col("corr").isNotNull())
    best = F.max_by(F.struct("shift_s", "n", "corr"), F.struct("corr", -F.col("shift_s")))
    return fits.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*")
