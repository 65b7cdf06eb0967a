"""Ordered frames (symbol, ts, ...): window helpers, gaps, islands, and carries between days.

Every operator sorts by ts (then seq, where rows share a stamp) inside a symbol and uses only rows up to the current one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

KEYS, ORDER = ("symbol",), ("ts",)


def along(keys=KEYS, order=ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(n: int, keys=KEYS, order=ORDER) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return along(keys, order).rowsBetween(-(n - 1), 0)


def prior(n: int, keys=KEYS, order=ORDER) -> WindowSpec:
    """The n rows before the current one."""
    return along(keys, order).rowsBetween(-n, -1)


def so_far(keys=KEYS, order=ORDER) -> WindowSpec:
    return along(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def gated(value: Column, of: Column, frame: WindowSpec, least: int) -> Column:
    """value over the frame, null until `least` rows of it are known (warm-up)."""
    return F.when(F.count(of).over(frame) >= least, value.over(frame))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null, since Spark orders NaN above every number."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def seconds(ts: Column | str = "ts") -> Column:
    """Seconds since 1970 of a stamp with or without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / 1e6


def gap_prefix(df: DataFrame, limit_s: float, out: str = "gap_group") -> DataFrame:
    """Number of gaps of more than limit_s seconds so far; equal at two rows means no gap lies between them."""
    w = along()
    gap = (seconds() - seconds(F.lag("ts").over(w)) > limit_s).cast("int")
    return df.withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn(out, F.sum("_gap").over(so_far())).drop("_gap")


def islands(df: DataFrame, value: str, out: str = "island", keys=KEYS, order=ORDER) -> DataFrame:
    """Number of the run of consecutive equal values (null equals null) that a row belongs to, from 1."""
    w = along(keys, order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def carried_last(df: DataFrame, values: list[str], keys=KEYS, order=ORDER, day: str = "_day") -> DataFrame:
    """The last known of each value up to the current row, as <value>_last. Windows go over days of a key; the last values of earlier days come
    from a table of one row for each key and day, so a long series is no single task."""
    dated = df.withColumn(day, F.to_date("ts"))
    w = along((*keys, day), order).rowsBetween(Window.unboundedPreceding, 0)
    stamp = F.struct(*order)
    ends = dated.groupBy(*keys, day).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), stamp)).alias(f"_end_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, day, *[F.last(f"_end_{v}", True).over(before).alias(f"_carry_{v}") for v in values])
    both = dated.join(ends, [*keys, day])
    return both.withColumns({f"{v}_last": F.coalesce(F.last(v, True).over(w), f"_carry_{v}") for v in values}).drop(day, *[f"_carry_{v}" for v in values])


def previous(df: DataFrame, values: list[str], keys=KEYS, order=ORDER) -> DataFrame:
    """The row before's values as prev_<value>, with windows over days like carried_last. Values must not be null."""
    day = F.to_date("ts")
    dated = df.withColumn("_day", day)
    w = along((*keys, "_day"), order)
    ends = dated.groupBy(*keys, "_day").agg(*[F.max_by(v, F.struct(*order)).alias(f"_end_{v}") for v in values])
    days = Window.partitionBy(*keys).orderBy("_day")
    ends = ends.select(*keys, "_day", *[F.lag(f"_end_{v}").over(days).alias(f"_carry_{v}") for v in values])
    both = dated.join(ends, [*keys, "_day"])
    return both.withColumns({f"prev_{v}": F.coalesce(F.lag(v).over(w), f"_carry_{v}") for v in values}).drop("_day", *[f"_carry_{v}" for v in values])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); only a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys=KEYS, order=("ts", "seq")) -> DataFrame:
    """df with row, the place in its key from 0, by ranks within days and counts of earlier days; order begins with ts."""
    d = df.withColumn("_day", F.to_date("ts"))
    days = d.groupBy(*keys, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(*order)) - 1
    return d.join(days, [*keys, "_day"]).withColumn("row", F.col("_before") + rank).drop("_day", "_before")


def running_sum(rows: DataFrame, value: Column, out: str, keys=KEYS, chunk: int = 4096) -> DataFrame:
    """rows (with row, their place in the key) with the sum of value up to each row; sums go over chunks of rows and a table of one row for each chunk."""
    r = rows.withColumns({"_x": value, "_chunk": F.floor(F.col("row") / chunk)})
    sums = r.groupBy(*keys, "_chunk").agg(F.sum("_x").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = F.sum("_x").over(Window.partitionBy(*keys, "_chunk").orderBy("row"))
    return r.join(sums, [*keys, "_chunk"]).withColumn(out, F.col("_before") + inside).drop("_x", "_chunk", "_before")
