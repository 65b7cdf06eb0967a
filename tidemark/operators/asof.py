"""As-of joins by union and carried values: no range join, and no single task for a long series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import carried_last, seconds


def asof(left: DataFrame, right: DataFrame, value: str = "value", strict: bool = False, max_age_s: float | None = None, keys=("symbol",)) -> DataFrame:
    """left with `value`, the right row's last one at or before ts (before it if strict), and matched_ts; null beyond max_age_s.

    left keeps every row and column; rows of one right stamp give their greatest value. Null stamps match nothing.
    """
    probe = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_t": F.lit(None).cast("timestamp_ntz")})
    known = right.groupBy(*keys, "ts").agg(F.max(value).alias("_v"))
    stamp = F.col("ts").cast(left.schema["ts"].dataType)
    # at one stamp, known rows come before the probe, or after it if strict
    known = known.select(*keys, stamp.alias("ts"), "_v", stamp.cast("timestamp_ntz").alias("_t"), F.lit(2 if strict else 0).alias("_side"))
    both = probe.unionByName(known, allowMissingColumns=True)
    done = carried_last(both, ["_v", "_t"], keys, ("ts", "_side")).where("_side = 1")
    age = seconds("ts") - seconds("_t_last")
    fresh = F.lit(True) if max_age_s is None else age <= max_age_s
    return done.select(*left.columns, F.when(fresh, F.col("_v_last")).alias(value), F.when(fresh, F.col("_t_last")).alias("matched_ts"))


def asof_forward(left: DataFrame, right: DataFrame, value: str = "value", keys=("symbol",)) -> DataFrame:
    """left with `value`, the right row's first one at or after ts, and matched_ts: an as-of join on mirrored stamps. Rows of one right stamp give their greatest value."""
    mirror = lambda x: F.timestamp_micros(-F.unix_micros(F.col(x).cast("timestamp"))).cast("timestamp_ntz")
    probe = left.withColumns({"_ts": F.col("ts"), "ts": mirror("ts")})
    found = asof(probe, right.withColumn("ts", mirror("ts")), value, keys=keys)
    return found.withColumns({"ts": F.col("_ts"), "matched_ts": mirror("matched_ts")}).select(*left.columns, value, "matched_ts")
