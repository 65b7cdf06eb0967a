"""Checks against look-ahead and warm-up, and stamps at which all drivers are fresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import along
from .asof import asof


def truncation(bars: DataFrame, rule: Callable[[DataFrame], DataFrame], column: str, cuts: list[int], per_cent: bool = False) -> DataFrame:
    """(cut, checked, differing): the rule on the first `cut` bars of each symbol (or so many per cent of them) against the rule on all; a difference means that it looks ahead. Nulls equal nulls."""
    numbered = bars.withColumns({"_n": F.row_number().over(along()), "_m": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    full = rule(bars).select("symbol", "ts", F.col(column).cast("double").alias("_full"))
    out = None
    for cut in cuts:
        part = rule(numbered.where(F.col("_n") * 100 <= F.col("_m") * cut if per_cent else F.col("_n") <= cut).drop("_n", "_m")).select("symbol", "ts", F.col(column).cast("double").alias("_part"))
        same = F.col("_full").eqNullSafe(F.col("_part")) | (F.abs(F.col("_full") - F.col("_part")) <= 1e-12 * (1 + F.abs("_full")))
        each = part.join(full, ["symbol", "ts"]).agg(F.lit(cut).alias("cut"), F.count(F.lit(1)).alias("checked"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing"))
        out = each if out is None else out.union(each)
    return out


def warmup(bars: DataFrame, indicator: Callable[[DataFrame], DataFrame], column: str, offset: int, burn_in: int) -> DataFrame:
    """(symbol, compared, worst): an indicator started `offset` bars late against the full one, from burn_in bars on; worst is the largest relative difference."""
    numbered = bars.withColumn("_n", F.row_number().over(along()))
    full = indicator(bars).select("symbol", "ts", F.col(column).alias("_full"))
    late = indicator(numbered.where(F.col("_n") > offset)).where(F.col("_n") > offset + burn_in).select("symbol", "ts", F.col(column).alias("_late"))
    both = late.join(full, ["symbol", "ts"]).where("_full IS NOT NULL AND _late IS NOT NULL")
    off = F.abs(F.col("_full") - F.col("_late")) / F.greatest(F.abs("_full"), F.lit(1e-12))
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("compared"), F.max(off).alias("worst"))


def complete(rows: DataFrame, drivers: dict[str, DataFrame], max_age_s: float) -> DataFrame:
    """Rows (symbol, ts, ...) at which every driver (symbol, ts, value) has an observation of its own, not a carried one, within max_age_s."""
    columns = rows.columns
    for name, series in drivers.items():
        rows = asof(rows, series.where("value IS NOT NULL"), max_age_s=max_age_s).withColumnRenamed("matched_ts", f"_{name}").where(f"_{name} IS NOT NULL").drop("value", f"_{name}")
    return rows.select(*columns)
