"""Exact quantiles of large groups: ranks are found by narrowing value ranges, so no group's values meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import stored

#: Ranges that a round cuts each range into.
BINS = 1024


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, and a column for each share): the quantiles of value, linear between neighbouring ranks. Null values don't count; a key without values has no row.

    Values are counted first, so ties cost nothing. Each round counts the values of BINS ranges between what is known to lie below and above a
    rank and goes on in the one that holds it, from its smallest to its largest value, until both are the same: some rounds over the counted
    values, with sums of ranges between them.
    """
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    at = [f((F.col("_total") - 1) * q).cast("long") for q in shares.values() for f in (F.floor, F.ceil)]
    total = stored(total, "value-totals")
    ranks = total.select(*keys, F.explode(F.array_distinct(F.array(*at))).alias("_rank"), "_low", "_high", F.lit(0).cast("long").alias("_before"))
    ranks = stored(ranks, "value-ranks")
    along = Window.partitionBy(*keys, "_rank").orderBy("_bin")
    while ranks.where("_low < _high").take(1):
        inside = counts.join(ranks.where("_low < _high"), keys).where("_v BETWEEN _low AND _high")
        part = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS))
        sums = inside.groupBy(*keys, "_rank", "_before", part.alias("_bin")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        sums = sums.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        found = sums.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))).select(ranks.columns)
        ranks = stored(ranks.where("_low = _high").union(found), "value-ranks")
    values = ranks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_low"))).alias("_at"))

    def between(q: float):
        place = (F.col("_total") - 1) * q
        low, high = (F.element_at("_at", f(place).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return total.join(values, keys).select(*keys, *[between(q).alias(n) for n, q in shares.items()])
