"""Positions from entry to exit: round trips of deals, with what makes one unfit to count, and charges that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import numbered, running_sum
from ..functions.indicators import c


def round_trips(deals: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(position_key, status, deals, qty_in, qty_out, entry_price, exit_price, gross, charges, net) of deals (position_key, ts, seq, is_entry, side, qty, price, gross, charge).

    status is what the first deal in the order of (ts, seq) that breaks a rule breaks: entry_after_exit, entry_sides_differ (from the first entry's), wrong_exit (before any entry,
    or on the entry's side), exit_too_large (more out than in by then); else not_closed, if nothing or not all went out; else complete, or complete_in_parts after several
    exits. Prices are weighted by quantity; null without deals of their kind. Deals of one position are numbered and summed in chunks. Deals that share (ts, seq) count together in
    what is in by then, and come in the order of entries first, side and quantity.
    """
    key = ["position_key"]
    d = numbered(deals, key, ("ts", "seq", ~c("is_entry"), "side", "qty"))
    first = d.groupBy(*key).agg(F.min(F.when(c("is_entry"), c("row"))).alias("_in"), F.min(F.when(~c("is_entry"), c("row"))).alias("_out"), F.min_by("side", F.when(c("is_entry"), c("row"))).alias("_side"))
    d = running_sum(d, F.when(c("is_entry"), c("qty")).otherwise(-c("qty")), "_open", key).join(first, key)
    d = d.withColumn("_open", F.max_by("_open", "row").over(Window.partitionBy(*key, "ts", "seq")))
    entry = F.when(c("row") > c("_out"), "entry_after_exit").when(c("side") != c("_side"), "entry_sides_differ")
    leave = F.when(c("_in").isNull() | (c("_in") > c("row")) | (c("side") == c("_side")), "wrong_exit").when(c("_open") < -tolerance, "exit_too_large")
    d = d.withColumn("_broken", F.when(c("is_entry"), entry).otherwise(leave))
    into, out = c("is_entry"), ~c("is_entry")
    total = lambda x, k: F.sum(F.when(k, x).otherwise(0))
    t = d.groupBy(*key).agg(
        F.min_by("_broken", F.when(c("_broken").isNotNull(), c("row"))).alias("_broken"), F.count(F.lit(1)).alias("deals"), F.count_if(out).alias("_exits"), total(c("qty"), into).alias("qty_in"), total(c("qty"), out).alias("qty_out"),
        total(c("qty") * c("price"), into).alias("_paid"), total(c("qty") * c("price"), out).alias("_got"), F.sum("gross").alias("gross"), F.sum("charge").alias("charges"),
    )
    open_ = (c("_exits") == 0) | (F.abs(c("qty_in") - c("qty_out")) > tolerance)
    status = F.coalesce("_broken", F.when(open_, "not_closed").when(c("_exits") > 1, "complete_in_parts").otherwise("complete"))
    price = lambda paid, qty: c(paid) / F.nullif(c(qty), F.lit(0))
    return t.select(*key, status.alias("status"), "deals", "qty_in", "qty_out", price("_paid", "qty_in").alias("entry_price"), price("_got", "qty_out").alias("exit_price"), "gross", "charges", (c("gross") + c("charges")).alias("net"))


def with_late_charges(trips: DataFrame, late: DataFrame) -> DataFrame:
    """round_trips() after charges (position_key, charge) that came later: charges and net revised, and `revised` says where. Charges of unknown positions are left out."""
    more = late.groupBy("position_key").agg(F.sum("charge").alias("_late"))
    t = trips.join(more, "position_key", "left").withColumns({"revised": c("_late").isNotNull(), "_late": F.coalesce("_late", F.lit(0))})
    return t.withColumns({"charges": c("charges") + c("_late"), "net": c("net") + c("_late")}).drop("_late")


def charge_per_lot_side(deals: DataFrame) -> DataFrame:
    """(side, qty, charge, per_lot): charges of each side over its quantity; null where nothing was dealt."""
    t = deals.groupBy("side").agg(F.sum("qty").alias("qty"), F.sum("charge").alias("charge"))
    return t.withColumn("per_lot", c("charge") / F.nullif(c("qty"), F.lit(0)))
