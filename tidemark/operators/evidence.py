"""Evidence of trading: fills found for intents, limit orders replayed on quotes, named gates, and fills read from logs and reports."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import islands, numbered, stored
from ..functions.indicators import c
from .assays import with_ahead


#: An unknown seq sorts behind all others.
UNKNOWN = 2**63 - 1


def nearest_match(intents: DataFrame, fills: DataFrame, within_s: float, slice_s: float = 86400) -> DataFrame:
    """(symbol, seq, fill_seq, distance_s): each intent, in the order of (ts, seq), takes the nearest fill within within_s seconds that no intent before it took;
    of equally near ones the later, then the greater seq. Intents without one have nulls. Both sides hold symbol, ts, seq; rows without a stamp match nothing, an
    unknown seq comes last, repeated rows count each for itself.

    Time is cut into slices of slice_s, or of twice within_s if that is longer, so an intent reaches fills of its own slice and the borders of its neighbours only.
    All slices are matched at once, as if nothing were taken at their borders; then those whose neighbour before them took something there are matched again,
    until no slice takes anything else at its border than in the round before. That is the result of one pass in order: the first slice is right at
    once, and every other is right a round after the one before it. A round matches only slices whose border changed, and a symbol is as many groups as it has slices.
    """
    width, within = max(round(slice_s * 1e6), 2 * round(within_s * 1e6)), round(within_s * 1e6)
    side = lambda df, k: df.select("symbol", F.unix_micros(c("ts").cast("timestamp")).alias("at"), F.coalesce(c("seq").cast("long"), F.lit(UNKNOWN)).alias("seq"), F.lit(k).alias("side"))
    place = lambda at: F.floor(at / width)
    asked, given = side(intents, 0), side(fills, 1)
    reached = F.explode(F.sequence(place(c("at") - within), place(c("at") + within)))
    rows = stored(asked.where("at IS NOT NULL").withColumn("slice", place(c("at"))).unionByName(given.where("at IS NOT NULL").withColumn("slice", reached)), "match-rows")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = lambda k: zip(*(pdf.loc[pdf["side"] == k, x].tolist() for x in ("at", "seq")))
        taken = Counter(pairs(2))
        free = sorted((Counter(pairs(1)) - taken).elements())
        at = [t for t, _ in free]
        # Place k + 1 of either list stands for fill k: where to look on for one that is free, to the left or to the right.
        left, right = list(range(len(free) + 2)), list(range(len(free) + 2))

        def look(way: list[int], k: int) -> int:
            while way[k] != k:
                way[k] = way[way[k]]
                k = way[k]
            return k

        out = []
        for symbol, part, now, seq in pdf.loc[pdf["side"] == 0, ["symbol", "slice", "at", "seq"]].sort_values(["at", "seq"]).itertuples(index=False):
            here = bisect_left(at, now)
            before, after = look(left, here), look(right, here + 1)
            if after <= len(at):
                after = look(left, bisect_right(at, at[after - 1]))
            near = [(abs(at[k - 1] - now), -k) for k in (before, after) if 1 <= k <= len(at) and abs(at[k - 1] - now) <= within]
            far, k = min(near, default=(None, 0))
            if k:
                left[-k], right[-k] = -k - 1, -k + 1
            out.append((symbol, part, seq, *(free[-k - 1] if k else (None, None)), None if far is None else far / 1e6))
        return pd.DataFrame(out, columns=["symbol", "slice", "seq", "fill_at", "fill_seq", "distance_s"]).astype({"fill_at": "Int64", "fill_seq": "Int64"})

    key = lambda a, b: c(f"{a}.symbol").eqNullSafe(c(f"{b}.symbol")) & (c(f"{a}.slice") == c(f"{b}.slice"))
    border = F.sort_array(F.collect_list(F.when(place(c("fill_at") + within) > c("slice"), F.struct("fill_at", "fill_seq"))))
    found, borders, todo, n = [], [], rows, 0
    while True:
        matched = todo.groupBy("symbol", "slice").applyInPandas(run, "symbol string, slice long, seq long, fill_at long, fill_seq long, distance_s double")
        found.append(stored(matched.withColumn("round", F.lit(n)), "matched"))
        now = found[-1].groupBy("symbol", "slice", "round").agg(border.alias("border"))
        before = reduce(DataFrame.unionByName, borders).groupBy("symbol", "slice").agg(F.max_by("border", "round").alias("border")) if borders else now.limit(0).drop("round")
        changed = now.alias("n").join(before.alias("o"), key("n", "o"), "left").where(~F.coalesce(c("o.border"), F.array().cast(now.schema["border"].dataType)).eqNullSafe(c("n.border")))
        again = stored(changed.select("n.symbol", (c("n.slice") + 1).alias("slice"), "n.border"), "match-again")
        if again.isEmpty():
            break
        borders.append(now)
        taken = again.select("symbol", "slice", F.explode("border").alias("b")).select("symbol", c("b.fill_at").alias("at"), c("b.fill_seq").alias("seq"), F.lit(2).alias("side"), "slice")
        todo, n = rows.alias("r").join(again.alias("a"), key("r", "a"), "left_semi").unionByName(taken), n + 1
    every = reduce(DataFrame.unionByName, found)
    last = every.withColumn("_last", F.max("round").over(Window.partitionBy("symbol", "slice"))).where("round = _last").select("symbol", "seq", "fill_seq", "distance_s")
    unknown = asked.where("at IS NULL").select("symbol", "seq", F.lit(None).cast("long").alias("fill_seq"), F.lit(None).cast("double").alias("distance_s"))
    seqs = {x: F.nullif(x, F.lit(UNKNOWN)) for x in ("seq", "fill_seq")}
    return last.unionByName(unknown).withColumns(seqs)


def limit_replay(ticks: DataFrame, below_c: int, stop_c: int, target_c: int, horizon: int) -> DataFrame:
    """(symbol, row, fill_rows, exit_rows, result, pnl_c) of a buy limit below_c under the mid of every row, for `horizon` rows.

    It fills at the first ask at or under the limit and leaves at the first later bid stop_c under it (at that bid) or target_c over it (at the target).
    result: unfilled, stop, target, or open, which is valued at the last bid. Rows at a series' end have fewer rows ahead.
    """
    s = with_ahead(numbered(ticks).select("symbol", "row", "mid_c", "bid_c", "ask_c"), horizon)
    ahead = Window.partitionBy("symbol", "stretch").orderBy("row").rowsBetween(1, horizon)
    s = s.withColumn("path", F.collect_list(F.struct("bid_c", "ask_c")).over(ahead)).where(c("own")).withColumn("limit", c("mid_c") - below_c)
    s = s.withColumn("fill", F.array_position(F.transform("path", lambda q: q["ask_c"] <= c("limit")), True))
    s = s.withColumn("rest", F.when(c("fill") > 0, F.slice("path", (c("fill") + 1).cast("int"), horizon)))
    s = s.withColumn("leave", F.array_position(F.transform("rest", lambda q: (q["bid_c"] <= c("limit") - stop_c) | (q["bid_c"] >= c("limit") + target_c)), True))
    bid = F.when(c("leave") > 0, F.get("rest", (c("leave") - 1).cast("int"))["bid_c"])
    last = F.when(c("fill") > 0, F.try_element_at("path", F.lit(-1))["bid_c"])
    s = s.withColumns({"bid": bid, "last": last})
    result = F.when(c("fill") == 0, "unfilled").when(c("bid") <= c("limit") - stop_c, "stop").when(c("bid").isNotNull(), "target").otherwise("open")
    pnl = F.when(c("fill") == 0, 0).when(c("bid") <= c("limit") - stop_c, c("bid") - c("limit")).when(c("bid").isNotNull(), F.lit(target_c)).otherwise(c("last") - c("limit"))
    return s.select("symbol", "row", F.when(c("fill") > 0, c("fill")).alias("fill_rows"), F.when(c("leave") > 0, c("leave")).alias("exit_rows"), result.alias("result"), pnl.cast("long").alias("pnl_c"))


def gates(metrics: DataFrame, rules: dict[str, tuple[str, str, float]], keys=("symbol",)) -> DataFrame:
    """(keys, gate, value, bound, passed): each rule (column, ">=" or "<=", bound) against a row of metrics; an unknown value doesn't pass."""
    each = []
    for name, (column, how, bound) in rules.items():
        value = c(column).cast("double")
        each.append(F.struct(F.lit(name).alias("gate"), value.alias("value"), F.lit(float(bound)).alias("bound"), F.coalesce(value >= bound if how == ">=" else value <= bound, F.lit(False)).alias("passed")))
    return metrics.select(*keys, F.explode(F.array(*each)).alias("g")).select(*keys, "g.*")


def read_log(spark: SparkSession, path: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """A row for each line that the pattern matches: its groups in order, under the names and types of `fields`; text that doesn't cast is null."""
    lines = spark.read.text(path).where(c("value").rlike(pattern))
    parts = lines.select(*[F.trim(F.regexp_extract("value", pattern, i + 1)).alias(f"x{i}") for i in range(len(fields))])
    return parts.select(*[F.expr(f"try_cast(x{i} AS {t})").alias(n) for i, (n, t) in enumerate(fields.items())])


def read_report_rows(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(file, row, cells) of the table rows with `columns` cells in HTML reports, one file read whole by one task; marks inside cells are taken out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "html"))
    cells = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"(?s)<[^>]*>", "")))
    return rows.select("file", "row", cells.alias("cells")).where(F.size("cells") == columns)


def changes(rows: DataFrame, label: Column, keys=("symbol",)) -> DataFrame:
    """(keys, from_label, to_label, n): how often one run of equal labels gives way to another."""
    d = islands(rows.withColumn("_label", label), "_label", keys=keys).groupBy(*keys, "island").agg(F.first("_label").alias("to_label"))
    d = d.withColumn("from_label", F.lag("to_label").over(Window.partitionBy(*keys).orderBy("island"))).where("island > 1")
    return d.groupBy(*keys, "from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))
