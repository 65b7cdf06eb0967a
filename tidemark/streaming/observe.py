"""Streams of ticks: bars under a watermark, repeats within it, outcomes of attempts, and an exponential mean kept from batch to batch."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..frames import numbered, stored
from ..functions.affine import prefix_maps


def tick_stream(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """Ticks of a folder of Parquet files; stamps become zoned (session zone), as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.round(F.col("value") * 100).cast("long").alias("mid_c"))


def stream_bars(ticks: DataFrame, width: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Bars of a tick stream, each given once its end is behind the watermark; later ticks are dropped and counted by Spark's metrics."""
    at = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("mid_c", at).alias("open_c"), F.max("mid_c").alias("high_c"), F.min("mid_c").alias("low_c"), F.max_by("mid_c", at).alias("close_c"), F.count(F.lit(1)).alias("n"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open_c", "high_c", "low_c", "close_c", "n")


def first_of_key(ticks: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first tick of each key within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def outcome(now_s, stale_after_s: float = 60, quoted: bool = False):
    """The one outcome of an attempt: no stamp, a stamp from the future, a stale one, a price that isn't positive, and if quoted (bid_c, ask_c are columns) crossed or locked ones; else accepted."""
    crossed, locked = (F.col("bid_c") > F.col("ask_c"), F.col("bid_c") == F.col("ask_c")) if quoted else (F.lit(False), F.lit(False))
    age = F.lit(now_s) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return F.when(F.col("ts").isNull(), "no_stamp").when(age < 0, "future").when(age > stale_after_s, "stale").when(~(F.col("mid_c") > 0), "bad_price").when(crossed, "crossed").when(locked, "locked").otherwise("accepted")


def in_order(ticks: DataFrame, known: DataFrame) -> DataFrame:
    """ticks of a batch, refused by an error when they are read if one is older than the last known stamp of its symbol (symbol, last): a series is append-only. Unknown symbols pass."""
    both = ticks.join(known.withColumnRenamed("last", "_last"), "symbol", "left")
    late = F.raise_error(F.concat(F.lit("late tick at "), F.col("ts").cast("string")))
    return both.where(F.when(F.col("ts") < F.col("_last"), late.cast("boolean")).otherwise(F.lit(True))).drop("_last")


def append_new(ticks: DataFrame, path: str) -> int:
    """Appends those of a batch whose key (session, seq) isn't stored yet, once each, and returns how many were new: a batch that is sent twice changes nothing."""
    spark = ticks.sparkSession
    new = ticks.dropDuplicates(["session", "seq"])
    try:
        new = new.join(spark.read.parquet(path).select("session", "seq"), ["session", "seq"], "left_anti")
    except AnalysisException:  # nothing was stored yet
        pass
    n = new.count()
    new.write.mode("append").parquet(path)
    return n


def running_totals(ticks: DataFrame) -> DataFrame:
    """(symbol, n, sum_c, low_c, high_c) so far: state of five numbers for each symbol, whatever the length of the series; a row for each symbol of a batch."""

    def step(key: tuple, parts, state: GroupState):
        n, total, low, high = state.get if state.exists else (0, 0, None, None)
        for p in parts:
            x = p["mid_c"]
            n, total = n + len(x), total + int(x.sum())
            low, high = min(int(x.min()), int(x.max()) if low is None else low), max(int(x.max()), int(x.min()) if high is None else high)
        state.update((n, total, low, high))
        yield pd.DataFrame({"symbol": [key[0]], "n": [n], "sum_c": [total], "low_c": [low], "high_c": [high]})

    schema = "n long, sum_c long, low_c long, high_c long"
    return ticks.groupBy("symbol").applyInPandasWithState(step, f"symbol string, {schema}", schema, "append", GroupStateTimeout.NoTimeout)


def run_exponential(stream: DataFrame, folder: str, name: str, alpha: float) -> DataFrame:
    """(symbol, seq, ema) of a stream: its batches' exponential means, in the order of (ts, seq) inside a batch, each going on from what the batch before left.

    A batch is an affine scan over numbered rows in chunks, so a symbol's batch is many tasks. Rows and the last means are written under the batch's number: one that
    is run again writes the same. A restart goes on from the checkpoint.
    """
    spark, root = stream.sparkSession, f"{folder}/{name}"
    rows_schema, last_schema = "symbol string, seq long, ema double", "symbol string, last double"

    def batch(ticks: DataFrame, number: int) -> None:
        known = spark.read.schema(last_schema).parquet(f"{root}/last/{number - 1}") if number else spark.createDataFrame([], last_schema)
        t = stored(numbered(ticks.select("symbol", "ts", "seq", "mid_c")).join(F.broadcast(known), "symbol", "left").select("symbol", "row", "seq", "mid_c", "last"), "ema-rows")
        new = (F.col("row") == 0) & F.col("last").isNull()
        steps = t.select("symbol", "row", F.when(new, 0.0).otherwise(1 - alpha).alias("a"), F.when(new, F.col("mid_c").cast("double")).otherwise(alpha * F.col("mid_c")).alias("b"))
        ema = F.col("a") * F.coalesce("last", F.lit(0.0)) + F.col("b")
        done = stored(t.select("symbol", "row", "seq", "last").join(prefix_maps(steps, ["symbol"]), ["symbol", "row"]).select("symbol", "seq", "row", ema.alias("ema")), "ema-done")
        done.select("symbol", "seq", "ema").write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        last = done.groupBy("symbol").agg(F.max_by("ema", "row").alias("last"))
        known.join(last.select("symbol"), "symbol", "left_anti").union(last).write.mode("overwrite").parquet(f"{root}/last/{number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{rows_schema}, batch long").parquet(f"{root}/rows").drop("batch")


#: What an attempt can come to: fixed values.
OUTCOMES = ("SESSION_START", "STORED", "DUPLICATE", "VALIDATION_REJECTED", "RETRIEVAL_ERROR", "STORAGE_ERROR", "UNRESOLVED")


def record_attempts(stream: DataFrame, folder: str, name: str, key: list[str], valid: Column, border: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(attempts, rows) of a stream of ticks (session, ts, seq, ...): every tick is one attempt, (session, seq, outcome, record_id, ts), and those that are STORED are rows, under the same id.

    A tick that isn't `valid` is VALIDATION_REJECTED, one without a stamp UNRESOLVED, and one whose key is stored already, or comes again in its batch, a DUPLICATE. Rows and attempts
    are written under the batch's number, so a batch that is run again writes the same. border: a stamp from which data is locked; a batch that reaches it fails whole, before anything of it is written.
    """
    spark, root = stream.sparkSession, f"{folder}/{name}"
    columns = ["session", "seq", "ts", *[k for k in key if k not in ("session", "seq", "ts")]]
    rows_schema = stream.select(*columns).schema.add("record_id", "string").add("batch", "long")
    attempts_schema = "session bigint, seq bigint, outcome string, record_id string, ts timestamp, batch long"

    def batch(ticks: DataFrame, number: int) -> None:
        if border is not None and ticks.where(F.col("ts") >= F.lit(border).cast("timestamp")).take(1):
            raise ValueError(f"a tick at or after {border} is locked")
        fine = F.col("ts").isNotNull() & F.coalesce(valid, F.lit(False))
        t = ticks.withColumn("_fine", fine).withColumn("_nth", F.row_number().over(Window.partitionBy("_fine", *key).orderBy("ts", "seq")))
        if number:
            stored_before = spark.read.schema(rows_schema).parquet(f"{root}/rows").where(F.col("batch") < number).select(*key).distinct().withColumn("_known", F.lit(True))
            t = t.join(stored_before, key, "left")
        else:
            t = t.withColumn("_known", F.lit(None).cast("boolean"))
        outcome = F.when(F.col("ts").isNull(), "UNRESOLVED").when(~F.col("_fine"), "VALIDATION_REJECTED").when(F.col("_known") | (F.col("_nth") > 1), "DUPLICATE").otherwise("STORED")
        t = stored(t.withColumn("outcome", outcome).withColumn("record_id", F.when(F.col("outcome") == "STORED", F.sha2(F.concat_ws(":", "session", "seq"), 256))), "attempts")
        t.where("outcome = 'STORED'").select(*columns, "record_id").write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        t.select("session", "seq", "outcome", "record_id", "ts").write.mode("overwrite").parquet(f"{root}/attempts/batch={number}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(attempts_schema).parquet(f"{root}/attempts").drop("batch"), spark.read.schema(rows_schema).parquet(f"{root}/rows").drop("batch")


def reconcile_attempts(attempts: DataFrame, rows: DataFrame) -> DataFrame:
    """(session, attempts, a count for each outcome, balanced, store_rows, missing, orphans, agree): attempts against stored rows in both directions.

    balanced: every attempt but the session's start has a known outcome. missing: stored attempts without a row; orphans: rows without such an attempt; agree: neither, and
    as many ids as rows. A session known on one side only has a row, too.
    """
    named = {o: o.lower() for o in OUTCOMES}
    market = F.col("outcome") != "SESSION_START"
    counts = attempts.groupBy("session").agg(F.count_if(market).alias("attempts"), *[F.count_if(F.col("outcome") == o).alias(n) for o, n in named.items()], F.count_if(market & F.col("outcome").isin(*OUTCOMES)).alias("_classified"))
    said = attempts.where("outcome = 'STORED' AND record_id IS NOT NULL").groupBy("session", "record_id").agg(F.count(F.lit(1)).alias("_said"))
    there = rows.groupBy("session", "record_id").agg(F.count(F.lit(1)).alias("_there"))
    ids = said.join(there, ["session", "record_id"], "full").groupBy("session").agg(F.coalesce(F.sum("_there"), F.lit(0)).alias("store_rows"), F.count_if(F.col("_there").isNull()).alias("missing"), F.count_if(F.col("_said").isNull()).alias("orphans"), F.count("_said").alias("_ids"))
    both = counts.join(ids, "session", "full").na.fill(0)
    return both.select("session", "attempts", *named.values(), (F.col("_classified") == F.col("attempts")).alias("balanced"), "store_rows", "missing", "orphans", ((F.col("missing") == 0) & (F.col("orphans") == 0) & (F.col("_ids") == F.col("store_rows"))).alias("agree"))


def run_available(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over what is there, to Parquet in `folder` with its checkpoint beside it, and reads the result. A restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}/rows").option("checkpointLocation", f"{folder}/{name}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}/rows")
