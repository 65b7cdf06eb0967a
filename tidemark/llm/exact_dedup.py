"""Exact dedup: a tree of merges of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, read, written

#: A sorted run's entries: digest, a second hash and the length (to verify the digest), smallest id, rows.
ENTRY = np.dtype([("digest", "S32"), ("check", "<i8"), ("length", "<i8"), ("id", "<i8"), ("rows", "<i8")])
NO_ID = 2**63 - 1


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of sorted runs: each digest once, with its smallest id and all its rows. Raises if equal digests disagree in length or second hash.

    NumPy's stable sort of byte strings merges the presorted stretches it finds.
    """
    entries = np.concatenate(runs)
    entries = entries[np.argsort(entries["digest"], kind="stable")]
    first = np.concatenate([[True], entries["digest"][1:] != entries["digest"][:-1]])
    starts = np.flatnonzero(first)
    merged = entries[starts]
    group = np.cumsum(first) - 1
    if (entries["check"] != merged["check"][group]).any() or (entries["length"] != merged["length"][group]).any():
        raise ValueError("two texts share a digest")
    merged["id"] = np.minimum.reduceat(entries["id"], starts)
    merged["rows"] = np.add.reduceat(entries["rows"], starts)
    return merged


def lane_bits(rows: int | None, lane_rows: int) -> int:
    """Leading bits of a digest whose lanes hold about lane_rows of so many rows at most."""
    return min(32, ((rows or 0) // lane_rows).bit_length())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, lane_rows: int = 200_000) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256) of documents, one for each row of docs.

    Each partition makes a sorted run of (SHA-256 of the text with white space collapsed, smallest id). In each round, fan_in neighbouring runs
    meet and are merged, until one is left: log(partitions) rounds over digests, never over texts. As runs grow they are cut into lanes, ranges of
    digests: before each merge into fan_in times as many, so that no merge holds more than about lane_rows and their number follows the rows.

    Null text counts as empty. Equal ids and repeated rows: every row counts in group_size; all rows with the smallest id are kept. A null id is
    larger than any other: it is kept only where all ids of a group are null. No rows give no rows. Other columns are not read.
    """
    digest = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("t")).select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.xxhash64("t").alias("check"), F.length("t").cast("long").alias("length"))
    rows = written(rows.withColumn("run", F.spark_partition_id()), "digests")
    stats = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("run").alias("last")).first()
    final, bits, step = lane_bits(stats["n"], lane_rows), lane_bits(stats["most"], lane_rows), (fan_in - 1).bit_length()

    def split(run: int, entries: np.ndarray, bits: int) -> pd.DataFrame:
        """A row for each lane of a sorted run."""
        lane = entries["digest"].astype("S8").view(">u8").astype(np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(len(entries), np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        parts = np.split(entries, starts[1:])
        return pd.DataFrame({"lane": lane[starts].astype(np.int64), "run": run, "entries": [x.tobytes() for x in parts]})

    def sorted_run(next_bits: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            entries = np.zeros(len(pdf), ENTRY)
            entries["digest"] = np.frombuffer(bytes.fromhex("".join(pdf["text_sha256"])), "S32")
            entries["check"], entries["length"], entries["rows"] = pdf["check"], pdf["length"], pdf["n"]
            entries["id"] = pdf["id"].fillna(NO_ID).astype("int64")
            return split(pdf["run"].iloc[0], merge_runs([entries]), next_bits)

        return run

    def merged(next_bits: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return split(pdf["run"].iloc[0], merge_runs([np.frombuffer(x, ENTRY) for x in pdf["entries"]]), next_bits)

        return run

    local = rows.groupBy("run", "text_sha256", "check", "length").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), F.count(F.lit(1)).alias("n"))
    first_lane = F.shiftright(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long"), 32 - bits)
    schema = "lane long, run int, entries binary"
    bits = min(final, bits + step)
    runs = local.withColumn("lane", first_lane).groupBy("lane", "run").applyInPandas(sorted_run(bits), schema)
    left = (stats["last"] or 0) + 1
    while left > 1:
        bits = min(final, bits + step)
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy("lane", "run").applyInPandas(merged(bits), schema)
        left = -(-left // fan_in)

    def unpacked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for blob in part["entries"]:
                e = np.frombuffer(blob, ENTRY)
                hexes = e["digest"].astype("S32").tobytes().hex()
                yield pd.DataFrame({"text_sha256": [hexes[i : i + 64] for i in range(0, len(hexes), 64)], "keep_id": e["id"], "group_size": e["rows"]})

    groups = written(runs.mapInPandas(unpacked, "text_sha256 string, keep_id long, group_size long"), "digest-groups")
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return rows.join(groups, "text_sha256").select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
}
