"""What the operators share: tables in the shared folder, gapless ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts, as a class of Java and DuckDB regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes what written() stored. Only for tables on which nothing depends any more that isn't itself written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row. Plain columns can be moved into the filters and lambdas that read them, and a lambda computes them for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def unclashed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of df's struct `row`, in the order of columns, and the new ones, which replace those of the same name (in any case)."""
    named = {n.lower() for n in new}
    df = df.select("row", F.struct(*[c.alias(n) for n, c in new.items()]).alias("new"))
    return df.select(*[df["row"].getField(c).alias(c) for c in columns if c.lower() not in named], *[df["new"].getField(n).alias(n) for n in new])


def no_rows(df: DataFrame) -> bool:
    return not df.take(1)


#: Rows of a key from which it counts as crowded, and crowded keys up to which they are broadcast (some numbers or a digest each).
CROWDED_ROWS, BROADCAST_ROWS = 1000, 500_000


def joined(df: DataFrame, other: DataFrame, keys: list[str], crowded: DataFrame) -> DataFrame:
    """df joined with other (each key once) by keys. crowded: the keys of which df has CROWDED_ROWS rows or more. If they are few, their rows stay where
    they are and meet other's by a broadcast, so that no key's rows come together. A row of nulls, which matches nothing, keeps the plan the same at every size.
    """
    spark = df.sparkSession
    none = spark.range(1).select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys])
    hot = written(crowded.select(*keys).distinct().union(none), "crowded-keys")
    if hot.count() > BROADCAST_ROWS:
        return df.join(other, keys)
    hot = F.broadcast(hot)
    return df.join(hot, keys, "left_anti").join(other, keys).unionByName(df.join(F.broadcast(other.join(hot, keys, "left_semi")), keys))


def document_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """(k1, k2): rows that share both have the same id and the same text, and so the same result. Never null."""
    return F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2")


def gapless(df: DataFrame, by: list[str], order: list[str], out: str, chunk: Column | None = None, n_chunks: int = 64, weight: str | None = None) -> DataFrame:
    """Adds `out`: rows (or the sum of `weight`) before this one among the rows with its `by`, without one task for each `by`.

    Rows are ranked inside chunks (a hash of `order` unless `chunk` is given); the chunks' totals, a few numbers each, give the offsets.
    Ranks go chunk by chunk, in `order` inside each, so they are reproducible. Null keys are keys like others.
    """
    chunked = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(n_chunks)) if chunk is None else chunk)
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sums = chunked.groupBy(*by, "_chunk").agg(total.alias("_n"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col("_chunk").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    rank = (F.row_number().over(inside) - 1) if weight is None else F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)] + [F.col("_chunk") == F.col("_of")]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return chunked.withColumn("_rank", rank).join(offsets, condition).withColumn(out, (F.col("_off") + F.col("_rank")).cast("long")).drop("_chunk", "_rank", "_of", "_off", *[f"_by_{i}" for i in range(len(by))])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the undirected edges (a, b): component is the smallest node that can be reached.

    Each round takes the smallest label among neighbours, then the label's label; rounds are about the logarithm of the longest path.
    Every round is written to the shared folder, so lineage stays short; nothing but a count reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), f"{name}-edges")
    stored = labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), f"{name}-labels")
    while True:
        least = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(least, "node").select("node", F.least("component", "m").alias("next"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        after = written(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("component"), "was"), f"{name}-labels")
        discard(stored)
        if no_rows(after.where("component != was")):
            discard(both)
            return after.select("node", "component")
        stored, labels = after, after.select("node", "component")
