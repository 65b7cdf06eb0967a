"""Mixing sources to target weights: capped water-filling, and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, document_key, gapless, read, written


def water_fill(sources: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size) with target: share of all sizes, dealt out by weight (cycled over sources in code-point order, null last), none above max_epochs times its size.

    The level at which each source is full is max_epochs * size / weight. In the order of these levels, sources fill up one by one while what is
    left for each unit of weight would overfill them; the others share the rest. One row for each source, so the windows here see few rows.
    If all sources together are too small, all are full.
    """
    one = Window.partitionBy(F.lit(1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(one.orderBy(F.col("source").isNull(), "source"))
    s = sources.withColumn("w", F.get(cycle, (rank - 1) % len(weights))).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    s = s.withColumn("total", F.sum("source_size").over(one) * F.lit(float(share)))
    by_level = one.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    s = s.withColumns({"k": F.row_number().over(by_level), "before": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rest": F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("full", F.col("cap") * F.col("rest") <= F.col("w") * (F.col("total") - F.col("before")))
    level = F.min(F.when(~F.col("full"), F.struct("k", ((F.col("total") - F.col("before")) / F.col("rest")).alias("level")))).over(one)["level"]
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level)).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: str = "", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_key: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken, and with keep_key the document_key() k1, k2), a row for each row of docs.

    size counts words; target is the source's (water_fill). Every document is taken whole floor(target / source_size) times; for what is left,
    documents are taken once more in the order of MD5(seed and id) while the one at hand lies at least half below the target, so a source misses
    its target by half of one document at most. Running sums go over chunks of that order, so a hot source is not one task.
    Null or empty text has size 0 and is never taken (repeats: the whole ones). A null source is a source, the last. Rows that repeat an id are
    documents of their own. No rows give no rows. Other columns are not read.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    ticket = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keys = document_key(id_col, text_col) if keep_key else ()
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), ticket.alias("ticket"), *keys), "mix-sizes")
    targets = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    digits = max(1, min(6, len(f"{rows.count() // 20_000:x}")))
    ranked = gapless(rows, ["source"], ["ticket", "size"], "before", F.substring("ticket", 1, digits), weight="size")
    t = targets.withColumnRenamed("source", "_source")
    both = ranked.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    both = both.withColumn("whole", whole)
    once_more = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("target") - F.col("whole") * F.col("source_size"))
    both = both.withColumn("repeats", (F.col("whole") + once_more.cast("int")).cast("int"))
    return both.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), *(("k1", "k2") if keep_key else ()))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), [5, 2, 1]).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = {
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size, md5(doc_id::VARCHAR) AS ticket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
b AS (SELECT *, row_number() OVER l AS k, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM a WINDOW l AS (ORDER BY cap / w, source NULLS LAST)),
c AS (SELECT *, cap * rest <= w * (total - before) AS full_ FROM b),
v AS (SELECT arg_min((total - before) / rest, k) AS level FROM c WHERE NOT full_),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE w * level END AS target FROM c LEFT JOIN v ON true),
r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ticket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done FROM d)
SELECT doc_id, size, source_size, target,
  (size * ((CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) + CASE WHEN size > 0 AND done + size / 2.0::DOUBLE <= target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source"""
}
