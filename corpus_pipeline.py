"""Five stages over documents: toxicity, line dedup, n-gram Jaccard join, mixing sources to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns documents (the last: packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, ngram_jaccard, packing, toxicity
from tidemark.llm._common import document_key, read, written
from tidemark.llm._tokens import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Document keys (two numbers) up to which they are broadcast.
BROADCAST_ROWS = 500_000

#: Its stages learn from labels and tokenize, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them (not on held-out ids), takes for clean."""
    labels = read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.filter_clean(docs, model).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later repeated runs (of 3 lines, or of 50 words); one that had text and is left without any goes."""
    clean = line_dedup.line_dedup(docs.select(COLUMNS))
    gone = (F.col("n_removed") > 0) & (F.btrim("kept_text", F.lit(" \t\r\n")) == "")
    return clean.where(~F.coalesce(gone, F.lit(False))).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 of five-word shingles, the document with the smallest id (nulls last; of one id the smallest
    hash of the text). Of rows that repeat id and text and have words, one stays. Texts without words are in no group and stay."""
    groups = written(ngram_jaccard.document_groups(docs, 5, (80, 100)), "near-groups")
    first = groups.where("n > 0").groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("first"))
    others = groups.where("n > 0").join(first, "component").where(F.struct("k1", "k2") > F.col("first")).select("k1", "k2").distinct()
    repeated = groups.where("n > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("k1", "k2")
    _, k2 = document_key()
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("k1"), k2)
    kept = keyed.join(sized(others), ["k1", "k2"], "left_anti")
    repeated = sized(repeated)
    once = kept.join(repeated, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(*[F.min(F.struct(*COLUMNS)).alias("row")]).select("row.*")
    return kept.join(repeated, ["k1", "k2"], "left_anti").select(COLUMNS).union(once.select(COLUMNS))


def sized(keys: DataFrame) -> DataFrame:
    """Document keys, written, and broadcast if they are few."""
    keys = written(keys, "document-keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 over sources, 150 % of all words, at most twice each.

    Rows that share id, text and source share what the mix takes of them, dealt out in the order of their other columns.
    """
    k1, k2 = document_key()
    taken = mixing.mix_sources(docs.select("doc_id", "text", "source"), [5, 2, 1], keep_key=True)
    taken = written(taken.groupBy("k1", "k2", "source").agg(F.sum("repeats").alias("repeats"), F.count(F.lit(1)).alias("rows")).where("repeats > 0").withColumnRenamed("source", "_source"), "mix-taken")
    keyed = docs.select(*COLUMNS, k1, k2)
    same = ["k1", "k2"]
    both = keyed.join(taken, same).where(F.col("source").eqNullSafe(F.col("_source")))
    alone = both.where("rows = 1").withColumn("times", F.col("repeats").cast("int"))
    order = Window.partitionBy(*same, "_source").orderBy("lang", "n_chars")
    dealt = both.where("rows > 1").withColumn("times", F.floor((F.col("repeats") + F.col("rows") - F.row_number().over(order)) / F.col("rows")).cast("int"))
    return alone.union(dealt).where("times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard", drop_near_copies), ("mixing", mix_by_source), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
