"""Conversation prefix trie: node tables combined in every partition, merged by hashed keys in rounds, and rolled up from the leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import CROWDED_ROWS, WORD, discard, joined, read, written

#: Turn numbers that are ranked together, turns whose prefixes are hashed together, and conversation ids of one piece of an end list.
TURNS, BLOCK, IDS = 1024, 4096, 1024
#: Partial tries that are merged into one in a round.
FAN_IN = 64

KEY = ["k1", "k2", "depth"]


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, idx, digest, words): every turn by its place in its conversation (from 1), an MD5 of role and text, and the words of the text.

    Turns are ordered by number, nulls first, and turns of one number by that MD5. Null roles and texts count as empty; rows without a conversation take
    no part; repeated rows are turns of their own. A conversation's turns are ranked by TURNS numbers together, so that none is one task.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = written(rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62)))), "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(before)).where("before > 0").select("conv_id", "part", "before")
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest"))
    return rows.withColumn("rank", rank).join(later, ["conv_id", "part"], "left").select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("idx"), "digest", "words")


def with_borrowed_heads(turns: DataFrame, every: int, heads: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c of numbered_turns() begins with the first `heads` turns of conversation c - c % every (all, if they are fewer;
    none, if there is no such one) and goes on with its own turns after its first `heads`. heads: a column of conv_id. Of conversations, (conv_id), some may be left without turns.
    """
    turns = written(turns, "trie-numbered")
    own = turns.groupBy("conv_id").agg(F.max("idx").alias("n")).withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "heads": heads})
    lent = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = written(own.join(lent, "base", "left").select("conv_id", "base", "heads", "n", F.least("heads", F.coalesce("base_n", F.lit(0))).alias("borrowed")), "trie-heads")
    rest = joined(turns, own.select("conv_id", "heads", "borrowed"), ["conv_id"], own.where(F.col("n") >= CROWDED_ROWS)).where(F.col("idx") > F.col("heads"))
    head = turns.withColumnRenamed("conv_id", "base").join(own.where("borrowed > 0"), "base").where(F.col("idx") <= F.col("borrowed"))
    columns = ["conv_id", "digest", "words"]
    both = rest.select(*columns, (F.col("idx") - F.col("heads") + F.col("borrowed")).cast("long").alias("idx")).unionByName(head.select(*columns, F.col("idx").cast("long")))
    return both, own.select("conv_id")


def _lanes(digest: str, at: str) -> list[Column]:
    """Two hashes of a turn at its place; those of a prefix are joined by exclusive or, so that pieces of a conversation can be hashed apart."""
    return [F.xxhash64(at, digest).alias("l1"), F.xxhash64(digest, at, F.lit(1)).alias("l2")]


def prefixes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): a row for each prefix of each conversation, the empty one too: its hash, its parent's, and the words of its last text."""
    rows = turns.select("conv_id", F.col("idx").alias("depth"), "words", F.floor(F.col("idx") / BLOCK).alias("block"), *_lanes("digest", "idx"))
    root = members.select("conv_id", *[F.lit(0).cast("long").alias(x) for x in ("depth", "words", "block", "l1", "l2")])
    rows = written(rows.union(root), "trie-lanes")
    up = Window.partitionBy("conv_id", "block").orderBy("depth")
    inside = rows.withColumns({f"k{i}": F.bit_xor(f"l{i}").over(up) for i in (1, 2)})
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where("block > 0").select("conv_id").distinct()
    blocks = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(*[F.bit_xor(f"l{i}").alias(f"o{i}") for i in (1, 2)])
    blocks = blocks.withColumns({f"o{i}": F.bit_xor(f"o{i}").over(before) for i in (1, 2)}).where("block > 0")
    later = inside.where("block > 0").join(blocks, ["conv_id", "block"]).withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)}).drop("o1", "o2")
    both = inside.where("block = 0").unionByName(later)
    return both.select("conv_id", "depth", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"l{i}")).alias(f"p{i}") for i in (1, 2)], "words")


def merged(partial: DataFrame, keys: list[str], parts: int, **sums: Column) -> DataFrame:
    """One row for each of keys: every partition's rows are combined where they are, and FAN_IN partial tables are merged into one by hashed keys in each round until one is left."""
    runs = partial.withColumn("run", F.spark_partition_id())
    while True:
        parts = -(-parts // FAN_IN)
        runs = runs.withColumn("run", F.floor(F.col("run") / FAN_IN)).groupBy(*keys, "run").agg(*[c.alias(n) for n, c in sums.items()])
        if parts <= 1:
            return runs.drop("run")


def _ids_hash(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k1, k2, depth, ends_sha256) of end lists that come in pieces, sorted: a piece at a time goes through the hash."""
    key, state, done = None, None, []
    for part in parts:
        for k1, k2, depth, ids in part[[*KEY, "ids"]].itertuples(index=False):
            if key == (k1, k2, depth):
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2, depth), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        done = []
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256): SHA-256 of each node's conv_ids in ascending order, joined by commas. Lists are merged in pieces of IDS ids at most."""
    pieces = merged(ends.select(*KEY, F.floor(F.col("conv_id") / IDS).alias("piece"), F.array("conv_id").alias("one")), [*KEY, "piece"], ends.rdd.getNumPartitions(), one=F.flatten(F.collect_list("one")))
    pieces = written(pieces.select(*KEY, "piece", F.array_join(F.transform(F.array_sort("one"), lambda x: x.cast("string")), ",").alias("ids")), "trie-ends")
    several = pieces.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY)
    streamed = pieces.join(several, KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInPandas(_ids_hash, "k1 long, k2 long, depth long, ends_sha256 string")
    return pieces.join(several, KEY, "left_anti").select(*KEY, F.sha2("ids", 256).alias("ends_sha256")).union(streamed)


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """(k1, k2, depth) and the sums of values over each node's subtree, from the leaves upwards: in round r every node gets what its descendants 2^r levels
    below have gathered, so rounds are the logarithm of the depth. A node's ancestors are prefixes of its smallest member, and so found without one key's rows meeting."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    above = paths.select(F.col("conv_id").alias("low"), F.col("depth").alias("up"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    sums, step = nodes.select(*KEY, "low", *values), 1
    while step <= deepest:
        below = sums.where(F.col("depth") >= step).withColumn("up", F.col("depth") - step).join(above, ["low", "up"])
        more = below.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.col("up").alias("depth")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        after = written(sums.join(more, KEY, "left").select(*KEY, "low", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]), "trie-sums")
        if step > 1:
            discard(sums)
        sums, step = after, 2 * step
    return sums.drop("low")


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """A row for each different prefix of the conversations (conv_id, idx from 1 without gaps, digest, words; as numbered_turns() gives them): conv_id
    (its smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (nodes of its subtree without children), saved_tokens (over its
    subtree, words of the last text times members but one), ends_sha256 (of the ids of members that end here).

    members: (conv_id) of all conversations, those without turns too; they end at the root. Two prefixes are equal if two 64-bit hashes are. No conversations give no rows.
    """
    members = turns.select("conv_id").distinct() if members is None else members
    paths = written(prefixes(turns, members), "trie-paths")
    nodes = merged(paths.select(*KEY, "p1", "p2", "words", F.col("conv_id").alias("low"), F.lit(1).cast("long").alias("n")), [*KEY, "p1", "p2", "words"], paths.rdd.getNumPartitions(), low=F.min("low"), n=F.sum("n"))
    nodes = written(nodes, "trie-nodes")
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("end"))
    hashes = end_hashes(written(last.select("end.*", "conv_id"), "trie-last"))
    up = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), up).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = written(counted.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n") - 1) * F.col("words")}), "trie-counted")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("pd"), F.col("low").alias("parent_conv_id"))
    wide = children.where(F.col("n_children") >= CROWDED_ROWS).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("pd"))
    below = joined(nodes.where("depth > 0").withColumn("pd", F.col("depth") - 1), parents, ["p1", "p2", "pd"], wide).select(*KEY, "parent_conv_id")
    sums = subtree_sums(counted, paths, ["n_leaves", "saved_tokens"])
    out = counted.drop("n_leaves", "saved_tokens").join(sums, KEY).join(below, KEY, "left").join(hashes, KEY, "left")
    return out.select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv_id").cast("string")) % 4
    return prefix_trie(*with_borrowed_heads(numbered_turns(read(spark, sf_dir, "conversations")), 20, heads))


ORACLE_SQL = {
    "op12_conversation_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, md5(length(role)::VARCHAR || ':' || role || text) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words, turn FROM t),
i AS (SELECT conv_id, d, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i FROM o),
c AS (SELECT conv_id, max(i) AS n, conv_id - conv_id % 20 AS base,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, (x % 2) * 3988292384)))) % 4 AS h FROM i GROUP BY conv_id),
b AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(p.n, 0)) AS g FROM c LEFT JOIN c p ON c.base = p.conv_id),
r AS (SELECT b.conv_id, i.i AS pos, d, words FROM b JOIN i ON i.conv_id = b.base AND i.i <= b.g
  UNION ALL SELECT b.conv_id, i.i - b.h + b.g, d, words FROM b JOIN i USING (conv_id) WHERE i.i > b.h),
l AS (SELECT b.conv_id, coalesce(list(d ORDER BY pos) FILTER (d IS NOT NULL), []) AS ds, coalesce(list(words ORDER BY pos) FILTER (d IS NOT NULL), []) AS ws FROM b LEFT JOIN r USING (conv_id) GROUP BY b.conv_id),
p AS (SELECT conv_id, len(ds) AS total, unnest(range(0, len(ds) + 1)) AS depth, ds, ws FROM l),
k AS (SELECT conv_id, depth, md5(array_to_string(ds[1:depth], '')) AS key, CASE WHEN depth > 0 THEN md5(array_to_string(ds[1:depth - 1], '')) END AS parent, coalesce(ws[depth], 0) AS words, total = depth AS ends FROM p),
n AS (SELECT depth, key, parent, words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM k GROUP BY ALL),
m AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.key AND x.depth = n.depth + 1) AS n_children FROM n),
s AS (SELECT a.depth, a.key, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
  FROM m JOIN k a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.depth, a.key)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.depth = m.depth AND s.key = m.key LEFT JOIN n u ON u.key = m.parent AND u.depth = m.depth - 1"""
}
