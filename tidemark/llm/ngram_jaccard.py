"""N-gram Jaccard join: the sparse product of the document-by-n-gram incidence with its transpose, in blocks and under size-derived bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, discard, document_key, read, written
from ._words import binaries, grams, mix, owners, ragged, released, text_chunks, word_hashes

#: Columns that come first in `common` go last in every row's order. Only speed depends on their choice, so a bounded number will do.
MOST_COMMON = 1 << 18
#: N-grams among which repeats are counted at once, to find common ones.
COUNTED = 1 << 21
#: Documents of a column up to which all its terms of the product are accumulated; larger ones are resolved around representatives, then in blocks.
SMALL = 32
#: Parts of the sketch that bounds an overlap, and classes of a block of a large column.
BUCKETS, BLOCK = 256, 1500
#: Rows of a column from which it is found by a broadcast and not dealt out as one.
CROWDED = 10_000
#: N-grams of a part of a block, and those whose overlaps are counted at once.
BLOCK_GRAMS = 1 << 21
#: Rows of two numbers each up to which document keys are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Ids of classes without an id, above all ids.
NO_ID = 2**62


def incidence(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each document, their numbers). A document of fewer words has one gram, the whole; one without words has none."""
    words, _, first = word_hashes(data, offsets, lower=True)
    sizes = np.diff(first)
    of = owners(first)
    hashes = grams(words, n)
    same = of[: len(hashes)] == of[n - 1 : n - 1 + len(hashes)]
    hashes, row = hashes[same], of[: len(hashes)][same]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        whole = [grams(words[first[d] : first[d + 1]], int(sizes[d])) + np.uint64(sizes[d]) for d in short]
        hashes, row = np.concatenate([hashes, *whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        hashes, row = hashes[order], row[order]
    counts = np.bincount(row, minlength=len(sizes))
    if len(hashes) < 64 * len(sizes):
        hashes = hashes[np.lexsort((hashes, row))]
    else:
        for part in np.split(hashes, np.cumsum(counts)[:-1]):  # views, sorted in place
            part.sort()
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(sizes))


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set: documents of the same class share both."""
    out = []
    for salt in (0x1234567, 0x9ABCDEF1):
        total = np.zeros(len(sizes), np.uint64)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        if len(hashes):
            total[sizes > 0] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), starts)
        out.append(mix(total + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def firsts(c: np.ndarray, d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first row of each class that has n-grams."""
    full = np.flatnonzero(sizes > 0)
    return np.sort(full[np.unique(np.stack([c[full], d[full]], 1), axis=0, return_index=True)[1]])


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """How many of each row's hashes fall into each of BUCKETS parts: bytes, or 32-bit numbers in a row that has more than 255 in some part. The sum of smaller counts of two rows is no less than their overlap."""
    parts, lengths = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    ends = np.cumsum(sizes)
    for at in range(0, len(sizes), 4096):
        of = sizes[at : at + 4096]
        inside = hashes[ends[at] - sizes[at] : ends[min(at + 4096, len(sizes)) - 1]]
        row = np.repeat(np.arange(len(of)), of)
        counts = np.bincount(row * BUCKETS + (mix(inside) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=len(of) * BUCKETS).reshape(-1, BUCKETS)
        wide = counts.max(1, initial=0) > 255
        parts += [x.astype(np.uint32).view(np.uint8) if w else x.astype(np.uint8) for x, w in zip(counts, wide, strict=True)] if wide.any() else [counts.astype(np.uint8).ravel()]
        lengths.append(np.where(wide, 4 * BUCKETS, BUCKETS))
    return binaries(np.concatenate(parts), np.concatenate(lengths))


def counts_of(sketch: pd.Series) -> np.ndarray:
    """A row of BUCKETS counts for each sketch; bytes where all are bytes."""
    if sketch.str.len().max() == BUCKETS:
        return np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, BUCKETS)
    return np.stack([np.frombuffer(x, np.uint8 if len(x) == BUCKETS else np.uint32).astype(np.uint32) for x in sketch])


def prefix_length(sizes: np.ndarray, a: int, b: int) -> np.ndarray:
    """n - ceil(a n / b) + 1: linked sets share one of their first so many n-grams in a common order."""
    return np.where(sizes > 0, sizes + (-a * sizes // b) + 1, 0)


def _describe(n: int):
    """Rows (k1, k2, n, c, d) of documents, and (n = -1, c: gram, d: classes) of n-grams that several classes of a stretch of documents share."""

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        grams_, times = np.unique(np.concatenate(held), return_counts=True)
        often = times > 1
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(none), -1)), pa.array(grams_[often].view(np.int64)), pa.array(times[often])], names=["k1", "k2", "n", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch.column(2)):
                hashes, sizes = incidence(data, offsets, n)
                c, d = signatures(hashes, sizes)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, end - at) for i in (0, 1)), pa.array(sizes.astype(np.int64)), pa.array(c), pa.array(d)], names=["k1", "k2", "n", "c", "d"])
                first = firsts(c, d, sizes)
                held.append(hashes[ragged((np.cumsum(sizes) - sizes)[first], sizes[first])])
                size += len(held[-1])
                if size >= COUNTED:
                    yield repeated(held)
                    held, size = [], 0
        if held:
            yield repeated(held)
        released()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's two columns of numbers as bytes, for the driver."""
    for batch in batches:
        pairs = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
        yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary())], names=["pairs"])


def _prefixes(n: int, a: int, b: int, common: np.ndarray):
    """Rows (gram, c, n): the first grams of each class's order, of which two linked ones share one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                hashes, sizes = incidence(data, offsets, n)
                c, d = signatures(hashes, sizes)
                first = firsts(c, d, sizes)
                hashes, sizes, c = hashes[ragged((np.cumsum(sizes) - sizes)[first], sizes[first])], sizes[first], c[first]
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = np.minimum(np.searchsorted(common[:, 0], hashes), max(0, len(common) - 1))
                often = np.where(common[at, 0] == hashes, common[at, 1], 0) if len(common) else np.zeros(len(hashes), np.uint64)
                order = np.lexsort((often, row))  # stable, so equal counts stay in the order of hashes
                take = prefix_length(sizes, a, b)
                pick = order[ragged(np.cumsum(sizes) - sizes, take)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[pick].view(np.int64)), *(pa.array(np.repeat(x, take)) for x in (c, sizes.astype(np.int32)))], names=["gram", "c", "n"])
        released()

    return run


def _sets(n: int):
    """Rows (k1, c, d, n, grams, sketch) of documents (k1, text), with the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_chunks(batch.column(1)):
                hashes, sizes = incidence(data, offsets, n)
                c, d = signatures(hashes, sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(c), pa.array(d), pa.array(sizes.astype(np.int64)), binaries(hashes, sizes), sketches(hashes, sizes)], names=["k1", "c", "d", "n", "grams", "sketch"])
        released()

    return run


def candidates(pdf: pd.DataFrame, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of a block (sorted by n) that sizes and sketches allow a link, of different components: x of part i, y of part j."""
    own, n, component = (pdf[x].to_numpy() for x in ("own", "n", "component"))
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    sketch = counts_of(pdf["sketch"])
    rows, columns = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found_x, found_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(rows), 32):
        x = rows[at : at + 32]
        y = columns[(n[columns] * b >= n[x[0]] * a) & (n[columns] * a <= n[x[-1]] * b)]
        if not len(y):
            continue
        fits = (component[x][:, None] != component[y][None]) & ((x[:, None] < y[None]) | (i != j))
        p, q = np.nonzero(fits)
        for step in range(0, len(p), 1 << 15):
            u, v = x[p[step : step + (1 << 15)]], y[q[step : step + (1 << 15)]]
            most = np.minimum(sketch[u], sketch[v]).sum(1, dtype=np.int64)
            fit = most * (a + b) >= a * (n[u] + n[v])
            found_x.append(u[fit])
            found_y.append(v[fit])
    return np.concatenate(found_x), np.concatenate(found_y)


def _partnered(a: int, b: int):
    """Of a block of a large column: the classes that have a partner within the bounds."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "c", "d"])
        kept = np.unique(np.concatenate(candidates(pdf, a, b)))
        return pdf.iloc[kept][["hub", "c", "d"]]

    return block


def _product(a: int, b: int):
    """Of a block of a large column: (a, b) nodes of links that join its components, fewer than it has rows. A row's overlaps are counted at once, for the partners within the bounds that are not joined to it yet."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "c", "d"])
        x, y = candidates(pdf, a, b)
        n, node = pdf["n"].to_numpy(), pdf["node"].to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        _, label = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        found = []
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        edges = np.flatnonzero(np.diff(x, prepend=-1, append=-1)) if len(x) else [0]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            row, left = x[begin], y[begin:end]
            while len(left := left[label[left] != label[row]]):
                step = max(1, int(np.searchsorted(np.cumsum(n[left]), BLOCK_GRAMS, "right")))
                now, left = left[:step], left[step:]
                flat = np.concatenate([sets[k] for k in now])
                hit = sets[row][np.minimum(np.searchsorted(sets[row], flat), n[row] - 1)] == flat
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[now]) - n[now])
                for k in now[b * common >= a * (n[row] + n[now] - common)]:
                    if label[k] != label[row]:
                        label[label == label[k]] = label[row]
                        found.append((node[row], node[k]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return block


def _overlaps(a: int, b: int):
    """Rows (node_x, node_y, grams_x, grams_y) to those whose sets overlap enough, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                common = int(hit.sum())
                linked[i] = b * common >= a * (len(x) + len(y) - common)
            kept = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])
        released()

    return run


def blocks(members: DataFrame):
    """members (hub, c, d, n, ...) dealt out to pairs (i, j) of parts of about BLOCK rows and BLOCK_GRAMS n-grams at most: own is a row's part. A large group becomes many small tasks."""
    parts = members.groupBy("hub").agg((1 + F.floor(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_GRAMS))).cast("int").alias("parts"))
    own = members.join(parts, "hub").withColumn("own", F.pmod(F.xxhash64("c", "d"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = [c for c in members.columns if c != "hub"]
    return own.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rest).groupBy("hub", "i", "j")


def sizes_fit(a: int, b: int, x: str = "n", y: str = "n_y") -> Column:
    """Whether sets of n and n_y elements can have a similarity of a / b."""
    return F.least(x, y) * b >= F.greatest(x, y) * a


def small_columns(shared: DataFrame, a: int, b: int) -> DataFrame:
    """(c, c_y): pairs of classes left by the product of the columns with at most SMALL classes, shared (gram, c, n).

    A pair's terms are added up to its overlap inside both prefixes. Beyond the prefix that ends first in the common order at most n minus the prefix's
    length n-grams are shared, so a pair whose sum doesn't reach the rest of the needed a (n_x + n_y) / (a + b) can't link. Pairs that share a larger
    column too may be discarded here, for that column decides them.
    """
    other = shared.select("gram", F.col("c").alias("c_y"), F.col("n").alias("n_y"))
    terms = shared.join(other, "gram").where((F.col("c") < F.col("c_y")) & sizes_fit(a, b))
    total = terms.groupBy("c", "n", "c_y", "n_y").agg(F.count(F.lit(1)).alias("overlap"))
    beyond = F.floor((F.greatest("n", "n_y") * a + b - 1) / b) - 1
    return total.where((F.col("overlap") + beyond) * (a + b) >= (F.col("n") + F.col("n_y")) * a).select("c", "c_y")


def large_columns(shared: DataFrame, a: int, b: int) -> DataFrame:
    """(c, c_y): the classes of each larger column with four representatives of it (y), linear in the column."""
    me = F.struct("c", "n")
    hashed = [F.min(F.struct(F.xxhash64(F.lit(k), "c").alias("h"), me.alias("me")))["me"] for k in (1, 2)]
    chosen = shared.groupBy("gram").agg(F.array(F.min(me), F.max(me), *hashed).alias("chosen")).select("gram", F.explode("chosen").alias("y"))
    pairs = shared.join(chosen.select("gram", F.col("y.c").alias("c_y"), F.col("y.n").alias("n_y")), "gram")
    return pairs.where((F.col("c") != F.col("c_y")) & sizes_fit(a, b)).select("c", "c_y")


def shared_columns(postings: DataFrame) -> DataFrame:
    """The distinct rows (gram, c, n) of postings whose gram two classes hold, written. Crowded columns are found by a broadcast, if they are few, so none is dealt out as one."""
    several = written(postings.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("rows")).where("low != high").select("gram", "rows"), "ngram-several")
    crowded = several.where(F.col("rows") > CROWDED).select("gram")
    if 0 < crowded.count() <= BROADCAST_ROWS:
        rest = postings.join(several.where(F.col("rows") <= CROWDED).select("gram"), "gram").distinct()
        shared = rest.union(postings.join(F.broadcast(crowded), "gram").distinct())
    else:
        shared = postings.join(several.select("gram"), "gram").distinct()
    shared = written(shared, "ngram-columns")
    discard(several)
    return shared


def links(docs: DataFrame, n: int, a: int, b: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents (k1, k2, n, c, d): key and class of n-gram set, components (c, d, component) of classes, named by their smallest ids).

    Documents with the same set are one class, a row of the incidence matrix. A row of n grams keeps its n - ceil(a n / b) + 1 rarest columns, of which
    linked rows share one. Small columns are multiplied out and their terms accumulated (small_columns); what the bounds leave is decided by whole
    sets. Large columns are first reduced to links with a few representatives. Where one then still holds several components, the product goes
    over blocks of its rows under size and sketch bounds: a block's overlaps are counted in place, it gives fewer links than it has rows, and no
    pair that could join two components is left undecided.
    """
    k2 = document_key(id_col, text_col)[1]
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("k1"), k2, F.col(text_col).alias("text"))
    described = written(source.mapInArrow(_describe(n), "k1 long, k2 long, n long, c long, d long"), "ngram-rows")
    rows = described.where("n >= 0")
    top = described.where("n < 0").groupBy("c").agg(F.sum("d").alias("docs")).orderBy(F.desc("docs"), "c").limit(MOST_COMMON)
    common = np.frombuffer(b"".join(bytes(r["pairs"]) for r in top.mapInArrow(_pairs, "pairs binary").collect()), np.uint64).reshape(-1, 2)
    common = common[np.argsort(common[:, 0])]
    first = rows.where("n > 0").groupBy("c", "d").agg(F.min(F.struct("k1", "k2")).alias("f"))
    node = F.when(F.col("k1") < 2**63 - 1, F.col("k1")).otherwise(F.lit(NO_ID) + F.shiftrightunsigned("c", 2))
    classes = first.select("c", "d", "f.*").withColumn("node", node)
    postings = written(source.select("text").mapInArrow(_prefixes(n, a, b, common), "gram long, c long, n int"), "ngram-prefixes")
    shared = shared_columns(postings)
    discard(postings)
    large = shared.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > SMALL).select("gram")
    large = written(shared.join(large, "gram"), "ngram-large")
    small = shared.join(large.select("gram").distinct(), "gram", "left_anti")
    # columns and pairs go by the first hash of a class; whole sets then tell classes that share it apart
    same = classes.groupBy("c").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("c", F.col("c").alias("c_y"))
    pairs = written(small_columns(small, a, b).union(large_columns(large, a, b)).union(same).distinct(), "ngram-pairs")
    discard(shared)

    used = pairs.select("c").union(pairs.select("c_y")).union(large.select("c")).distinct()
    wanted = written(classes.join(used, "c").select("k1", "k2"), "ngram-wanted")
    texts = source.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, ["k1", "k2"], "left_semi")
    sets = texts.select("k1", "text").mapInArrow(_sets(n), "k1 long, c long, d long, n long, grams binary, sketch binary")
    sets = written(sets.select("c", "d", "n", "sketch", "grams", node.alias("node")), "ngram-sets")

    # a representative's set meets its column's sets where they are, after they moved once
    left = sets.select("c", F.col("node").alias("node_x"), F.col("grams").alias("grams_x"))
    right = sets.select(F.col("c").alias("c_y"), F.col("node").alias("node_y"), F.col("grams").alias("grams_y"))
    full = pairs.join(left, "c").join(right, "c_y").where("node_x != node_y").select("node_x", "node_y", "grams_x", "grams_y")
    edges = written(full.mapInArrow(_overlaps(a, b), "a long, b long").distinct(), "ngram-edges")
    discard(pairs, wanted)
    found = components(edges, "ngram-stars")

    label = sets.join(found, "node", "left").groupBy("c", "d").agg(F.min(F.coalesce("component", "node")).alias("component"))
    hub = large.groupBy("gram").agg(F.min("c").alias("hub"))
    member = large.join(hub, "gram").select("hub", "c").distinct().join(label, "c")
    open_ = member.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("hub")
    whole = sets.groupBy("c", "d").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    open_ = written(member.join(open_, "hub").join(whole, ["c", "d"]), "ngram-open")
    if open_.take(1):
        some = blocks(open_).applyInPandas(_partnered(a, b), "hub long, c long, d long").distinct()
        content = sets.groupBy("c", "d").agg(F.first("grams").alias("grams"))
        more = blocks(open_.join(some, ["hub", "c", "d"], "left_semi").join(content, ["c", "d"])).applyInPandas(_product(a, b), "a long, b long")
        found = components(written(edges.union(more), "ngram-edges"), "ngram-links")
    discard(open_, large, sets)
    return rows, classes.join(found, "node", "left").select("c", "d", F.coalesce("component", "node").alias("component"))


def document_groups(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, n, component), a row for each row of docs: its document_key() with a null id last (k1 of 2^63 - 1), the size of its set, and a number that linked rows share (null where the set is empty)."""
    rows, parts = links(docs, n, *similarity, id_col, text_col)
    return rows.join(parts.withColumnRenamed("component", "_c"), ["c", "d"], "left").select("k1", "k2", "n", F.when(F.col("n") > 0, F.col("_c")).alias("component"))


def ngram_jaccard(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Two documents link if b * intersection >= a * union of their sets of n-word shingles (a, b = similarity; A-Z count as a-z); component_id
    is the smallest id that links lead to. Fewer than n words make one shingle; texts without words, null ones included, have none and link with
    nothing, so they are their own component. Repeated rows share a component, and so do different texts that are each their class's first under one id. A null id takes part in links; a component of null ids only has
    a null component_id. No rows give no rows. Other columns are not read.
    """
    own = F.when(F.col("k1") < 2**63 - 1, F.col("k1"))
    component = F.when(F.col("n") == 0, own).when(F.col("component") < NO_ID, F.col("component"))
    return document_groups(docs, n, similarity, id_col, text_col).select(own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(read(spark, sf_dir, "documents"), 4, (85, 100))


ORACLE_SQL = {
    "op5_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS node, doc_id AS label FROM w UNION SELECT e.b, r.label FROM r JOIN e ON r.node = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(label) AS component_id FROM r GROUP BY node) m USING (doc_id)"""
}
